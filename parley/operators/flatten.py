"""Decoded bot responses -> the 18-column message fact row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.columns import (
    blank, head_dialog_node, layout_name, map_entities, map_intents, text_join,
)

# context field -> fact column, defaulted to "" when absent
OPTIONAL_CONTEXT = {
    "location_type": "location_type", "user_location": "user_location",
    "user_id": "user_id", "lp_chat_id": "lp_chat_id", "browser": "browser",
    "device": "device", "operating_system": "operating_system", "channel": "channel",
    "resolution_status": "resolution_status", "sentiment": "sentiment",
}


def flatten(decoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``{response, timestamp}`` rows -> message rows.

    Missing optional strings become ``""``; the dialog node is the head of the
    dialog stack (``""`` when the stack is empty, instead of failing the
    batch); text lines are joined with a space; received intents/entities are
    reshaped to (name, confidence) / (name, value), absent lists to ``[]``.
    ``keep`` names input columns to carry along (e.g. a source key).
    """
    r = F.col("response")
    msg = r["message"]
    ctx = msg["context"]
    return decoded.select(
        *(keep or []),
        r["bot_id"].alias("bot_id"),
        r["dialog_id"].alias("dialog_id"),
        ctx["conversation_id"].alias("conversation_id"),
        blank(head_dialog_node(ctx["system"]["dialog_stack"])).alias("dialog_node"),
        *[blank(ctx[src]).alias(dst) for src, dst in OPTIONAL_CONTEXT.items()],
        text_join(msg["text"]).alias("text"),
        map_intents(msg["intents"]).alias("intents"),
        map_entities(msg["entities"]).alias("entities"),
        F.col("timestamp").alias("timestamp"),
    )


def response_layout(decoded: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per response, the layout widget name (``"none"`` without a layout)."""
    return decoded.select(*(keep or []),
                          layout_name(F.col("response")["message"]["layout"]).alias("layout_name"),
                          F.col("timestamp"))
