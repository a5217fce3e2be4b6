"""Scalar column expressions used by the flattening and measure operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTENT_TYPE = "array<struct<name: string, confidence: double>>"
ENTITY_TYPE = "array<struct<name: string, value: string>>"


def blank(col: Column | str) -> Column:
    """Missing optional string -> ``""`` (so anonymous rows share one key)."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def head_dialog_node(stack: Column) -> Column:
    """Node name of the first dialog-stack entry, NULL on an empty stack.

    Entries are variants: an object ``{"dialog_node": ...}`` or, in the older
    message model, the bare node name as a string.
    """
    first = F.try_element_at(stack, F.lit(1))
    return F.coalesce(
        F.try_variant_get(first, "$.dialog_node", "string"),
        F.when(F.schema_of_variant(first) == F.lit("STRING"),
               F.try_variant_get(first, "$", "string")),
    )


def text_join(lines: Column) -> Column:
    """Text lines joined by a single space."""
    return F.array_join(lines, " ")


def map_intents(intents: Column) -> Column:
    """Received intents ``{confidence, intent}`` -> ``{name, confidence}``; NULL -> []."""
    return F.coalesce(
        F.transform(intents, lambda i: F.struct(i["intent"].alias("name"),
                                                i["confidence"].alias("confidence"))),
        F.array().cast(INTENT_TYPE),
    )


def map_entities(entities: Column) -> Column:
    """Received entities ``{entity, location, value}`` -> ``{name, value}``; NULL -> []."""
    return F.coalesce(
        F.transform(entities, lambda e: F.struct(e["entity"].alias("name"),
                                                 e["value"].alias("value"))),
        F.array().cast(ENTITY_TYPE),
    )


def layout_name(layout: Column) -> Column:
    """Name of the widget to display, ``"none"`` when the message has no layout."""
    return F.when(layout.isNull(), F.lit("none")).otherwise(layout["name"])


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, NULL when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
