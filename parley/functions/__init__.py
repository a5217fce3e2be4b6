"""Column-level helpers: every function takes and returns ``Column``s."""

from parley.functions.columns import (
    blank, head_dialog_node, layout_name, map_entities,
    map_intents, safe_ratio, text_join,
)
from parley.functions.calendar import (
    GRAINS, bucket_start, epoch_ms_to_local, ntz_to_epoch_ms,
)
from parley.functions.json import json_action_args, json_text, raw_json_map

__all__ = [
    "GRAINS", "blank", "bucket_start", "epoch_ms_to_local",
    "head_dialog_node", "json_action_args", "json_text", "layout_name",
    "map_entities", "map_intents", "ntz_to_epoch_ms", "raw_json_map",
    "safe_ratio", "text_join",
]
