"""JSON helpers for fields whose type varies from record to record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """Array-or-string text (a variant) -> ``array<string>``.

    The array reading is tried first; a plain string becomes a one-element
    array; an absent field stays NULL; any other JSON type is NULL as well.
    """
    as_array = F.try_variant_get(value, "$", "array<string>")
    as_string = F.when(F.schema_of_variant(value) == F.lit("STRING"),
                       F.array(F.try_variant_get(value, "$", "string")))
    return F.coalesce(as_array, as_string)


def json_action_args(args: Column) -> Column:
    """Action args (a variant) -> ``struct<variables array<string>, named map<string,string>>``.

    ``{"variables": [...]}`` fills ``variables``; any other object is read as a
    string map into ``named``.  Exactly one side is set for a present value.
    """
    variables = F.try_variant_get(args, "$.variables", "array<string>")
    named = F.when(variables.isNull(),
                   F.try_variant_get(args, "$", "map<string, string>"))
    return F.when(args.isNull(), F.lit(None)).otherwise(
        F.struct(variables.alias("variables"), named.alias("named")))


def raw_json_map(value: Column) -> Column:
    """A free-form JSON object -> ``map<string,string>``; nested values keep their JSON text."""
    return F.from_json(value, "map<string, string>")
