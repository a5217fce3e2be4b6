"""Rules that travel with the messages: what a bot response says of the input that may follow it.

A response may bound the next input (``inputvalidation``, on the message or on its
output: one of a list, some of a list, a range) and the fields of a form
(``output.store``: required, regular expressions with a message).  As each row
brings its own rules, they are data: an array column of ``RULE`` structs, which
``broken_rules`` interprets row by row in built-in functions.

``rules_in_force`` finds the rules for each input: those of the newest earlier
response of its conversation.  It is an as-of join without a join of rows: both
sides are one table, cut into time blocks, so that a conversation with very many
rows is no single task; what a block hands on is its newest rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RULE = ("struct<place: string, field: string, kind: string, allowed: array<string>, "
        "low: decimal(38,18), high: decimal(38,18), pattern: string, message: string>")
BLOCK_MS = 3_600_000


def _rule(place: str, kind: str, *, field: Column | None = None, allowed: Column | None = None, low: Column | None = None,
          high: Column | None = None, pattern: Column | None = None, message: Column | None = None) -> Column:
    parts = {"field": field, "allowed": allowed, "low": low, "high": high, "pattern": pattern, "message": message}
    values = {"place": F.lit(place), "kind": F.lit(kind)} | {k: F.lit(None) if v is None else v for k, v in parts.items()}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _ordered(rule: Column) -> Column:
    """The fields of a rule in the order and with the types of ``RULE``."""
    names = [part.split(":")[0].strip() for part in RULE[len("struct<"):-1].replace("decimal(38,18)", "decimal").split(", ")]
    return F.struct(*[rule[n].alias(n) for n in names]).cast(RULE)


def _input_rules(place: str, validation: Column) -> Column:
    """A list that is absent or empty states no rule; a range goes from its least to its greatest number."""
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    one, some, span = validation["oneOf"], validation["someOf"], validation["range"]
    return F.array(F.when(given(one), _ordered(_rule(place, "one_of", allowed=one))),
                   F.when(given(some), _ordered(_rule(place, "some_of", allowed=some))),
                   F.when(given(span), _ordered(_rule(place, "range", low=F.array_min(span), high=F.array_max(span)))))


def _form_rules(place: str, fields: Column) -> Column:
    def of_field(f: Column) -> Column:
        needed = F.array(F.when(f["required"], _ordered(_rule(place, "required", field=f["name"], message=f["label"]))))
        checks = F.coalesce(F.transform(f["validations"], lambda v: _ordered(
            _rule(place, "regex", field=f["name"], pattern=v["regex"], message=v["message"]))), F.array().cast(f"array<{RULE}>"))
        return F.concat(needed, checks)

    return F.coalesce(F.flatten(F.transform(fields, of_field)), F.array().cast(f"array<{RULE}>"))


def carried_rules(message: Column) -> Column:
    """``array<RULE>`` of a decoded bot message; empty if it carries none."""
    rules = F.concat(_input_rules("message", message["inputvalidation"]), _input_rules("output", message["output"]["inputvalidation"]),
                     _form_rules("form", message["output"]["store"]))
    return F.filter(rules, lambda r: r.isNotNull())


def rules_in_force(responses: DataFrame, inputs: DataFrame, *, key: str = "conversation_id", time: str = "timestamp",
                   order: str | None = None, block_ms: int = BLOCK_MS) -> DataFrame:
    """``inputs`` with ``rules``: those of the newest response of the same ``key`` before their ``time``.

    ``responses`` holds key, time and ``rules``; of responses of one time the one with the
    greatest ``order`` column counts.  A response without rules lifts those before it.  A response
    of the input's own time comes after it.  Inputs with a null key or time, or with
    no earlier response, have no rules (an empty array).  All rows and columns of ``inputs`` stay.
    """
    none = F.array().cast(f"array<{RULE}>")
    kept = [c for c in inputs.columns if c != "rules"]
    said = responses.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("__key"), F.col(time).cast("bigint").alias("__at"),
        F.struct(F.col(time).cast("bigint").alias("at"), (F.col(order) if order else F.lit(0)).alias("nth"),
                 F.col("rules").alias("rules")).alias("__said"))
    asked = inputs.select(F.col(key).alias("__key"), F.col(time).cast("bigint").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    both = asked.withColumn("__said", F.lit(None)).unionByName(said, allowMissingColumns=True)
    both = both.withColumn("__block", F.floor(F.col("__at") / F.lit(block_ms)))
    # inputs before responses of the same time; among those, the newest last
    inside = (Window.partitionBy("__key", "__block").orderBy("__at", F.col("__said").isNotNull(), "__said.nth")
              .rowsBetween(Window.unboundedPreceding, 0))
    here = both.withColumn("__here", F.last("__said", ignorenulls=True).over(inside)).where("__row IS NOT NULL").drop("__said", "__at")
    # what a block hands on: its newest response, once per block (combined before the shuffle)
    newest = said.withColumn("__block", F.floor(F.col("__at") / F.lit(block_ms))).groupBy("__key", "__block").agg(
        F.max_by("__said", F.struct("__said.at", "__said.nth")).alias("__last"))
    blocks = newest.unionByName(here.where("__key IS NOT NULL").select("__key", "__block").distinct(), allowMissingColumns=True)
    blocks = blocks.groupBy("__key", "__block").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select("__key", "__block", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    out = here.join(handed, ["__key", "__block"], "left")
    return out.select("__row.*", F.coalesce(F.col("__here")["rules"], F.col("__before")["rules"], none).alias("rules"))


def broken_rules(rows: DataFrame, keys: list[str], *, value: Column, fields: Column, rules: Column) -> DataFrame:
    """``(keys..., place, field, kind, message)`` for every rule that a row's input breaks.

    ``value`` is the input's text; for ``some_of`` it is a list between commas.  ``fields``
    (map of strings) holds the form's fields.  A null input breaks no rule on the input; a
    value that is no number is outside every range; a field that is null or blank breaks
    ``required`` and nothing else.  A pattern matches anywhere in the value unless it is
    anchored; one that is no regular expression is reported as kind ``unreadable`` and
    not applied, as a message must not stop the rows behind it.
    """
    each = rows.select(*keys, value.alias("__value"), fields.alias("__fields"), F.explode(rules).alias("__rule"))
    # explode first: reflection is allowed in a projection only
    readable = F.expr("try_reflect('java.util.regex.Pattern', 'compile', __rule.pattern)").isNotNull()
    each = each.withColumn("__readable", F.when(F.col("__rule.kind") == "regex", readable))
    r, v = F.col("__rule"), F.col("__value")
    field = F.get(F.transform(F.array(r["field"]), lambda f: F.col("__fields")[f]), F.lit(0))
    blank = F.coalesce(F.trim(field) == "", F.lit(True))
    number = v.try_cast("decimal(38,18)")
    chosen = F.transform(F.split(v, ","), lambda x: F.trim(x))
    broken = (F.when(r["kind"] == "one_of", ~F.array_contains(r["allowed"], v))
              .when(r["kind"] == "some_of", ~F.forall(chosen, lambda x: F.array_contains(r["allowed"], x)))
              .when(r["kind"] == "range", v.isNotNull() & ~F.coalesce(number.between(r["low"], r["high"]), F.lit(False)))
              .when(r["kind"] == "required", blank)
              .when(~F.col("__readable"), F.lit(True))
              .when(r["kind"] == "regex", ~blank & ~F.rlike(field, F.when(F.col("__readable"), r["pattern"]))))
    kind = F.when(~F.col("__readable"), F.lit("unreadable")).otherwise(r["kind"])
    return each.where(broken).select(*keys, r["place"].alias("place"), r["field"].alias("field"), kind.alias("kind"), r["message"].alias("message"))
