"""Row validation from declared rules -> a violations table.

Rules mirror the input-validation vocabulary of the bot messages: value in a
list (``one_of``), every list element in a list (``some_of``), value in a
numeric range, a regular expression with its message, and required fields.
All rules are evaluated in one projection; violating (row, rule) pairs are
emitted with ``explode``, so the work is one pass with no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    field: str
    kind: str          # one_of | some_of | range | regex | required
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    message: str = ""

    def violated(self) -> Column:
        c = F.col(self.field)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "one_of":
            return c.isNotNull() & ~c.isin(*self.values)
        if self.kind == "some_of":
            allowed = F.array(*[F.lit(v) for v in self.values])
            return c.isNotNull() & ~F.forall(c, lambda x: F.array_contains(allowed, x))
        if self.kind == "range":
            return c.isNotNull() & ~c.between(F.lit(self.low), F.lit(self.high))
        if self.kind == "regex":
            return c.isNotNull() & ~c.rlike(self.pattern)
        raise ValueError(f"unknown rule kind {self.kind!r}")


def one_of(field, values, message="", name=None):
    return Rule(name or f"{field}_one_of", field, "one_of", tuple(values), message=message)


def some_of(field, values, message="", name=None):
    return Rule(name or f"{field}_some_of", field, "some_of", tuple(values), message=message)


def in_range(field, low, high, message="", name=None):
    return Rule(name or f"{field}_range", field, "range", low=low, high=high, message=message)


def matches(field, pattern, message="", name=None):
    return Rule(name or f"{field}_regex", field, "regex", pattern=pattern, message=message)


def required(field, message="", name=None):
    return Rule(name or f"{field}_required", field, "required", message=message)


def violations(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """``(keys..., rule, field, message)`` for every rule a row breaks."""
    hits = F.array(*[F.when(r.violated(), F.struct(F.lit(r.name).alias("rule"),
                                                   F.lit(r.field).alias("field"),
                                                   F.lit(r.message).alias("message")))
                     for r in rules])
    return (df.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("v"))
              .select(*keys, "v.rule", "v.field", "v.message"))
