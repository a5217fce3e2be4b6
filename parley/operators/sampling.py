"""Deterministic weighted draws, as column expressions.

A row's uniform number comes from a multiplicative hash of its key, so a
draw is reproducible on every retry and in any engine that can do exact
integer arithmetic.  These stand in for the message generator's random
weighted choices (browser, device, operating system, resolution status and
the 25% chance that a status is present at all).
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's weights, in the order it tries them.
BROWSER_WEIGHTS = (("chrome", .25), ("firefox", .25), ("ie", .25), ("opera", .25))
DEVICE_WEIGHTS = (("apple", .5), ("android", .5))
OS_WEIGHTS = (("linux", .33), ("windows", .34), ("macos", .33))
RESOLUTION_WEIGHTS = (("resolved", .5), ("unresolved", .25), ("abandoned", .17), ("escalated", .08))
STATUS_PRESENT_ABOVE = .75

# Odd 32-bit multipliers, one per draw stream; stream 0 is the classic
# golden-ratio multiplicative hash.  Distinct multipliers (not key offsets,
# which would only shift one stream against another) keep the draws of one
# key from moving together.
HASH_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393)
HASH_MODULUS = 4294967296


def uniform(key: Column, stream: int = 0) -> Column:
    """A number in [0, 1) from an integer key: ``(key * P[stream]) mod 2**32 / 2**32``.

    Exact decimal arithmetic, so any engine with wide integers agrees.
    """
    h = F.pmod(key.cast("decimal(20,0)") * F.lit(HASH_MULTIPLIERS[stream]), F.lit(HASH_MODULUS))
    return h.cast("double") / F.lit(float(HASH_MODULUS))


def thresholds(weights) -> list[float]:
    """Running sums of the weights, in order (the upper bound of each category)."""
    return list(accumulate(w for _, w in weights))


def weighted_category(u: Column, weights) -> Column:
    """The first category whose running weight exceeds ``u``.

    Draws past the last running sum (weights summing below 1) fall to the
    last category.
    """
    names = [n for n, _ in weights]
    out = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], thresholds(weights)[:-1]))):
        out = F.when(u < F.lit(bound), F.lit(name)).otherwise(out)
    return out


def keep_with_probability(u: Column, above: float = STATUS_PRESENT_ABOVE) -> Column:
    """True for a draw above ``above`` (with the default, a quarter of the rows)."""
    return u > F.lit(above)
