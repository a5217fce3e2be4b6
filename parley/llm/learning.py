"""What the two text classifiers share: the labelled sample and the optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def _labelled_ids(labels: DataFrame, label_col: str, id_col: str, keep: Column | None) -> DataFrame:
    """(id, label) without nulls; of conflicting labels of one id the largest counts."""
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    picked = picked.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return picked if keep is None else picked.where(keep)


def _texts_of(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "id")   # at most as many ids as the sample takes


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, *,
                    id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, text, label) of the documents of at most ``rows`` labelled ids, the smallest by hash.

    Null ids and labels are left out; of conflicting labels of one id the largest counts.
    """
    picked = _labelled_ids(labels, label_col, id_col, keep).orderBy(F.xxhash64("id"), "id").limit(rows)
    return _texts_of(docs, picked, id_col, text_col)


def sample_by_label(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, *, id_col: str = "doc_id",
                    text_col: str = "text", keep: Column | None = None) -> tuple[DataFrame, dict[int, float]]:
    """Like ``labelled_sample``, but of the rarer label all ids up to half of ``rows``; also each label's weight.

    A label (0 or 1) weighs as many labelled ids as one of its sampled ids stands for.
    """
    ids = _labelled_ids(labels, label_col, id_col, keep)
    there = dict(ids.groupBy(F.col("label") == 1).count().collect())   # two rows
    there = {y: there.get(y == 1, 0) for y in (0, 1)}
    ones = min(there[1], max(rows // 2, rows - there[0]))
    taken = {1: ones, 0: min(there[0], rows - ones)}
    parts = [ids.where((F.col("label") == 1) == F.lit(y == 1)).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in taken.items()]
    weights = {y: there[y] / n if n else 1.0 for y, n in taken.items()}
    return _texts_of(docs, parts[0].unionByName(parts[1]), id_col, text_col), weights


def adam(gradient: Callable[[np.ndarray], np.ndarray], size: int, *, steps: int, rate: float) -> np.ndarray:
    """Minimise from zero with full-batch Adam steps."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
