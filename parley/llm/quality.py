"""Quality rules: fixed base rules, then a calibrated linear model over hashed n-grams.

The model is a logistic regression on the shares of hashed word 1- and 2-grams
and character (code point) 3- and 5-grams of a text, fitted on labelled rows, with probabilities
calibrated (Platt) on rows the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import BLANK_SPLIT, doc_bytes, gram_hashes, mix, owner, per_document, slices, span_hasher, word_spans
from parley.llm.learning import adam, labelled_sample, sigmoid

WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 5)
REPEAT_WORDS = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass
class Texts:
    """A slice of texts with its words hashed once."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray    # first word of each document, n+1 entries
    words: np.ndarray
    hashes: object


def read_texts(column: pa.Array) -> Texts:
    data, offsets = doc_bytes(column)
    starts, ends, first = word_spans(data, offsets, BLANK_SPLIT)
    hashes = span_hasher(data)
    return Texts(data, offsets, starts, ends, first, hashes(starts, ends), hashes)


def grams(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n neighbours within a document, offsets of the documents' grams)."""
    whole = gram_hashes(values, n)
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    keep = np.ones(len(whole), bool)
    for back in range(1, n):   # grams that would reach into the next document
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(whole))]] = False
    return whole[keep], np.concatenate([[0], np.cumsum(sizes)])


def code_points(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each code point: its bytes in a row, offsets of the documents' code points)."""
    starts = np.flatnonzero((t.data & 0xC0) != 0x80)
    points = t.data[starts].astype(np.uint64)
    ends = np.append(starts[1:], len(t.data))
    for back in range(1, 4):
        more = np.flatnonzero(ends - starts > back)
        points[more] = (points[more] << np.uint64(8)) | t.data[starts[more] + back]
    return points, np.searchsorted(starts, t.offsets)


def char_grams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` over code points, with a cheaper hash."""
    total = max(0, len(points) - n + 1)
    whole = np.zeros(total, np.uint64)
    for i in range(n):
        whole = whole * np.uint64(0xD6E8FEB86659FD93) + points[i: total + i]
    keep = np.ones(total, bool)
    for back in range(1, n):
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < total)]] = False
    return mix(whole[keep]), np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - n + 1, 0))])


def families(t: Texts, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets) of each n-gram family; families have buckets of their own."""
    made = [(t.words, t.first) if n == 1 else grams(t.words, t.first, n) for n in WORD_GRAMS]
    points, at = code_points(t)
    made += [char_grams(points, at, n) for n in CHAR_GRAMS]
    for k, (hashes, offsets) in enumerate(made):
        yield (hashes >> np.uint64(64 - bits)).astype(np.int64) + (k << bits), offsets


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(t.offsets) - 1
    heads = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])   # code points up to each byte
    out = {"n_words": np.diff(t.first), "word_chars": per_document(heads[t.ends] - heads[t.starts], t.first),
           "n_symbols": per_document(_SYMBOL[t.data].astype(np.int64), t.offsets)}
    breaks = np.flatnonzero(t.data == 0x0A)
    # lines of all documents: from an offset or a break to the next break or offset
    begin = np.concatenate([t.offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, t.offsets[1:]])
    doc = np.concatenate([np.arange(n), np.searchsorted(t.offsets, breaks, side="right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.sort(end) if n == 0 else end[np.lexsort((end, np.concatenate(
        [np.searchsorted(t.offsets, breaks, side="right") - 1, np.arange(n)])))]
    worded = np.searchsorted(t.starts, begin) < np.searchsorted(t.starts, end)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    key = mix(t.hashes(begin, end) + mix(doc.astype(np.uint64)))
    fresh = np.zeros(len(key), bool)
    fresh[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(doc[~fresh], minlength=n).astype(np.int64)
    runs, at = grams(t.words, t.first, REPEAT_WORDS)
    doc = owner(at)
    _, inverse, count = np.unique(mix(runs + mix(doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1) if len(runs) else np.zeros(0, np.int64)
    word = t.first[doc[twice]] + twice - at[doc[twice]]
    step = np.zeros(len(t.words) + 1, np.int64)
    np.add.at(step, word, 1)
    np.add.at(step, word + REPEAT_WORDS, -1)
    out["n_repeat_words"] = per_document((np.cumsum(step[:-1]) > 0).astype(np.int64), t.first)
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray    # of all families
    bias: float
    slope: float           # calibration: probability = sigmoid(slope * z + intercept)
    intercept: float
    bits: int

    def probabilities(self, t: Texts) -> np.ndarray:
        z = np.full(len(t.offsets) - 1, self.bias)
        for buckets, offsets in families(t, self.bits):
            z += per_document(self.weights[buckets], offsets) / np.maximum(np.diff(offsets), 1)
        return sigmoid(self.slope * z + self.intercept)


def train_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 2000, bits: int = 14, steps: int = 120,
                  rate: float = 0.5, l2: float = 1e-6, label_col: str = "quality",
                  id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``sample_rows`` labelled ids, calibrate on every fifth of them.

    The tasks reduce each sample text to (bucket, share) pairs; the driver holds
    those.  Without labels of both kinds every text has probability 1.
    """
    rows = labelled_sample(docs, labels, label_col, sample_rows, id_col=id_col, text_col=text_col)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, values = [[] for _ in range(len(part))], [[] for _ in range(len(part))]
                for buckets, offsets in families(read_texts(part.column("text")), bits):
                    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                        key, n = np.unique(buckets[a:b], return_counts=True)
                        keys[d].append(key.astype(np.int32))
                        values[d].append((n / max(b - a, 1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.concatenate(x).tobytes() for x in keys], pa.binary()),
                     pa.array([np.concatenate(x).tobytes() for x in values], pa.binary()), part.column("label"), part.column("fold")],
                    ["keys", "values", "label", "fold"])

    rows = rows.select("text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("int").alias("fold"))
    got = rows.mapInArrow(shares, "keys binary, values binary, label int, fold int").toArrow()
    label, fold = (got.column(c).to_numpy().astype(int) for c in ("label", "fold"))
    size = len(WORD_GRAMS + CHAR_GRAMS) << bits
    if len(set(label[fold != 0])) < 2:
        return QualityModel(np.zeros(size), 0.0, 0.0, 40.0, bits)
    keys = [np.frombuffer(x, np.int32) for x in got.column("keys").to_pylist()]
    values = np.concatenate([np.frombuffer(x, np.float32) for x in got.column("values").to_pylist()])
    lengths = np.array([len(k) for k in keys])
    key, doc = np.concatenate(keys), np.repeat(np.arange(len(keys)), lengths)
    used = fold != 0
    weight = np.where(used, 1.0, 0.0) / used.sum()

    def z_of(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, w[key] * values, len(keys)) + w[-1]

    def gradient(w: np.ndarray) -> np.ndarray:
        d = (sigmoid(z_of(w)) - label) * weight
        g = np.bincount(key, d[doc] * values, size + 1) + l2 * w
        g[-1] = d.sum()
        return g

    w = adam(gradient, size + 1, steps=steps, rate=rate)
    z, y = z_of(w)[~used], label[~used]
    slope, intercept = 1.0, 0.0
    if len(set(y)) == 2:
        scale = max(np.abs(z).max(), 1e-9)

        def platt(v: np.ndarray) -> np.ndarray:
            d = sigmoid(v[0] * z / scale + v[1]) - y
            return np.array([(d * z / scale).mean() + 1e-3 * v[0], d.mean()])

        slope, intercept = adam(platt, 2, steps=400, rate=0.1)
        slope /= scale
    return QualityModel(w[:-1], float(w[-1]), float(slope), float(intercept), bits)


def quality_rules(docs: DataFrame, model: QualityModel, *, least: float = 0.5, least_words: int = 10,
                  most_repeated: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, calibrated ``probability`` and ``kept`` of every text.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated``
    percent of them in 5-word windows found twice or more.  kept: not base_failed
    and probability >= ``least``.  A null or empty text has no words, so it fails;
    repeated rows are judged each; an empty table gives an empty result; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t = read_texts(part.column("text"))
                counts = base_counts(t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(counts[c].astype(np.int64)) for c in names), pa.array(shared.value.probabilities(t))],
                    ["id", *names, "probability"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in names)}, probability double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *names, failed.alias("base_failed"), "probability",
                      (~failed & (F.col("probability") >= least)).alias("kept"))
