"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its hashed lower-case words;
a document's is the noisy-or of its sentences, 1 - prod(1 - p).  Training
maximises the documents' likelihood, which tells the sentences apart, so the
offending sentences of any document can be located.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from parley.llm.arrays import LOWER, byte_mask, doc_bytes, owner, released, slices, span_hasher, word_spans
from parley.llm.learning import adam, fold_of, sample_by_label, sigmoid

#: Words: ASCII letters and digits and every byte of other scripts.
_WORD = byte_mask(drop=[(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text hashed at once: a worker needs many times as much.
SLICE_BYTES = 1 << 19
_PART = 0xA5A5A5A5A5A5A5A5   # tells the first bytes of a word from a word of these bytes
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray   # one per hash bucket
    bias: float

    def probabilities(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each sentence, given its words' buckets and the first word of each (n+1 entries); the words beside it make no difference."""
        sums = np.add.reduceat(self.weights[buckets], first[:-1]) if len(buckets) else np.zeros(0)
        return sigmoid(sums + self.bias)


def sentence_words(texts: pa.Array, bits: int) -> tuple[np.ndarray, ...]:
    """(buckets, first bucket of each sentence, first sentence of each document,
    start and end byte of each sentence in the whole array, offsets of the documents).

    A word gives the buckets of its first 4, 5, 6, 7 and 8 bytes (as far as it is
    longer) and of the whole word, so that inflected forms share what they begin with.
    A sentence ends after ``.``, ``!``, ``?`` or a line break and has at least one word.
    """
    data, offsets = doc_bytes(texts)
    starts, ends, doc_words = word_spans(data, offsets, _WORD)
    hashes = span_hasher(LOWER[data])
    width = len(PREFIXES) + 1
    buckets = np.empty((len(starts), width), np.int64)
    for k, n in enumerate(PREFIXES):
        cut = np.minimum(starts + n, ends)
        buckets[:, k] = np.where(cut < ends, hashes(starts, cut) ^ np.uint64(_PART), 0) >> np.uint64(64 - bits)
    buckets[:, -1] = hashes(starts, ends) >> np.uint64(64 - bits)
    cuts = np.unique(np.concatenate([np.flatnonzero(_END[data]) + 1, offsets]))
    segment = np.searchsorted(cuts, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = segment[1:] != segment[:-1]
    first = np.flatnonzero(new)
    doc_sentences = np.searchsorted(first, doc_words)
    stop = cuts[np.minimum(segment[first], len(cuts) - 1)] if len(first) else np.zeros(0, np.int64)
    return buckets.ravel(), np.append(first, len(starts)) * width, doc_sentences, starts[first], stop, offsets


def telling(often: np.ndarray, marked: np.ndarray, share: float, chance: float) -> np.ndarray:
    """Whether a bucket stands in labelled documents more often than ``chance`` buckets would if labels were drawn at random.

    The chance of ``marked`` labels or more among ``often`` documents is at most
    exp(-often * divergence) (Chernoff); it is held against the number of buckets.
    """
    rate = marked / np.maximum(often, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        clean = np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0)
        divergence = np.where(rate > share, rate * np.log(rate / share) + clean, 0)
    return (marked > 0) & (rate > share) & (often * divergence >= np.log(max((often > 0).sum(), 1) / chance))


def fit_sentences(words: list[np.ndarray], sizes: list[np.ndarray], label: np.ndarray, *, bits: int, steps: int, rate: float,
                  l2: float, leak: float, chance: float, least_z: float = 0.0, weight: np.ndarray | None = None) -> ToxicityModel:
    """Noisy-or fit from each document's buckets, sentence sizes (in buckets) and label.

    P(label) = 1 - (1 - leak) * prod(1 - p): the leak takes the labels that no
    sentence explains.  Buckets that are not ``telling`` take no part; what chance
    leaves among the others is held down by ``l2``.  ``least_z`` may ask for that
    many standard deviations as well.  ``weight`` is one for each document.
    """
    # one document at a time: only the buckets that tell are copied
    often, marked = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for w, y in zip(words, label, strict=True):
        held = np.unique(w)
        often[held] += 1
        if y == 1:
            marked[held] += 1
    share = label.mean()
    seen = telling(often, marked, share, chance)
    seen &= marked - often * share >= least_z * np.sqrt(np.maximum(often * share * (1 - share), 1))
    if not seen.any():
        warnings.warn(f"no word tells the {int(label.sum())} positive of {len(label)} sampled documents from the others: nothing is learned",
                      stacklevel=2)
    weight = np.ones(len(label)) if weight is None else weight / weight.mean()
    place = np.where(seen, np.cumsum(seen), 0).astype(np.int32)   # 0: buckets that are left out
    size = np.concatenate(sizes)
    before = np.cumsum([0, *map(len, sizes)])
    kept = []
    for w, n, a in zip(words, sizes, before[:-1], strict=True):
        there = place[w] > 0
        kept.append((place[w[there]], np.repeat(np.arange(len(n), dtype=np.int32), n)[there] + a))
    word, sentence = (np.concatenate(x) for x in zip(*kept, strict=True))
    del kept
    document = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    n, positive = int(place.max()) + 2, label[document] == 1
    start = -6.0   # sentences are clean unless their words say otherwise

    def gradient(w: np.ndarray) -> np.ndarray:
        p = sigmoid(np.bincount(sentence, w[word], len(size)) + w[-1] + start)
        clean = (1 - leak) * np.exp(np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-12)), len(sizes)))[document]
        d = np.where(positive, -p * clean / np.maximum(1 - clean, 1e-9), p) * weight[document]
        g = np.bincount(word, d[sentence], n) + l2 * w
        g[0], g[-1] = 0, d.sum()
        return g / len(sizes)

    fitted = adam(gradient, n, steps=steps, rate=rate)
    return ToxicityModel(fitted[:-1][place] if n > 2 else np.zeros(1 << bits), float(fitted[-1] + start))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 2500, bits: int = 18, steps: int = 150,
                   rate: float = 0.2, l2: float = 0.1, leak: float = 0.05, chance: float = 100.0, least_z: float = 0.0,
                   label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled ids whose crc32 modulo 5 is not 0, rare labels first.

    The tasks hash the sample's words; the driver holds only their bucket numbers.
    Without labels of both kinds every sentence has probability 0; if no word tells
    them apart, a warning says so.
    """
    rows, weights = sample_by_label(docs, labels, label_col, sample_rows, id_col=id_col, text_col=text_col, keep=fold_of("id") != 0)

    @released
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                buckets, first, docs_at, *_ = sentence_words(part.column("text"), bits)
                words = [buckets[first[a]: first[b]].astype(np.int32).tobytes()
                         for a, b in zip(docs_at[:-1], docs_at[1:], strict=True)]
                sizes = [np.diff(first[a: b + 1]).astype(np.int32).tobytes()
                         for a, b in zip(docs_at[:-1], docs_at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(sizes, pa.binary()),
                                                  part.column("label")], ["words", "sizes", "label"])

    got = rows.select("text", "label").mapInArrow(hashed, "words binary, sizes binary, label int").toArrow()
    label = got.column("label").to_numpy().astype(float)
    words, sizes = ([np.frombuffer(x.as_buffer(), np.int32) for x in got.column(c)] for c in ("words", "sizes"))    # views, no copies
    if len(set(label)) < 2 or not sum(map(len, words)):
        return ToxicityModel(np.zeros(1 << bits), -40.0)
    model = fit_sentences(words, sizes, label, bits=bits, steps=steps, rate=rate, l2=l2, leak=leak, chance=chance, least_z=least_z,
                          weight=np.where(label == 1, weights[1], weights[0]))
    del got, words, sizes
    pa.default_memory_pool().release_unused()     # the driver goes on without the sample
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, id_col: str = "doc_id",
                   text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Add ``score``, ``predicted`` and ``offending`` to (id, text) of ``docs``.

    ``offending`` holds the sentences whose own probability reaches ``threshold``:
    (first byte, end byte, probability, text).  A null or empty text has no
    sentence, score 0 and predicted 0; repeated rows are scored each, equal texts alike; an empty
    table gives an empty result; other columns are ignored, unless ``row_col`` names a
    struct in which the whole row comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64()), ("text", pa.string())]))
    # by number, as names may be any; the text goes to the workers once
    beside = {c: f"c{i}" for i, c in enumerate(docs.columns if row_col else [id_col]) if c != text_col or not row_col}
    back = [*beside.values()] + ["text"] * bool(row_col)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                buckets, first, docs_at, start, stop, offsets = sentence_words(part.column("text"), bits)
                p = shared.value.probabilities(buckets, first)
                score = 1 - np.exp(np.bincount(owner(docs_at), np.log1p(-np.minimum(p, 1 - 1e-12)), len(part)))
                found = [[] for _ in range(len(part))]
                for s in np.flatnonzero(p >= threshold):
                    d = int(np.searchsorted(offsets, start[s], side="right")) - 1
                    a, b = int(start[s] - offsets[d]), int(stop[s] - offsets[d])
                    body = part.column("text")[d].as_py().encode()
                    found[d].append({"start": a, "stop": b, "probability": float(p[s]),
                                     "text": body[a:b].decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in back), pa.array(np.clip(score, 0, 1)), pa.array(found, spans)], [*back, "score", "offending"])

    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in beside.items()], F.col(f"`{text_col}`").alias("text"))
    span = StructType([StructField("start", LongType()), StructField("stop", LongType()),
                       StructField("probability", DoubleType()), StructField("text", StringType())])
    scored = rows.mapInArrow(run, StructType([*(StructField(c, rows.schema[c].dataType) for c in back),
                                              StructField("score", DoubleType()), StructField("offending", ArrayType(span))]))
    named = {c: F.col(beside.get(c, "text")).alias(c) for c in [id_col, *docs.columns]}
    whole = [F.struct(*[named[c] for c in docs.columns]).alias(row_col)] if row_col else []
    return scored.select(named[id_col], "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending", *whole)
