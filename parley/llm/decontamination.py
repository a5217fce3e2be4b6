"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: each shard (a few megabytes of texts) stores
the sorted distinct tokens of its documents, and for each token the ascending
list of its positions, where a position counts the shard's words; a gap between
documents keeps phrases from crossing.  A search takes the collection frequency
of the test terms from the index, and in each shard intersects the lists of a
phrase, each shifted back by its term's offset, from the rarest term on.  Shards
are rows of a table: they are searched where they lie, and a lost one is rebuilt
from its texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import LOWER, byte_mask, doc_bytes, released, slices, span_hashes, word_spans
from parley.plans.stages import materialize

#: Words, after A-Z are lower-cased: digits, letters and every byte of other scripts.
WORD = byte_mask(drop=[(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Positions left free between documents; no phrase or span may be longer.
GAP = 1 << 10
ARRAYS = {"tokens": np.uint64, "lists": np.int32, "positions": np.uint32, "doc_start": np.int64, "doc_words": np.int64}


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text with n+1 entries)."""
    data, offsets = doc_bytes(texts)
    lower = LOWER[data]
    starts, ends, first = word_spans(lower, offsets, WORD)
    return span_hashes(lower, starts, ends), first


@dataclass
class Shard:
    """One row of the index."""

    tokens: np.ndarray      # distinct tokens, ascending
    lists: np.ndarray       # start of each token's list in positions, n+1 entries
    positions: np.ndarray
    doc_start: np.ndarray   # position of each document's first word
    doc_words: np.ndarray

    def postings(self, token: int) -> np.ndarray:
        k = int(np.searchsorted(self.tokens, token))
        if k == len(self.tokens) or self.tokens[k] != token:
            return self.positions[:0].astype(np.int64)
        return self.positions[self.lists[k]: self.lists[k + 1]].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, side="right") - 1


def build_shard(texts: pa.Array) -> Shard:
    words, first = tokens_of(texts)
    counts = np.diff(first)
    doc_start = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    position = np.arange(len(words)) + np.repeat(np.arange(len(counts)) * GAP, counts)
    if len(position) and position[-1] >= 1 << 32:
        raise ValueError("too many words for one shard: lower shard_bytes")
    order = np.argsort(words, kind="stable")
    tokens, lists = np.unique(words[order], return_index=True)
    return Shard(tokens, np.append(lists, len(words)), position[order].astype(np.uint32), doc_start, counts)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """The index as a written table: one row per shard with its name, ids and packed arrays.

    Null texts have no words.  A shard holds ``shard_bytes`` of text or one longer text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                shard = build_shard(part.column("text"))
                row = {name: [getattr(shard, name).astype(t).tobytes()] for name, t in ARRAYS.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([part.column("id").to_pylist()], pa.list_(part.column("id").type)),
                     *(pa.array(row[name], pa.binary()) for name in ARRAYS)], ["shard", "ids", *ARRAYS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, f"shard string, ids array<{kind}>, " + ", ".join(f"{n} binary" for n in ARRAYS)), "positional-index")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            values = {n: np.frombuffer(batch.column(batch.schema.get_field_index(n))[i].as_py(), t) for n, t in ARRAYS.items()}
            yield batch.column(0)[i].as_py(), batch.column(1)[i].values, Shard(**values)


@dataclass(frozen=True)
class Phrase:
    """The tokens of one benchmark item."""

    item: object
    tokens: np.ndarray


def term_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences in the whole corpus of each test term, read off the list lengths."""
    wanted = index.sparkSession.sparkContext.broadcast(np.unique(terms))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lists = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((0, np.uint64), (1, np.int32)))
                _, here, there = np.intersect1d(tokens, wanted.value, assume_unique=True, return_indices=True)
                total[there] += np.diff(lists)[here]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[k].view(np.int64)), pa.array(total[k])], ["term", "n"])

    rows = index.select("tokens", "lists").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r.term).view(np.uint64)): r.n for r in rows}   # at most as many rows as test terms


def rare_pivots(tokens: np.ndarray, frequency: dict[int, int], window: int) -> list[int]:
    """Offsets of rarest terms such that every window holds one; none if a window holds a term that never occurs."""
    n = np.array([frequency.get(int(t), 0) for t in tokens])
    size = min(window, len(tokens))
    out = []
    for a in range(len(tokens) - size + 1):
        rarest = a + int(np.argmin(n[a: a + size]))
        if n[rarest] and not (out and out[-1] >= a and n[out[-1]] == n[rarest]):
            out.append(rarest)
    return sorted(set(out))


def window_hits(shard: Shard, tokens: np.ndarray, pivots: list[int], frequency: dict[int, int], window: int) -> list[np.ndarray]:
    """Position ranges (start, end) of the shard that equal ``window`` consecutive tokens (or all, if fewer)."""
    size = min(window, len(tokens))
    found = []
    for p in pivots:
        starts = shard.postings(int(tokens[p])) - p     # where the item's first word would stand
        if not len(starts):
            continue
        lo, hi = max(0, p - size + 1), min(len(tokens), p + size)
        near = sorted((q for q in range(lo, hi) if q != p), key=lambda q: (frequency.get(int(tokens[q]), 0), abs(q - p)))
        left, right = np.full(len(starts), lo - 1), np.full(len(starts), hi)   # nearest terms that differ
        alive = np.arange(len(starts))
        for q in near:
            if not len(alive):
                break
            postings = shard.postings(int(tokens[q]))
            want = starts[alive] + q
            at = np.searchsorted(postings, want)
            same = np.zeros(len(alive), bool)
            inside = at < len(postings)
            same[inside] = postings[at[inside]] == want[inside]
            failed = alive[~same]
            if q < p:
                left[failed] = np.maximum(left[failed], q)
            else:
                right[failed] = np.minimum(right[failed], q)
            alive = alive[right[alive] - left[alive] - 1 >= size]   # else no window around the pivot is left
        run = right - left - 1 >= size
        found += [np.stack([starts[run] + left[run] + 1, starts[run] + right[run]], axis=1)]
    return found


def stretches(found: list[np.ndarray]) -> np.ndarray:
    """Overlapping or touching ranges (start, end) merged into maximal ones."""
    ranges = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    if not len(ranges):
        return ranges
    furthest = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.concatenate([[True], ranges[1:, 0] > furthest[:-1]]))
    return np.stack([ranges[first, 0], furthest[np.append(first[1:], len(ranges)) - 1]], axis=1)


def decontaminate(index: DataFrame, items: list[Phrase], *, window: int = 13, share: int = 20, block: int = 2000,
                  id_col: str = "doc_id") -> DataFrame:
    """One row per indexed document: n_words, n_hit, n_items, items (sorted as strings) and contaminated.

    A word is hit if it stands inside an occurrence of ``window`` consecutive words
    of an item (of all its words, if it has fewer); contaminated means n_hit > 0 and
    ``share`` * n_hit >= n_words.  Items go to the shards in blocks of ``block``,
    so what is sent at once is bounded; each block reads the whole index.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    items = [x for x in items if len(x.tokens)]
    frequency = term_frequencies(index, np.concatenate([x.tokens for x in items])) if items else {}
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    hits = None
    for a in range(0, max(len(items), 1), block):
        part = [(x.item, x.tokens, rare_pivots(x.tokens, frequency, window)) for x in items[a: a + block]]
        part = [x for x in part if x[2]]
        terms = {int(t): frequency.get(int(t), 0) for _, tokens, _ in part for t in tokens}
        shared = spark.sparkContext.broadcast((part, terms))

        @released
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, terms = shared.value
            for name, ids, shard in _shards(batches):
                found, named = [], [set() for _ in range(len(ids))]
                for item, tokens, pivots in phrases:
                    for hit in window_hits(shard, tokens, pivots, terms, window):
                        found.append(hit)
                        for d in np.unique(shard.document(hit[:, 0])):
                            named[d].add(item)
                ranges = [[] for _ in range(len(ids))]
                for start, stop in stretches(found):
                    d = int(shard.document(start))
                    ranges[d].append({"start": int(start - shard.doc_start[d]), "stop": int(stop - shard.doc_start[d])})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids)), pa.array(np.arange(len(ids))), ids, pa.array(shard.doc_words),
                     pa.array(ranges, span),
                     pa.array([sorted(x) for x in named], pa.list_(pa.string()))],
                    ["shard", "place", "id", "n_words", "ranges", "items"])

        one = index.mapInArrow(run, f"shard string, place long, id {kind}, n_words long, "
                                    "ranges array<struct<start:long,stop:long>>, items array<string>")
        hits = one if hits is None else hits.unionAll(one)
    if len(items) > block:   # each block gave a row per document
        hits = hits.groupBy("shard", "place").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # ranges are sorted by start: add what each reaches beyond the furthest end so far
    zero = F.lit(0).cast("long")
    covered = F.aggregate("ranges", F.struct(zero.alias("n"), zero.alias("end")), lambda acc, r: F.struct(
        (acc["n"] + F.greatest(zero, r["stop"] - F.greatest(acc["end"], r["start"]))).alias("n"),
        F.greatest(acc["end"], r["stop"]).alias("end")), lambda acc: acc["n"])
    out = hits.select(F.col("id").alias(id_col), "n_words", covered.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), "items", "ranges")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def read_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> list[Phrase]:
    """The benchmark's rows on the driver, as the stated set of queries; a null id is written as an empty string."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).toArrow()
    out = []
    for batch in rows.to_batches():
        words, first = tokens_of(batch.column(1))
        out += [Phrase(i, words[a:b]) for i, a, b in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True)]
    return sorted(out, key=lambda x: (x.item, x.tokens.tobytes()))


def proximity_matches(index: DataFrame, terms: list[str], *, span: int, id_col: str = "doc_id") -> DataFrame:
    """(id, first word, end word) of the shortest stretches of at most ``span`` words that hold all ``terms``.

    Order is free; a term given twice counts once; a stretch that contains a
    shorter one is not returned.  Around each occurrence of the rarest term the
    other terms' lists are cut to its neighbourhood before they are merged.
    """
    if span > GAP:
        raise ValueError(f"span may be {GAP} words at most")
    kind = index.schema["ids"].dataType.elementType.simpleString()
    tokens = np.unique(tokens_of(pa.array(terms))[0])
    if not len(tokens):
        raise ValueError("no term has a word")
    frequency = term_frequencies(index, tokens)
    wanted = sorted((int(t) for t in tokens), key=lambda t: frequency.get(t, 0))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, shard in _shards(batches):
            pivots = shard.postings(wanted[0])
            events = [(int(x), 0) for x in pivots]
            for k, t in enumerate(wanted[1:], 1):
                near = shard.postings(t)
                right = np.searchsorted(pivots, near)
                close = np.zeros(len(near), bool)
                for at in (right - 1, right):
                    ok = (at >= 0) & (at < len(pivots))
                    close[ok] |= np.abs(near[ok] - pivots[at[ok]]) < span
                events += [(int(x), k) for x in near[close]]
            last: dict[int, int] = {}
            found = []
            for x, k in sorted(events):
                last[k] = x
                if len(last) == len(wanted) and x - (a := min(last.values())) < span:
                    if not found or found[-1][0] < a:
                        found.append((a, x + 1))
            document = shard.document(np.array([a for a, _ in found], np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(document)), pa.array([int(a - shard.doc_start[d]) for (a, _), d in zip(found, document, strict=True)], pa.int64()),
                 pa.array([int(b - shard.doc_start[d]) for (_, b), d in zip(found, document, strict=True)], pa.int64())], ["id", "start", "stop"])

    return index.mapInArrow(run, f"id {kind}, start long, stop long").withColumnRenamed("id", id_col)
