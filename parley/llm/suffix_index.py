"""Repeated byte strings with a logarithmic family of sparse suffix arrays.

*Suffixes.*  Of every ``length`` consecutive bytes the suffix with the smallest
hash of its first ``HEAD`` bytes is sampled, so equal strings of that length
sample the same suffix.  An entry is (head: that hash, context: a hash of all
bytes of the strings that sampled it, id, place).  A suffix array is a written
table of entries in the order of (head, context); hashes stand in for the bytes
when entries are ordered, as a scan needs only equal heads to meet.

*Family.*  Documents come in batches of ascending ids.  The entries of a batch are
merge-scanned against all levels in one sorted pass: an entry whose (head,
context) stands before it repeats earlier text throughout; a head with several
contexts is a match that ends nearby, and is settled byte by byte.  New entries
become a level; two levels of one rank are merged into one of the next, so n
batches leave about log2(n) levels.

*Skew.*  A task combines equal entries of a slice of texts before the shuffle, so
a head has one row per slice and context at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.arrays import doc_bytes, mix, owner, released, slices, span_hasher
from parley.llm.decontamination import stretches
from parley.plans.stages import materialize

#: Length of the string that names a sampled suffix.
HEAD = 24
#: A place is position * SPREAD ** 2 + strings before it * SPREAD + strings after it.
SPREAD = 1 << 10
#: Contexts of one head above which its strings are compared apart, each by its own hash.
MANY = 50_000


def _join(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15 + 2 * step)
    out[: max(len(a) - step, 0)] += b[step:]
    return out


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 = 8 + 8 + 8 bytes from each position on (near the end, of what is left)."""
    h = data.astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        h = _join(h, h, step)
    eight = mix(h)
    return mix(_join(mix(_join(eight, eight, 8)), eight, 16))


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the smallest of each ``w`` neighbours, by doubling."""
    best, span = np.arange(len(h)), 1
    while span < w and len(best):
        step = min(span, w - span)
        a, b = best[: max(len(best) - step, 0)], best[step:]
        best = np.where(h[b] < h[a], b, a)
        span += step
    return best


def sample_suffixes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, head, context, position, strings before, strings after) of the sampled suffixes.

    Strings before and after: how far the first and the last string that sampled
    the suffix start from its position, as (position - first, last - first).
    """
    h = head_hashes(data)
    anchor = sliding_argmin(h, length - HEAD + 1)
    start = np.arange(len(anchor))
    doc = owner(offsets)[: len(anchor)]
    whole = start + length <= offsets[doc + 1]
    start, anchor, doc = start[whole], anchor[whole], doc[whole]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    lo, hi, at = start[first], start[last], anchor[first]
    context = mix(span_hasher(data)(lo, hi + length) + mix((at - lo).astype(np.uint64)))
    return doc[first], h[at], context, at - offsets[doc[first]], at - lo, hi - lo


def entries(docs: DataFrame, length: int) -> DataFrame:
    """Entries of (id, text), with the places of equal ones in the same slice of texts as ``more``."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("id")
                doc, head, context, at, before, width = sample_suffixes(*doc_bytes(part.column("text")), length)
                place = (at * SPREAD + before) * SPREAD + width
                rank = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
                order = np.lexsort((place, rank[doc], context, head))
                doc, head, context, place = doc[order], head[order], context[order], place[order]
                own = rank[doc]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (head[1:] != head[:-1]) | (context[1:] != context[:-1])
                group = np.cumsum(fresh) - 1
                first = np.flatnonzero(fresh)
                # rows that repeat an id are at the same place: no earlier, no later
                later = ~fresh & ((own != own[first][group]) | (place != place[first][group])) if len(doc) else fresh
                k = np.flatnonzero(later)
                more = pa.StructArray.from_arrays([ids.take(pa.array(doc[k])), pa.array(place[k])], ["id", "place"])
                at_more = np.concatenate([[0], np.cumsum(np.bincount(group[k], minlength=len(first)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head[first].view(np.int64)), pa.array(context[first].view(np.int64)), ids.take(pa.array(doc[first])),
                     pa.array(place[first]), pa.ListArray.from_arrays(pa.array(at_more), more)],
                    ["head", "context", "id", "place", "more"])

    return docs.mapInArrow(run, f"head long, context long, id {kind}, place long, more array<struct<id:{kind},place:long>>")


class SuffixFamily:
    """Levels of entries, and the scans of the batches added so far."""

    def __init__(self, length: int):
        if not HEAD < length < SPREAD:
            raise ValueError(f"length must lie between {HEAD} and {SPREAD}")
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []   # (rank, entries), largest rank first
        self.scans: list[DataFrame] = []

    def add(self, batch: DataFrame, *, last: bool = False) -> DataFrame:
        """Scan a batch of (id, text), whose ids are larger than all before, and take it into the family.

        Returns the written scan: entries with ``first`` (none like it before), ``old``
        (of a level, met by the batch) and ``several`` (its head has several contexts).
        After the ``last`` batch no level is made.
        """
        columns = ["head", "context", "id", "place"]
        made = entries(batch, self.length).withColumn("old", F.lit(False))
        for _, level in self.levels:
            made = made.unionByName(level.select(*columns, F.lit(True).alias("old")), allowMissingColumns=True)
        alike = Window.partitionBy("head", "context").orderBy("id", "place")
        head = Window.partitionBy("head")
        scan = made.repartition("head").withColumn("first", F.rank().over(alike) == 1).withColumn(
            "several", F.min("context").over(head) != F.max("context").over(head))
        new = ~F.col("old")
        telling = new & (~F.col("first") | (F.size("more") > 0)) | F.col("first") & F.col("several")
        scan = materialize(scan.where(telling if last else telling | new), "suffix-scan")
        self.scans.append(scan)
        if not last:
            self.levels.append((0, scan.where("first AND NOT old").select(*columns)))
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
                merged = a.unionAll(b).repartition("head").sortWithinPartitions("head", "context")
                self.levels.append((rank + 1, materialize(merged, "suffix-level")))
        return scan

    def covered(self, docs: DataFrame) -> DataFrame:
        """(id, start, stop): byte ranges of all texts added, ``docs``, whose strings start earlier elsewhere."""
        kind = docs.schema["id"].dataType.simpleString()
        scans = self.scans[0]
        for scan in self.scans[1:]:
            scans = scans.unionByName(scan)
        new = scans.where("NOT old")
        whole = new.where("NOT first").select("id", "place").unionAll(
            new.where(F.size("more") > 0).select(F.explode("more").alias("m")).select("m.id", "m.place"))
        lo = F.floor(F.col("place") / SPREAD / SPREAD) - F.floor(F.col("place") / SPREAD) % SPREAD
        whole = whole.select("id", lo.alias("start"), (lo + F.col("place") % SPREAD + self.length).alias("stop"))

        asked = materialize(scans.where("first AND several").select("head", "id", "place").distinct(), "suffix-asked")
        many = asked.groupBy("head").count().where(F.col("count") > MANY).select("head", F.lit(True).alias("many"))
        asked = asked.join(many, "head", "left").groupBy("id").agg(
            F.collect_list(F.struct("head", "place", F.coalesce("many", F.lit(False)).alias("many"))).alias("asked"))   # of one text
        met = compressed(docs).join(asked, "id")
        strings = met.mapInArrow(_contexts(self.length), f"head long, id {kind}, start long, body binary")
        strings = strings.repartition("head").sortWithinPartitions("head", "id", "start")
        return whole.unionAll(strings.mapInArrow(_repeats(self.length), f"id {kind}, start long, stop long"))


def compressed(docs: DataFrame) -> DataFrame:
    """(id, text as a zstd frame), for texts that have to be shuffled."""
    kind = docs.schema["id"].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_binary()), b"")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([pack(x.as_py()) for x in texts], pa.binary())], ["id", "frame"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, frame binary")


def _contexts(length: int):
    """Per asked entry, the bytes of its strings; of a head with many contexts, each string by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                data = unpack(batch.column("frame")[row].as_py())
                asked = batch.column("asked")[row].values
                head, place, many = (np.asarray(asked.field(k)) for k in range(3))
                at, before, width = place // SPREAD // SPREAD, place // SPREAD % SPREAD, place % SPREAD
                lo = at - before
                if many.any():
                    n = width[many] + 1
                    own = np.repeat(lo[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hashes = span_hasher(np.frombuffer(data, np.uint8))(own, own + length).view(np.int64)
                    head, lo = np.concatenate([head[~many], hashes]), np.concatenate([lo[~many], own])
                    width = np.concatenate([width[~many], np.zeros(len(own), width.dtype)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head), batch.column("id").take(pa.array(np.full(len(head), row))), pa.array(lo),
                     pa.array([data[a:b] for a, b in zip(lo, lo + width + length, strict=True)], pa.binary())], ["head", "id", "start", "body"])

    return run


def _repeats(length: int):
    """Of contexts in the order of (head, id, start): the ranges whose strings have come before under their head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.zeros(0, np.uint64)   # the head that the previous batch ended with, and its strings
        before = (None, None, None)
        for batch in batches:
            where = [np.asarray(batch.column(c)) for c in ("head", "id", "start")]
            fresh = np.ones(batch.num_rows, bool)   # rows that repeat an id have been joined with its places each
            if batch.num_rows:
                fresh[0] = tuple(w[0] for w in where) != before
                fresh[1:] = np.any([w[1:] != w[:-1] for w in where], axis=0)
                before = tuple(w[-1] for w in where)
            for part in slices(batch.filter(pa.array(fresh)), "body"):
                data, offsets = doc_bytes(part.column("body"))
                head = np.asarray(part.column("head"))
                n = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(n)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + inner
                key = mix(span_hasher(data)(at, at + length) + mix(head.view(np.uint64))[row])
                again = np.ones(len(key), bool)
                again[np.unique(key, return_index=True)[1]] = False
                if last is not None:
                    again |= (head[row] == last) & np.isin(key, seen)
                final = key[head[row] == head[-1]]
                seen = np.unique(np.concatenate([seen, final]) if head[-1] == last else final)
                last = head[-1]
                k = np.flatnonzero(again)
                if len(k):   # runs of neighbouring strings of one row
                    new = np.ones(len(k), bool)
                    new[1:] = (np.diff(k) != 1) | (row[k[1:]] != row[k[:-1]])
                    a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(k)) - 1
                    start = np.asarray(part.column("start"))[row[k[a]]] + inner[k[a]]
                    stop = start + (k[b] - k[a]) + length
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[k[a]])), pa.array(start), pa.array(stop)],
                                                     ["id", "start", "stop"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = 100, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row, without the bytes repeated from before.

    A byte goes if a ``length``-byte string of its own text that covers it also
    starts earlier: in a text of a smaller id, or further ahead in the same one.
    Texts are UTF-8 bytes, a null text is empty; ``kept`` holds the bytes that
    remain.  Rows that repeat an id stand at the same place in the order, so neither
    repeats the other; a row without an id takes no part and keeps its bytes.  An
    empty table gives an empty result; other columns are ignored.  Ids are integers;
    they are dealt into ``batches`` ranges of about equal counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rows.where("id IS NOT NULL")
    cuts = known.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    family = SuffixFamily(length)
    for i in range(len(cuts) + 1):
        part = known.where(F.col("id") > cuts[i - 1]) if i else known
        family.add(part.where(F.col("id") <= cuts[i]) if i < len(cuts) else part, last=i == len(cuts))
    ranges = family.covered(known).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))   # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                data = unpack(batch.column("frame")[row].as_py())
                found = batch.column("ranges")[row].values
                spans = stretches([np.stack([np.asarray(found.field(0)), np.asarray(found.field(1))], axis=1)] if found is not None else [])
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    met = compressed(rows).join(ranges, "id", "left")
    out = met.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
