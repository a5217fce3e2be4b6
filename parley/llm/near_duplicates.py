"""Near duplicates by HyperMinHash sketches, banding, estimation and exact verification.

A document is the set of its word shingles.  The shingles' hashes fall into
``BUCKETS`` buckets; of the smallest hash in a bucket a 16-bit register keeps the
count of leading zeros (6 bits) and the 10 bits that follow (its mantissa).
Equal sets form one class, and only class representatives go on.  Bands of as many
registers as the threshold allows name candidate groups; in a group every class is compared with the
group's head, and only classes that this does not link are compared with
others, so a large group of near copies costs one comparison each.  Pairs whose
collision-corrected register estimate is far below the threshold are dropped;
the rest are verified on the full sets.

In the groups of more than ``MANY`` classes, shingles that at most ``RARE`` such classes
have are counted first.  A class with few of them heads its group.  Two classes that have no rare
shingle in common share no more than their other shingles; classes with a rare shingle in common are
found by that shingle, in whichever band they stand.

There, too, each class x keeps its difference from the head h: the number of shingles that only one of
the two has, and a bitmap of their hashes.  As |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)|, two
classes must have much of their differences in common to be linked, and a bit that only one bitmap has
stands for a shingle that is not in common.  The bound is exact, so it drops no link; it settles the
comparisons of copies edited in different places inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import BLANK_SPLIT, LOWER, doc_bytes, mix, owner, released, slices, span_hashes, word_spans
from parley.llm.components import components
from parley.llm.quality import grams
from parley.llm.suffix_index import compressed
from parley.plans.stages import materialize

BUCKETS = 128
MANTISSA = 10
#: Share of the pairs at the threshold that may stand together in no band.
MISSED = 1e-6
#: How far below the threshold an estimate may lie, in standard deviations.
SIGMAS = 5.0
#: Classes in a band above which their rare shingles are counted.
MANY = 32
#: Classes that may hold a rare shingle.
RARE = 4
#: Words of 64 bits in the bitmap of a difference.
WORDS = 8
#: Bytes of text shingled at once: a worker needs many times as much.
SLICE_BYTES = 1 << 19


def band_rows(least: float) -> int:
    """Registers of a band: the most with which pairs at ``least`` miss all bands with a chance of ``MISSED`` or less."""
    fits = [r for r in range(1, 17) if (1 - least ** r) ** (BUCKETS // r) <= MISSED]
    return max(fits, default=1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in ascending order, offsets with n+1 entries).

    Words are what stands between blanks, with A-Z lower-cased; a text of fewer
    than ``k`` words, but not none, has its whole sequence as one shingle.
    """
    data, offsets = doc_bytes(texts)
    starts, ends, first = word_spans(data, offsets, BLANK_SPLIT)
    words = span_hashes(LOWER[data], starts, ends)
    hashes, at = grams(words, first, k)
    counts = np.diff(first)
    doc = owner(at)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):   # the number of words goes in, so this equals no shingle of k words
        whole = mix(counts[short].astype(np.uint64) + np.uint64(1 << 40))
        for i in range(k - 1):
            more = counts[short] > i
            whole[more] = mix(whole[more] * np.uint64(5) + words[first[short[more]] + i])
        hashes, doc = np.append(hashes, whole), np.append(doc, short)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, BUCKETS) registers of the sets; 0 for an empty bucket."""
    n = len(at) - 1
    low = np.full(n * BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    mixed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = owner(at) * BUCKETS + (mixed >> np.uint64(57)).astype(np.int64)
    rest = mixed << np.uint64(7)                      # 57 bits, then zeros
    order = np.lexsort((rest, cell))
    head = np.ones(len(order), bool)
    head[1:] = cell[order][1:] != cell[order][:-1]
    low[cell[order][head]] = rest[order][head]
    filled = np.zeros(n * BUCKETS, bool)
    filled[cell] = True
    # leading zeros from the exponent of the float just below (exact on the upper 53 bits)
    top = (low >> np.uint64(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 56).astype(np.uint64)
    body = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    code = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | body
    return np.where(filled, code, 0).astype(np.uint16).reshape(n, BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, buckets it rests on) of register rows.

    Of the buckets that are filled on either side, unequal minima still get equal
    registers with a chance of about 2 ** -(MANTISSA + 1) for each; that share is
    taken out of the equal ones.
    """
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    share = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1)
    chance = 2.0 ** -(MANTISSA + 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), filled


def plausible(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate lies less than SIGMAS deviations below ``least``."""
    value, n = estimate(a, b)
    return value >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(n, 1))


def sketches(docs: DataFrame, k: int, *, id_col: str, text_col: str) -> DataFrame:
    """Written table of each row's id, n_shingles, signature of the whole set, registers and bits.

    The signature (128 bits) is equal for equal sets.  ``bits0`` and ``bits1`` hold
    the last mantissa bit of every register: unequal registers differ in it half
    of the time, so a bit count bounds the similarity inside a join condition.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                hashes, at = shingle_sets(part.column("text"), k)
                signature = []
                for salt in (3, 5):   # sums of mixed hashes do not depend on the order
                    sums = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mix(hashes + np.uint64(salt)), out=sums[1:])
                    signature.append(sums[at[1:]] - sums[at[:-1]])
                rows = registers(hashes, at)
                bits = np.packbits((rows & 1).astype(bool), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(at)), pa.array([x.tobytes() for x in np.stack(signature, axis=1)], pa.binary()),
                     pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                    ["id", "n_shingles", "signature", "registers", "bits0", "bits1"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, f"id {kind}, n_shingles long, signature binary, registers binary, bits0 long, bits1 long")
    return materialize(made, "sketches")


def band_members(classes: DataFrame, width: int) -> DataFrame:
    """Written table (band, id, n) of the bands of ``width`` registers that n > 1 classes share.

    A band of empty registers says nothing and is left out.
    """
    kind = classes.schema["id"].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            rows = rows[:, : BUCKETS // width * width].reshape(len(rows), -1, width).astype(np.uint64)
            key = np.broadcast_to(mix(np.arange(rows.shape[1], dtype=np.uint64)), rows.shape[:2])
            for i in range(width):
                key = mix(key + rows[..., i])
            doc, band = np.nonzero(rows.any(axis=2))
            yield pa.RecordBatch.from_arrays([pa.array(key[doc, band].view(np.int64)), batch.column(0).take(pa.array(doc))], ["band", "id"])

    bands = classes.select("id", "registers").mapInArrow(run, f"band long, id {kind}")
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    return materialize(bands.join(shared, "band"), "band-members")


def rare_shingles(texts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Written tables (id, own) and (a, b, common): rare shingles of each text, and those that two texts have in common.

    Rare is what ``RARE`` texts or fewer hold, so a shingle brings together a few texts at most.
    """
    kind = texts.schema["id"].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked(batch):
                hashes, at = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner(at))), pa.array(hashes.view(np.int64))], ["id", "shingle"])

    rows = texts.mapInArrow(run, f"id {kind}, shingle long")
    held = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).where(F.col("n") <= RARE)
    held = materialize(held, "rare-shingles")
    few = rows.join(held.where("n > 1").select("shingle"), "shingle")
    few = materialize(few.groupBy("shingle").agg(F.sort_array(F.collect_list("id")).alias("ids")), "shared-rare")
    own = held.where("n = 1").select("id").unionAll(few.select(F.explode("ids"))).groupBy("id").agg(F.count("*").alias("own"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, RARE), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    common = few.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("common"))
    return materialize(own, "rare-counts"), materialize(common, "rare-pairs")


def unpacked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, text) of a batch of (id, zstd frame), ``SLICE_BYTES`` at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts, first, held = [], 0, 0
    for i, frame in enumerate(batch.column("frame")):
        texts.append(unpack(frame.as_py()))
        held += len(texts[-1])
        if held > SLICE_BYTES or i + 1 == batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), pa.array(texts, pa.binary())], ["id", "text"])
            texts, first, held = [], i + 1, 0


def plausible_pairs(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Written table of the distinct pairs (a, b) whose sizes and estimate allow a similarity of ``least``."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    kind = classes.schema["id"].dataType.simpleString()
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
                yield batch.filter(pa.array(plausible(left, right, least))).select(["a", "b"])

    return materialize(joined.select("a", "b", "ra", "rb").mapInArrow(run, f"a {kind}, b {kind}"), "plausible")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Written table of the pairs (a, b) with 100 * intersection >= ``percent`` * union of their full sets.

    ``texts`` has the columns id and frame.  Texts travel, not sets (they compress);
    a task keeps the set of the last left text, as many rows may share it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    asked = materialize(texts.join(wanted, "id", "left_semi"), "pair-texts")
    side = lambda x: asked.select(F.col("id").alias(x), F.col("frame").alias(f"f{x}"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        members = lambda frame: shingle_sets(pa.array([unpack(frame)], pa.binary()), k)[0]
        held, left = None, None
        for batch in batches:
            linked = []
            for i in range(batch.num_rows):
                frame = batch.column(2)[i].as_py()
                if frame != held:
                    held, left = frame, members(frame)
                right = members(batch.column(3)[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")
    return materialize(joined.mapInArrow(run, f"a {kind}, b {kind}"), "verified")


def differences(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Written table (id, head, linked, apart, d0 ...) of the pairs (id, head), compared on their full sets.

    ``apart`` is the number of shingles that only one of the two has, ``d0`` ... the
    bitmap of their hashes.  A task keeps the set of the last head, as many rows share it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    bits = [f"d{i}" for i in range(WORDS)]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, left = None, None
        for batch in batches:
            done, linked, apart, maps = 0, [], [], []
            for part in unpacked(batch):
                hashes, at = shingle_sets(part.column("text"), k)
                for i in range(part.num_rows):
                    frame = batch.column("headed")[done + i].as_py()
                    if frame != held:
                        held, left = frame, shingle_sets(pa.array([unpack(frame)], pa.binary()), k)[0]
                    right = hashes[at[i]: at[i + 1]]
                    only = np.setxor1d(left, right, assume_unique=True)
                    bitmap = np.zeros(64 * WORDS, bool)
                    bitmap[(mix(only) % np.uint64(64 * WORDS)).astype(np.int64)] = True
                    linked.append((100 + percent) * len(only) <= (100 - percent) * (len(left) + len(right)))
                    apart.append(len(only))
                    maps.append(np.packbits(bitmap).view(np.int64))
                done += part.num_rows
            if done:
                maps = np.stack(maps)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("head"), pa.array(linked), pa.array(apart, pa.int64()),
                                                  *(pa.array(maps[:, i]) for i in range(WORDS))], ["id", "head", "linked", "apart", *bits])

    heads = texts.select(F.col("id").alias("head"), F.col("frame").alias("headed"))
    joined = pairs.join(texts, "id").join(heads, "head").select("id", "head", "frame", "headed")
    made = joined.mapInArrow(run, f"id {kind}, head {kind}, linked boolean, apart long, " + ", ".join(f"{b} long" for b in bits))
    return materialize(made, "differences")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets
    of ``k``-word shingles; component_id is the smallest id reachable over links,
    kept marks it.  Texts without words have an empty set and are linked with
    nothing.  Rows that repeat an id count as one document; a null id is linked
    with nothing, has no component and is kept.  An empty table gives an empty
    result; other columns are ignored.

    With b bands of r registers a pair at the threshold s shares a band with probability
    1 - (1 - s^r)^b; r is chosen from s (``band_rows``): 32 bands of 4 at 0.8, which all but 5e-8
    of its pairs share, 25 bands of 5 at 0.85 (all but 4e-7).
    """
    least = percent / 100
    rows = sketches(docs, k, id_col=id_col, text_col=text_col)
    classes = rows.where("n_shingles > 0 AND id IS NOT NULL").groupBy("signature", "n_shingles").agg(
        F.min("id").alias("id"), F.first("registers").alias("registers"), F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"))
    classes = materialize(classes, "classes")
    members = band_members(classes, band_rows(least))
    texts = compressed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    texts = materialize(texts.join(members.select("id").distinct(), "id", "left_semi"), "member-texts")
    in_many = members.where(F.col("n") > MANY).select("id").distinct()
    own, common = rare_shingles(texts.join(in_many, "id", "left_semi"), k)
    known = classes.select("id", "n_shingles", "bits0", "bits1").join(own, "id", "left").fillna(0, ["own"])
    known = materialize(known.join(members.select("id").distinct(), "id", "left_semi"), "known-members")
    told = materialize(members.join(known, "id"), "told-members")
    place = F.struct("own", "id", "n_shingles", "bits0", "bits1")
    heads = materialize(told.groupBy("band").agg(F.min(place).alias("top")), "band-heads")
    told = materialize(told.join(heads, "band").withColumn("head", F.col("top.id")), "headed-members")

    def may_link(x: str, y: str, shared: Column = F.lit(0)):
        """What sizes, sketch bits and rare shingles of two members allow, of which ``shared`` are common."""
        nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
        differ = F.bit_count(F.col(f"{x}.bits0").bitwiseXOR(F.col(f"{y}.bits0"))) + F.bit_count(F.col(f"{x}.bits1").bitwiseXOR(F.col(f"{y}.bits1")))
        half = BUCKETS * (1 - least) / 2
        most = F.least(nx - F.col(f"{x}.own"), ny - F.col(f"{y}.own")) + shared
        return ((100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (differ <= half + (SIGMAS + 1) * half ** 0.5),
                (100 + percent) * most >= percent * (nx + ny))

    def near_enough(x: str, y: str):
        """What the differences of two members from their head allow."""
        alone = lambda p, q: sum((F.bit_count(F.col(f"{p}.d{i}").bitwiseAND(F.bitwise_not(F.col(f"{q}.d{i}")))) for i in range(1, WORDS)),
                                 F.bit_count(F.col(f"{p}.d0").bitwiseAND(F.bitwise_not(F.col(f"{q}.d0")))))
        dx, dy = F.col(f"{x}.differ"), F.col(f"{y}.differ")
        # at least so many shingles of one difference are not in the other
        least_apart = F.greatest(dx - dy + 2 * alone(y, x), dy - dx + 2 * alone(x, y))
        return (100 + percent) * least_apart <= (100 - percent) * (F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles"))

    def in_band(x: str, y: str):
        alike, enough = may_link(x, y)
        return alike & ((F.col("x.n") <= MANY) | (enough & near_enough(x, y)))

    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    # a member stands beside its head already, so this is no join
    beside = told.where(F.col("id") != F.col("head"))
    first = beside.alias("x").where((F.col("x.n") <= MANY) & may_link("x", "x.top")[0])
    first = first.select(F.least("x.id", "x.head").alias("a"), F.greatest("x.id", "x.head").alias("b"))
    rare = common.join(known.select(F.col("id").alias("a"), F.struct("*").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.struct("*").alias("y")), "b")
    alike, enough = may_link("x", "y", F.col("common"))
    links = verify(plausible_pairs(first.unionAll(rare.where(alike & enough).select("a", "b")), classes, least), texts, k, percent)
    differ = differences(beside.where(F.col("n") > MANY).select("id", "head").distinct(), texts, k, percent)
    links = links.unionAll(differ.where("linked").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")))

    # What its head does not link is compared with the members of other components in its band.
    part = materialize(components(links), "first-components")
    shown = differ.drop("linked").withColumnRenamed("apart", "differ").dropDuplicates(["id", "head"])
    told = told.join(shown, ["id", "head"], "left").fillna(0, ["differ", *[f"d{i}" for i in range(WORDS)]])
    placed = told.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    placed = materialize(placed.join(part.select(F.col("node").alias("head"), F.col("component").alias("hc")), "head", "left")
                         .withColumn("apart", F.col("part") != F.coalesce("hc", "head")).drop("hc"), "placed-members")
    rest = placed.where("apart").alias("x").join(placed.where("id <> head").alias("y"), (F.col("x.band") == F.col("y.band")) & (
        F.col("x.part") != F.col("y.part")) & (~F.col("y.apart") | (F.col("x.id") < F.col("y.id"))) & in_band("x", "y"))
    links = links.unionAll(verify(plausible_pairs(rest.select(*pair), classes, least), texts, k, percent))

    part = materialize(components(links), "components")
    mapped = classes.select("signature", "n_shingles", F.col("id").alias("node")).join(part, "node", "left")
    mapped = materialize(mapped.select("signature", "n_shingles", F.coalesce("component", "node").alias("component")), "class-components")
    out = rows.select("id", "n_shingles", "signature").join(mapped, ["signature", "n_shingles"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"),
                      F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
