"""Byte-level BPE with Spark higher-order functions.

Texts are cut into words by the vocabulary's pattern, and each distinct word of the
corpus is folded once.  A word is a string with one character for each of its tokens, at
first its bytes, beside a string of the pairs' ranks; a fold merges the leftmost adjacent
pair of lowest rank until none has one.  Strings are cut and joined natively, where arrays
would be copied at each step.  Ranks come from a one-row table, read by a scalar subquery
(a literal would stand in each text of the plan): an array of small maps by hash, as Spark
searches a map from its start.  Decoding looks up the piece of each id and concatenates the bytes.

Around the fold: a task cuts its texts into words chunk by chunk, and writes the texts as
numbers of the chunk's distinct words, and those by hash bucket.  Buckets bring the equal
words of all chunks together; the first of each is folded, the others take its ids.  The
ids go back to their chunk, whose texts are put together from them.  So what is
shuffled is a chunk's distinct words and their ids, not its occurrences: the texts are
written in buckets by chunk and stay there.

Words of more than ``FOLD_BYTES`` bytes are merged by a heap where they are found: a fold
copies its strings at each merge.  Both give the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from parley.llm.arrays import give_back, released
from parley.session import scratch_path

RANK_MAPS = 1 << 16
#: Longest word, in bytes, that is folded.
FOLD_BYTES = 128
#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK = 24 << 20
#: Distinct words of a chunk are below 2^24.
_BITS = 24
#: Hash buckets in which equal words meet.
BUCKETS = 1 << 10
# What Unicode calls white space.
_BLANKS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# A token is written as the character of its id, from the first plane above the words' own Latin-1 on.
_FIRST = 0x10000
#: Rank of a pair that is no token: above all.
_NONE = chr(0x10FFFF)
#: Stands around a word and has no rank with anything.
_EDGE = " "
_LATIN = "".join(map(chr, range(256)))


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) of each token of a ``tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _with_blanks(pattern: str) -> str:
    """The pattern with Unicode's blanks spelt out: Python counts four separators more."""
    out, inside = "", False
    for part in regex.findall(r"\\.|.", pattern, regex.DOTALL):
        if part in (r"\s", r"\S"):
            if inside and part == r"\S":
                raise ValueError("\\S inside a class is not supported")
            part = _BLANKS if inside else f"[{'^' if part == r'\S' else ''}{_BLANKS}]"
        elif part in "[]":
            inside = part == "["
        out += part
    return out


def _literal(value: object, kind: str) -> Column:
    """A literal of any type: a constant expression, which the optimizer evaluates once."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


def _place(text: Column, size: int) -> Column:
    """0-based place of a string in a table of ``size`` (a power of two) entries."""
    return F.xxhash64(text).bitwiseAND(F.lit(size - 1)).cast("int")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once; a literal then stands in the plan once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Vocabulary:
    """Encoding and decoding as column expressions."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values(), default=0) >= 0x10FFFF - _FIRST:
            raise ValueError("more ids than there are characters for them")
        self.ranks = ranks
        self.pattern = _with_blanks(pattern)
        self.binary_pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.binary_pieces[rank] = token
        self.bytes = "".join(self._char(ranks[b]) if (b := bytes([i])) in ranks else _NONE for i in range(256))

    @staticmethod
    def _char(rank: int) -> str:
        return chr(_FIRST + rank)

    @staticmethod
    def _id(char: Column) -> Column:
        return (F.ascii(char) - _FIRST).cast("string")

    def maps(self, spark: SparkSession) -> Column:
        """A subquery: by hash, the characters of whole tokens, and of the pairs that make one."""
        def entries() -> Iterator[tuple[str, int]]:
            for token, rank in self.ranks.items():
                yield token.decode("latin-1"), rank
                for i in range(1, len(token)):
                    left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                    if left is not None and right is not None:
                        yield self._char(left) + self._char(right), rank

        keys = pa.array((key for key, _ in entries()), pa.string())
        place = np.fromiter((xxhash.xxh64_intdigest(key.encode(), seed=42) & (RANK_MAPS - 1) for key, _ in entries()), np.int64, len(keys))
        chars = pa.array((self._char(rank) for _, rank in entries()), pa.string())
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(RANK_MAPS + 1)).astype(np.int32)
        maps = pa.MapArray.from_arrays(pa.array(starts), keys.take(order), chars.take(order))
        return spark.createDataFrame(pa.table({"maps": pa.ListArray.from_arrays(pa.array([0, RANK_MAPS], pa.int32()), maps)})).scalar()

    @staticmethod
    def rank(maps: Column, pair: Column) -> Column:
        return F.coalesce(F.get(maps, _place(pair, RANK_MAPS))[pair], F.lit(_NONE))

    def _merge(self, maps: Column, state: Column) -> Column:
        """Join the leftmost pair of lowest rank, which is the id of what they make; only the ranks beside it change."""
        parts, ranks = state["parts"], state["ranks"]

        def join(token: Column, i: Column) -> Column:
            left = self.rank(maps, F.concat(F.substring(parts, i - 1, F.lit(1)), token))
            right = self.rank(maps, F.concat(token, F.substring(parts, i + 2, F.lit(1))))
            return F.struct(F.overlay(parts, token, i, F.lit(2)).alias("parts"),
                            F.overlay(ranks, F.concat(left, right), i - 1, F.lit(3)).alias("ranks"))

        return _bind(F.array_min(F.split(ranks, "")), lambda least: F.when(
            least < _NONE, _bind(F.instr(ranks, least), lambda i: join(least, i))).otherwise(state))

    def fold(self, maps: Column, word: Column) -> Column:
        """Ids of one word, between commas."""

        def merges(latin: Column) -> Column:
            n = F.length(latin)
            edged = F.concat(F.lit(_EDGE), F.translate(latin, _LATIN, self.bytes), F.lit(_EDGE))

            def start(parts: Column) -> Column:
                pairs = F.transform(F.sequence(F.lit(2), n), lambda i: self.rank(maps, F.substring(parts, i, F.lit(2))))
                return F.struct(parts.alias("parts"), F.concat(F.lit(_NONE), F.array_join(pairs, ""), F.lit(_NONE)).alias("ranks"))

            folded = F.aggregate(F.sequence(F.lit(2), n), _bind(edged, start),
                                 lambda state, _: self._merge(maps, state), lambda state: F.trim(state["parts"]))
            return F.array_join(F.transform(F.split(folded, ""), self._id), ",")

        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        return _bind(latin, lambda x: _bind(F.get(maps, _place(x, RANK_MAPS))[x], lambda whole: F.when(
            whole.isNotNull(), self._id(whole)).when(F.length(x) < 2, self._id(F.lit(_NONE))).otherwise(merges(x))))

    def decode(self, ids: Column) -> Column:
        """Bytes of ids between commas."""
        literal = _literal([p.decode("latin-1") for p in self.binary_pieces], "array<string>")
        joined = _bind(literal, lambda pieces: F.array_join(F.transform(F.split(ids, ","), lambda i: F.get(pieces, i.cast("int"))), ""))
        return F.when(ids == "", F.lit(b"")).otherwise(F.encode(joined, "ISO-8859-1"))


@lru_cache
def _cutter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern of the ``regex`` module.

    Where the pattern has nothing but plain characters and classes by property, and the text
    no character beyond 16 bits, ``re`` finds the same in less than half the time, with the properties spelt out.
    """
    cut = regex.compile(pattern).findall
    escapes = r"\\p\{\w+\}|\\[trnxu]"
    if "\\" in regex.sub(escapes, "", pattern) or regex.search(r"\(\?(?![:!=])|\[\[|--|&&|\|\||~~", pattern):
        return cut
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelt(name: str) -> str:
        return "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(f"{name}+", plane))

    out, inside = "", False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if part.startswith(r"\p"):
            part = spelt(part) if inside else f"[{spelt(part)}]"
        elif part in "[]":
            inside = part == "["
        out += part
    narrow = re.compile(out).findall
    return lambda text: narrow(text) if len(text.encode("utf-16-le")) == 2 * len(text) else cut(text)


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of any length: the leftmost pair of lowest rank is popped and joined until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, after, before = [*range(1, n + 1)], [*range(1, n + 1)], [*range(-1, n - 1)]

    def pair(i: int) -> int | None:
        return ranks.get(word[i: ends[after[i]]]) if after[i] < n else None

    heap = [(r, i, ends[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if ends[i] < 0 or j >= n or ends[j] != end:
            continue       # one of the two has been joined meanwhile
        ends[i], ends[j], after[i] = end, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, ends[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i: ends[i]]])
        i = after[i]
    return out


def _packed(numbers: list[int]) -> bytes:
    """Numbers below 2^24 as zstd over their byte planes, the lowest first; small ones leave the others empty."""
    planes = np.array(numbers, "<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.T).tobytes())


def _numbers(data: list[bytes | None]) -> np.ndarray:
    """What ``_packed`` made of several lists, one after the other."""
    planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(3, -1).astype(np.int32) for x in data if x is not None]
    return np.concatenate([np.empty(0, np.int32), *(p[0] | p[1] << 8 | p[2] << 16 for p in planes)])


def _unpacked(data: bytes) -> list[int]:
    return _numbers([data]).tolist()


def _ends(strings: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and bytes of a new large string or binary array: value i is what lies between offsets i and i + 1."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), pa.py_buffer(b"")
    return np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8), data or pa.py_buffer(b"")


def _by_chunk(coded: DataFrame) -> DataFrame:
    """``coded``, written in buckets by ``__chunk``: what is read back meets its chunk's ids without a shuffle.

    Only the files are shared; the table's name is given up once it is read.
    """
    spark = coded.sparkSession
    name = f"bpe_codes_{uuid.uuid4().hex}"
    writer = coded.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "bpe-codes"))
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "__chunk").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written


def _coded(docs: DataFrame, vocabulary: Vocabulary, text_col: str, kept: list[str]) -> DataFrame:
    """Written rows of two kinds: a text (``kept``, its place in the chunk and count of words), and a chunk's distinct words of one bucket.

    The words of neighbouring texts stand as numbers in the ``__codes`` of the first of
    them; the most frequent word of a chunk is 0.  ``__words`` is a JSON array of sorted words,
    ``__numbers`` theirs.  Bucket -1 holds the long words; there, ``__words`` are their ids.
    """
    own = "__chunk bigint, __at int, __n int, __codes binary, __bucket int, __words string, __numbers binary"
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), own])
    pattern, ranks = vocabulary.pattern, vocabulary.ranks
    added = [("__chunk", pa.int64()), ("__at", pa.int32()), ("__n", pa.int32()), ("__codes", pa.binary()),
             ("__bucket", pa.int32()), ("__words", pa.string()), ("__numbers", pa.binary())]

    @released
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbering() -> defaultdict[str, int]:
            found = defaultdict()
            found.default_factory = found.__len__      # a new word takes the next number
            return found

        cut = _cutter(pattern)
        chunk, seen, size, arrow = TaskContext.get().partitionId() << 16, numbering(), 0, None     # of one write: partitions number their own
        parts: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []

        def finished() -> Iterator[pa.RecordBatch]:
            used = np.zeros(len(seen), np.int64)
            for _, codes in parts:
                used += np.bincount(np.concatenate(codes), minlength=len(seen))
            rank = np.empty(len(seen), np.int32)
            rank[np.argsort(-used, kind="stable")] = np.arange(len(seen))
            at = 0
            for rows, codes in parts:
                n = len(codes)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([chunk] * n, pa.int64()), pa.array(np.arange(at, at + n), pa.int32()), pa.array([len(c) for c in codes], pa.int32()),
                     pa.array([_packed(rank[np.concatenate(codes)])] + [None] * (n - 1), pa.binary()), *(pa.nulls(n, kind) for _, kind in added[4:])], schema=arrow)
                at += n
            buckets: dict[int, list[tuple[str, int]]] = {}
            for word, number in zip(seen, rank.tolist(), strict=True):
                raw = word.encode()
                if len(raw) > FOLD_BYTES:
                    buckets.setdefault(-1, []).append((",".join(map(str, merge_by_heap(raw, ranks))), number))
                else:
                    buckets.setdefault(xxhash.xxh32_intdigest(raw) % BUCKETS, []).append((word, number))
            n, rows = len(buckets), [sorted(x) for x in buckets.values()]      # sorted words shuffle as fewer bytes
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, arrow.field(c).type) for c in kept), pa.array([chunk] * n, pa.int64()), *(pa.nulls(n, kind) for _, kind in added[1:4]),
                 pa.array([*buckets], pa.int32()), pa.array([json.dumps([w for w, _ in x], ensure_ascii=False, separators=(",", ":")) for x in rows], pa.string()),
                 pa.array([_packed([k for _, k in x]) for x in rows], pa.binary())], schema=arrow)

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field(c) for c in kept] + added)
            rows, codes, first = batch.select(kept), [], 0
            for i, text in enumerate(batch.column(text_col).to_pylist(), 1):
                words = cut(text or "")
                codes.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                size += len(text or "")
                if len(seen) >= 1 << _BITS:
                    raise ValueError(f"a text of more than {1 << _BITS} distinct words")
                if size >= CHUNK:
                    parts.append((rows.slice(first, i - first), codes))
                    yield from finished()
                    chunk, seen, size, parts, codes, first = chunk + 1, numbering(), 0, [], [], i
            if codes:
                parts.append((rows.slice(first), codes))
        if parts:
            yield from finished()

    columns = list(dict.fromkeys([*kept, text_col]))
    return _by_chunk(docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(code, schema))


def _folded(pairs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pairs`` (bucket, chunk, word, more) with ``ids`` between commas; of equal words the first is folded."""
    same = Window.partitionBy("bucket", "word").orderBy("chunk")
    # a subquery may not stand in a lambda, so it is a column first, which the optimizer puts into the one place of its use
    ids = _bind(F.col("__maps"), lambda maps: vocabulary.fold(maps, F.col("word")))
    firsts = pairs.withColumn("nth", F.row_number().over(same)).withColumn("__maps", vocabulary.maps(pairs.sparkSession))
    firsts = firsts.withColumn("folded", F.when(F.col("nth") == 1, ids)).drop("__maps")
    # a running frame: nothing is held for a word that stands in very many chunks
    return firsts.withColumn("ids", F.first("folded", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0))).drop("nth", "folded")


def _assembled(docs: DataFrame, vocabulary: Vocabulary, text_col: str, kept: list[str], finish: Callable, schema: str) -> DataFrame:
    """``finish(ids, decoded)`` of every text, beside ``kept``: its ids between commas, and the bytes that they decode to."""
    coded = _coded(docs, vocabulary, text_col, kept)
    words = coded.where("__bucket >= 0").select(F.col("__bucket").alias("bucket"), F.col("__chunk").alias("chunk"), "__words").repartition("bucket")
    pairs = words.select("bucket", "chunk", F.posexplode(F.from_json("__words", "array<string>")).alias("place", "word"))
    pairs = _folded(pairs, vocabulary)
    # still by bucket: a chunk's ids of one bucket go back as one row, in the order of its words
    placed = F.sort_array(F.collect_list(F.struct("place", "ids")))
    back = pairs.groupBy("bucket", "chunk").agg(placed.alias("w")).select("chunk", "bucket", F.array_join("w.ids", " ").alias("ids"))
    binary_pieces = vocabulary.binary_pieces

    def together(own: pa.Table, back: pa.Table) -> pa.Table:
        bucket = own.column("__bucket")
        texts, listed = own.filter(pc.is_null(bucket)).sort_by("__at"), own.filter(pc.is_valid(bucket))
        found = dict(zip(back.column("bucket").to_pylist(), back.column("ids").to_pylist(), strict=True))
        lists = [" ".join(json.loads(x)) if b < 0 else found[b]
                 for b, x in zip(listed.column("__bucket").to_pylist(), listed.column("__words").to_pylist(), strict=True)]
        ids = pc.split_pattern(pa.array(lists, pa.large_string()), " ").flatten()
        numbers = _numbers(listed.column("__numbers").to_pylist())
        if len(ids) != len(numbers):
            raise ValueError(f"{len(numbers)} words, {len(ids)} have ids")
        # the bytes of a word are those of its tokens' pieces, one after the other
        tokens = pc.split_pattern(ids, ",")
        pieces = pa.array(binary_pieces, pa.large_binary()).take(tokens.flatten().cast(pa.int32()))
        ends, data = _ends(pieces)
        decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[tokens.offsets.to_numpy()]), data])
        ids = pc.binary_join_element_wise(ids, *(pa.scalar(x, pa.large_string()) for x in ("", ",")))      # a comma after each, too
        place = np.empty(len(numbers), np.int64)
        place[numbers] = np.arange(len(numbers))
        codes = place[_numbers(texts.column("__codes").to_pylist())]
        bounds = np.cumsum([0, *texts.column("__n").to_pylist()])
        rows = []
        for first in range(0, len(texts), 64):
            some = bounds[first: first + 65]
            taken = pa.array(codes[some[0]: some[-1]])
            (at, joined), (back_at, back_joined) = _ends(ids.take(taken)), _ends(decoded.take(taken))
            for a, b in zip(some[:-1] - some[0], some[1:] - some[0], strict=True):
                rows.append(finish(joined[at[a]: max(at[a], at[b] - 1)].to_pybytes().decode(), back_joined[back_at[a]: back_at[b]].to_pybytes()))
        made = [pa.array(list(x)) for x in zip(*rows, strict=True)]
        return pa.Table.from_arrays([*[texts.column(c) for c in kept], *made], schema=arrow) if rows else arrow.empty_table()

    def put(own: pa.Table, back: pa.Table) -> pa.Table:
        made = together(own, back)
        give_back()
        return made

    kept_schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    arrow = to_arrow_schema(_parse_datatype_string(f"struct<{kept_schema}, {schema}>"))
    own = coded.withColumn("__words", F.expr("CASE WHEN __bucket < 0 THEN __words END"))
    return own.groupBy("__chunk").cogroup(back.groupBy("chunk")).applyInArrow(put, f"{kept_schema}, {schema}")


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the token ids of each whole text, as a string of decimal ids between commas.

    A null or empty text has no ids (an empty string).  Special tokens are ordinary
    text.  All other columns and rows stay (a column of the name ``ids_col`` is replaced, names
    beginning with ``__`` are reserved); an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != ids_col]
    return _assembled(docs, vocabulary, text_col, kept, lambda ids, back: (ids,), f"`{ids_col}` string")


def token_digests(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: the text encoded, and its ids decoded again."""
    def digests(ids: str, back: bytes) -> tuple[int, str, str]:
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = _assembled(rows, vocabulary, "text", ["id"], digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
