"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A pre-token starts as its bytes in a linked list; the adjacent pair of lowest
rank (the leftmost on ties) is popped from a heap and joined until none has a
rank.  The count is the number of bytes minus the number of merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and characters in them, whose count a worker remembers before it starts afresh.
MEMORY, MEMORY_CHARS = 400_000, 8 << 20
#: Longer pieces are counted each time they stand: texts without blanks are one piece.
LONGEST = 64
_DOUBTFUL = re.compile(r"\A | \s|\s | \Z")
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (x for x in range(256) if x not in set(shown))
    table = {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}
    return [table[x] for x in range(256)]


def read_merges(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """(rank of each mergeable pair, special strings) of a byte-level ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"])
    ranks = {pair: rank for rank, pair in enumerate(pairs)}
    return ranks, [t["content"] for t in whole.get("added_tokens", []) if t["special"]]


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges of one pre-token."""
    n = left = len(symbols)
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return left
    heapq.heapify(heap)
    symbols = [*symbols]
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or not symbols[i] or ranks.get((symbols[i], symbols[j])) != rank:
            continue   # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return left


class _Memory(dict):
    """Count of a string, worked out when it is first asked for; what is held is bounded in entries and characters."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.chars = 0

    def __missing__(self, key):
        n = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMORY or self.chars + len(key) > MEMORY_CHARS:
                self.clear()
                self.chars = 0
            self[key] = n
            self.chars += len(key)
        return n


class TokenCounter:
    """Counts the tokens of whole texts; special strings in a text count as one token each."""

    def __init__(self, ranks: dict[tuple[str, str], int], special: list[str]):
        symbols = byte_symbols()
        pieces = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        token = _Memory(lambda w: count_symbols([symbols[b] for b in w.encode()], ranks))
        self.plain = _Memory(lambda s: sum(map(token.__getitem__, pieces.findall(s))))
        self.spaced = _Memory(lambda s: sum(map(token.__getitem__, pieces.findall(" " + s))))

    def _part(self, text: str) -> int:
        # A blank between two non-blanks always starts a pre-token, so the parts
        # between such blanks can be counted (and remembered) one by one.
        if not text:
            return 0
        if _DOUBTFUL.search(text):
            return sum(map(self.plain.__getitem__, _CUTS.split(text)))
        first, *rest = text.split(" ")
        return self.plain[first] + sum(map(self.spaced.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._part, parts))


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level ``tokenizers`` file on the driver;
    its merges are broadcast (their number is that of the file).  A null or empty
    text has 0 bytes and 0 tokens; a null id stays null; repeated rows are counted
    each; an empty table gives an empty result; other columns are ignored.
    """
    merges = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*merges.value)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
