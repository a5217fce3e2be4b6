"""Spelling variants by a relational trie frontier.

The words of the corpus form a trie whose chains are compressed: a node is a group of words
with a common prefix, its edges are the characters that follow, and an edge's
label runs on to the next branching (or to the word's end).  States (word,
position, node, edits) move down level by level, each step a join with that
level's edge table.  A word's own path spends no edit.  Two words that differ by
one code point part at a node on both paths, where one of them

* takes a larger character instead of its own (a replacement), or
* leaves its own character out (a deletion),

so each pair is found from one side, once, and the state with its edit spent must
then follow the trie to a word's end.  The states without an edit are also what the
next level's edges are built from: a prefix of one word only becomes a leaf, so
the levels are those of the branchings, not of the characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.plans.stages import materialize

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _char(word: Column, position: Column) -> Column:
    """The code point at a 0-based position; empty at the end."""
    return F.substring(word, position + 1, F.lit(1))


def _rest(word: Column, position: Column) -> Column:
    return F.substring(word, position + 1, F.length(word))


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two different words."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return (F.array_position(same, False) - 1).cast("int")


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: str = "[A-Za-zÀ-ÿ]",
                least_length: int = 6, least_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n) of the words of all texts: runs of letters, A-Z lower-cased, some with a slip.

    If ``slip`` divides h, the unsigned crc32 of ``<id>:<run>``, the run's code point
    at h modulo its length is deleted.  Words have at least ``least_length`` code points
    and ``least_count`` occurrences.  Null and empty texts have none; a null id is written
    as an empty one; repeated rows count as often as they stand.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    # a shorter run cannot become a longer word
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"{run}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWERED).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(F.pmod(h, F.lit(slip)) == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), _rest(F.col("run"), at + 1))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _edges(level: DataFrame) -> DataFrame:
    """Edge table of the nodes that the states without an edit stand at.

    (node, c, label, child, leaf): ``label`` starts with ``c`` (both empty where a word
    ends at the node) and runs to the child's branching, or to the end of the word ``leaf``.
    """
    own = level.where("edits = 0").select("node", "position", "word", "word_id", _char(F.col("word"), F.col("position")).alias("c"))
    kids = own.groupBy("node", "c").agg(F.count("*").alias("words"), F.min("word").alias("first"), F.max("word").alias("last"),
                                        F.min("word_id").alias("child"), F.first("position").alias("position"))
    alone = F.col("words") == 1
    until = F.when(alone, F.length("first")).otherwise(_common_prefix(F.col("first"), F.col("last")))
    return kids.select("node", "c", F.substring(F.col("first"), F.col("position") + 1, until - F.col("position")).alias("label"),
                       F.when(~alone, F.col("child")).alias("child"), F.when(alone, F.col("first")).alias("leaf"))


def _step(level: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level down; those that came to a word's end have it as ``leaf``."""
    position, word = F.col("position"), F.col("word")
    state = ["word", "word_id", "position", "edits"]
    here = level.select("node", *state)
    # the own character left out; of equal neighbours the last, which parts at a later node
    left_out = here.where((F.col("edits") == 0) & (position < F.length(word)) & (_char(word, position) != _char(word, position + 1)))
    followers = here.unionAll(left_out.select("node", "word", "word_id", (position + 1).alias("position"), F.lit(1).alias("edits")))
    followers = followers.withColumn("c", _char(word, position))
    label, leaf = F.col("label"), F.col("leaf")

    def reaches(rest: Column, of: Column) -> Column:
        """A branch must be run through; a leaf must be met exactly."""
        return F.when(leaf.isNull(), rest.startswith(of)).otherwise(rest == of)

    out = ["word", "word_id", (position + F.length(label)).alias("position")]
    follow = followers.join(edges, ["node", "c"]).where(
        reaches(_rest(word, position), label) & ((F.col("edits") == 1) | leaf.isNull()))
    swapped = here.where((F.col("edits") == 0) & (position < F.length(word))).withColumn("own", _char(word, position)).join(edges, "node").where(
        (F.col("c") > F.col("own")) & reaches(_rest(word, position + 1), F.substring(label, F.lit(2), F.length(label))))
    return follow.select(*out, "edits", F.col("child").alias("node"), "leaf").unionAll(
        swapped.select(*out, F.lit(1).alias("edits"), F.col("child").alias("node"), "leaf"))


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): each pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    ``words`` has distinct words in a column ``word``; no characters beyond U+FFFF.
    """
    rows = materialize(words.select("word").withColumn("word_id", F.monotonically_increasing_id()), "spelling-words")
    ends = rows.agg(F.min("word").alias("first"), F.max("word").alias("last"))
    top = ends.select(F.when(F.col("first") < F.col("last"), _common_prefix(F.col("first"), F.col("last"))).alias("depth")).first().depth
    if top is None:        # fewer than two words
        return rows.select(F.col("word").alias("a"), F.col("word").alias("b")).where("false")
    level = rows.select("word", "word_id", F.lit(top).alias("position"), F.lit(0).alias("edits"), F.lit(-1).cast("long").alias("node"))
    found = []
    while True:
        stepped = materialize(_step(level, materialize(_edges(level), "spelling-edges")), "spelling-states")
        found.append(stepped.where("leaf IS NOT NULL").select(F.col("word").alias("a"), F.col("leaf").alias("b")))
        level = stepped.where("node IS NOT NULL").drop("leaf")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, found)


def variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of ``words`` (word, n; words are distinct).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that
    is at least ``times`` the word's own, else null; ``root`` the last of the forms
    that follow from the word, the word itself if it has none.  An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words")
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "spelling-counts")
    pairs = materialize(neighbours(words), "spelling-pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    rows = words.join(best, "word", "left")
    has = F.coalesce(-F.col("best.n") >= times * F.col("n"), F.lit(False))
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")), "spelling-forms")
    # forms grow at least `times`-fold, so chains have at most 28 links; each round doubles the links that are followed
    links = materialize(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = materialize(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
                             "spelling-links")
        links = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
