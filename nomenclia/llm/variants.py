"""Spellings of words that are one edit apart, grouped under the commonest.

Words are runs of letters, A-Z lower-cased, long and frequent enough. Two are
near when one inserted, deleted or replaced code point makes one of the other.
The join is by even partition: a word is indexed by its two halves, with its
length; a near word of equal length shares one half in its place, and one longer
by one shares the first half in its place or the second one place further. So a
word probes with its own halves for words of its length, and with the halves
that a word shorter by one would have, taken from its start and its end.
Candidates that share a half are verified, and pairs found by both halves count
once.

A half that many words share would pair them all. Such a group is not paired but
parted again: its words differ in what the half leaves, so that rest is halved in
turn, level by level, down to a rest of one letter, where all words of a group
are near indeed and the alphabet bounds it. Levels are as many as halvings of
the longest word of a large group, and every group is judged by its own size
alone.

A word's form is its commonest near word (ties: the smallest in code-point
order), if that occurs at least twice as often; its root is the end of the path
of forms. Occurrences double at each step, so paths are short and without
cycles; they are followed by pointer jumping.

Scale: occurrences are summed before they are shuffled; all else works on the
distinct words, four rows each, by hashes of halves. Verification compares whole
words, so hashes that collide cost time only. Only counts, and the hashes of
large groups if counted to be few, leave the executors that found them.

Cases: null and empty texts have no words; a null doc_id counts as an empty one
where ``respell`` reads it; repeated rows count each; very long runs are words
like others; ties go to the smaller word; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenclia.llm.common import drop_staged, few, stage

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LENGTH, LEAST = 5, 3
#: Pairs of a group of words that share a part; beyond, and while the rest has two letters, the group is parted again.
DEAR = 4096
#: Roles of a row: a word under its own parts, a word under the parts of words shorter by one.
OWN, LONGER = 0, 1


def words(docs: DataFrame, respell: Callable[[Column, Column], Column] | None = None, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): words of at least ``length`` code points and ``least`` occurrences; staged.

    ``respell`` gives an occurrence's word from its doc_id and lower-cased run, and never a longer one.
    """
    runs = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(rf"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run"))
    word = respell(F.col("doc_id"), F.col("run")) if respell else F.col("run")
    counted = found.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return stage(counted.where(F.col("n") >= least), "words")


def one_lost(doc_id: Column, run: Column, one_in: int = 97) -> Column:
    """``run``, without one code point in one of ``one_in`` pairs of document and run; checksums choose both."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def _parts(rows: DataFrame) -> DataFrame:
    """Two rows for each of ``rows`` (word, n, role, a, b): the first and the second half of what its first ``a`` and last ``b`` letters leave are shared too."""
    size = F.length("word") - F.col("role")  # of the shorter word
    half = F.floor((size - F.col("a") - F.col("b")) / 2).cast("int")
    either = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (size - F.col("a") - half).alias("b")))
    parted = rows.select("word", "n", "role", F.explode(either).alias("p")).select("word", "n", "role", "p.a", "p.b")
    a, b = F.col("a"), F.col("b")
    start, end = F.substring("word", F.lit(1), a), F.substring(F.col("word"), F.length("word") - b + 1, b)
    return parted.withColumn("part", F.xxhash64(F.length("word") - F.col("role"), a, b, start, end))


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of verified pairs under equal parts."""
    own = rows.where(F.col("role") == OWN).select("part", "word", "n")
    other = rows.select("part", "role", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = own.join(other, "part").where((F.col("role") == LONGER) | (F.col("word") < F.col("near")))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def near_pairs(counted: DataFrame, dear: int = DEAR) -> DataFrame:
    """(word, n, near, near_n) of ``counted`` (word, n): each pair of near words once; staged."""
    both = F.explode(F.array(F.lit(OWN), F.lit(LONGER))).alias("role")
    rows = stage(_parts(counted.select("word", "n", both, F.lit(0).alias("a"), F.lit(0).alias("b"))), "parts")
    found = []
    while True:
        own, left = F.count_if(F.col("role") == OWN), F.max(F.length("word") - F.col("role") - F.col("a") - F.col("b"))
        large = stage(rows.groupBy("part").agg((own * F.count("*")).alias("pairs"), left.alias("rest")).where((F.col("pairs") > dear) & (F.col("rest") > 1)).select("part"), "large")
        if large.isEmpty():
            found.append(stage(_pairs(rows), "pairs"))
            break
        found.append(stage(_pairs(rows.join(few(large), "part", "left_anti")), "pairs"))
        deeper = stage(_parts(rows.join(few(large), "part", "left_semi")), "parts")
        drop_staged(rows)
        rows = deeper
    drop_staged(rows)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return stage(whole.dropDuplicates(["word", "near"]), "near")


def forms(counted: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``counted`` (word, n), distinct words."""
    pairs = near_pairs(counted)
    ways = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    common = -F.col("best.n") >= 2 * F.col("n")
    formed = counted.join(best, "word", "left").select("word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.n")).alias("form_n"))
    formed = stage(formed, "formed")
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form): the last form on each word's path; staged."""
    at = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        drop_staged(at)
        at = moved
        if moved.where("on").isEmpty():
            return moved.select("word", "root")
