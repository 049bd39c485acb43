"""What filters of documents remove, in every order of them.

Five filters are judged for every row: too few words, too few distinct words,
too many capitals, odd signs, and a text that a row with a smaller doc_id has
too. The first four are expressions of the text. For the fifth the table is
range-sorted by a fingerprint of the text (SHA-256), the text and the doc_id,
and each row is compared with the one before, over the ends of partitions too
(``content_sort``). A row's failures are one mask of five bits, and documents
are counted by part, mask and labels: sums that merge in any order and hold at
most 32 rows a part. Every figure of every order follows from these counts.

A filter's Shapley value is what it removes summed over all orders. It removes a
document in the orders that put it before the document's other failures: one in
k of them where k filters fail.

Scale: one shuffle of the texts; copies are cut over partitions by doc_id and
row, so that a large group is no task of its own. Labels are reduced to two bits
a doc_id and joined to rows without texts. Counters are summed before they are
shuffled.

Cases: null texts are empty: they fail A alone, besides E where another empty
text has a smaller doc_id; E compares with every row of the table, removed or
not; a null doc_id is neither smaller nor larger than another, so such a row
never fails E and makes no other fail it; rows that share a doc_id do not fail E
by each other, and each counts; a null source is the part of the empty string; a
document is good or toxic if any label of its doc_id says 1, null labels and
documents without any are neither; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenclia.llm.common import few, stage
from nomenclia.llm.content_sort import chains, local_runs, whole_runs

#: The filters in the order of their bits.
LETTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the first four filters that a text fails, null being empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACES), "")

    def bits(found: Column) -> Column:
        n, distinct = F.size(found).cast("long"), F.size(F.array_distinct(found)).cast("long")
        capitals = F.length(t) - F.length(F.translate(t, CAPITALS, ""))
        failed = (n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(t).cast("long"), t.rlike(ODD))
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))

    # The words are bound once, as the element of an array of one.
    return F.transform(F.array(words), bits)[0].cast("int")


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mask) of every row of ``docs`` (doc_id, source, text): the filters that it fails."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.unhex(F.sha2("text", 256)))
    local = local_runs(rows, [F.col("print")], "text", [F.col("doc_id").asc_nulls_last()], "doc_id", ["doc_id", "source", "mask"], {"mask": text_mask(F.col("text"))})
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return whole_runs(local, chains(local)).select("doc_id", "source", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``failed``, of ``masks``: the documents of a part with these failures, of them good, of them toxic."""
    known = labels.where("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    bits = stage(known.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "labels")
    met = failed.join(few(bits), "doc_id", "left")
    return met.groupBy(F.coalesce("source", F.lit("")).alias("part"), "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def steps() -> list[dict]:
    """Of every order and step: the order, the step, the mask of the filters before it, and the filter's own bit."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << LETTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "before": before, "own": own})
            before |= own
    return out


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step of ``counted``, of ``counters``."""
    each = F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic")))  # 32 at most
    parts = counted.groupBy("part").agg(each.alias("of"))
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, before int, own int>>")
    rows = parts.withColumn("at", F.explode(table)).select("part", "of", "at.*")
    before, own = F.col("before"), F.col("own")

    def total(of: str, where) -> Column:
        return F.aggregate("of", F.lit(0).cast("long"), lambda x, m: x + F.when(where(m["mask"]), m[of]).otherwise(F.lit(0)))

    removed = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    shapley = F.aggregate("of", F.lit(0).cast("long"), lambda x, m: x + F.when(m["mask"].bitwiseAND(own) != 0, m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long")).otherwise(F.lit(0)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
