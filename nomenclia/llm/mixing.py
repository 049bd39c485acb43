"""Mixing sources to target weights by a time-varying curriculum, in built-in functions only.

Targets: all sources together are given ``share`` times all words, in
proportion to their weights; no source is given more than ``most`` times its
own size, and what it cannot take goes to the others by weight (water filling,
closed form over one row per source).

Order: each source follows a weight schedule, linear between knots over the
training time 0 to 1. The integral of the schedule is the source's cumulative
demand; a document's place in its source's cumulative words is inverted
through that integral, which gives its training position, and documents are
range-sorted by position.

Scale: offsets within a source are two-level prefix sums over ``buckets``
ranges of a digest of the id, so a source that holds a third of all rows is
spread over that many groups; only one row per source and bucket meets in a
source's window, one row per source in the single window of the targets.

Cases: null source is a source of its own, last in order; null or empty text
has size 0 and takes nothing; repeated rows are distinct documents that share
a place order; of a very long text only the number of its words is used; an
empty table gives an empty result. Columns of the input that carry a result's
name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenclia.llm.common import n_words

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Schedules by place in the cycle of weights: (time, relative weight) knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)
#: Hexadecimal digits of the digest that name a bucket: 16 ** 3 of them for each source.
BUCKET_DIGITS = 3
RESULT = ("size", "source_size", "target", "taken", "first_taken", "position", "repeat_position")


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a source has met ``share`` (0 to 1) of its demand."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, done, out = sum(areas), 0.0, None
    for (t, m), (t2, m2), area in zip(knots, knots[1:], areas, strict=False):
        rest, slope = share * F.lit(whole) - F.lit(done), (m2 - m) / (t2 - t)
        time = F.lit(t) + F.lit(2.0) * rest / (F.lit(m) + F.sqrt(F.greatest(F.lit(0.0), F.lit(m * m) + F.lit(2.0 * slope) * rest)))
        out = F.when(share * F.lit(whole) <= F.lit(done + area), time) if out is None else out.when(share * F.lit(whole) <= F.lit(done + area), time)
        done += area
    return out.otherwise(F.lit(knots[-1][0]))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``cycle`` (place in the cycle of weights) and ``target``."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("cycle", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("cycle") + 1).cast("long")).withColumn("__cap", F.lit(most) * F.col("source_size"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0))
    total = F.lit(share) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / left("__w")
    filled = ranked.withColumn("__level", level).withColumn("__level", F.max("__level").over(every))
    return filled.select("source", "source_size", "cycle", F.least(F.col("__cap").cast("double"), F.col("__w") * F.col("__level")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, schedules: Sequence = SCHEDULES, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source and ``size``, by default the words of text) with the mix's columns.

    ``taken`` counts the words taken, repeats included; ``first_taken`` those of
    the first pass. ``position`` and ``repeat_position`` are training times of
    the two passes, null where a pass takes nothing.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    sized = docs.select(*keep, (n_words(F.col("text")) if size is None else size).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__key"))
    sized = sized.withColumn("__no", F.col("source").isNull()).withColumn("__src", F.coalesce("source", F.lit(""))).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    ends = sized.groupBy("__no", "__src", "__bucket").agg(F.sum("size").alias("__n"))
    own = Window.partitionBy("__no", "__src")
    bases = ends.withColumn("__base", F.coalesce(F.sum("__n").over(own.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("source_size", F.sum("__n").over(own))
    sizes = ends.groupBy("__no", "__src").agg(F.sum("__n").alias("source_size")).select(F.when(~F.col("__no"), F.col("__src")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, most).select(F.col("source").isNull().alias("__no"), F.coalesce("source", F.lit("")).alias("__src"), "cycle", "target")
    bases = bases.select("__no", "__src", "__bucket", "__base", "source_size").join(targets, ["__no", "__src"])
    run = Window.partitionBy("__no", "__src", "__bucket").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__before", F.coalesce(F.sum("size").over(run), F.lit(0))).join(bases, ["__no", "__src", "__bucket"])
    at, goal = F.col("__base") + F.col("__before"), F.round("target").cast("long")
    part = lambda start: F.least(F.col("size"), F.greatest(F.lit(0), goal - start))
    cut = placed.withColumn("__at", at).withColumn("first_taken", part(F.col("__at"))).withColumn("__again", part(F.col("__at") + F.col("source_size")))

    def time(start: Column, n: str) -> Column:
        met = F.least(F.lit(1.0), (start + F.col(n) / F.lit(2)) / F.col("target"))
        out = F.when(F.col("cycle") == 0, invert_schedule(met, schedules[0]))
        for k, knots in enumerate(schedules[1:], 1):
            out = out.when(F.col("cycle") == k, invert_schedule(met, knots))
        return F.when(F.col(n) > 0, out)

    return cut.select(*keep, "size", "source_size", "target", (F.col("first_taken") + F.col("__again")).alias("taken"), "first_taken", time(F.col("__at"), "first_taken").alias("position"), time(F.col("__at") + F.col("source_size"), "__again").alias("repeat_position"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each whole copy that the mix takes, range-sorted by training position.

    A copy counts as taken when half of its words are; documents without words
    stay once.
    """
    again = F.col("taken") - F.col("first_taken")
    first = F.when((F.col("size") == 0) | (2 * F.col("first_taken") >= F.col("size")), F.coalesce("position", F.lit(0.0)))
    second = F.when((F.col("size") > 0) & (2 * again >= F.col("size")), F.col("repeat_position"))
    copies = F.filter(F.array(first, second), lambda p: p.isNotNull())
    return mixed.withColumn("__position", F.explode(copies)).orderBy("__position", "doc_id").drop("__position")
