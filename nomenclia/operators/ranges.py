"""Value options with open or closed bounds: containment of values and intervals, and the most specific option.

An option is a struct column: kind ('quality', 'range', 'concrete'), label,
number, lower, upper, lower_inc, upper_inc. A null bound is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def option(kind: Column, label: Column, number: Column, lower: Column, upper: Column, lower_inc: Column, upper_inc: Column) -> Column:
    named = {"kind": kind, "label": label, "number": number, "lower": lower, "upper": upper, "lower_inc": lower_inc, "upper_inc": upper_inc}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def range_bounds(low: Column, high: Column, low_note: Column, high_note: Column) -> Column:
    """Bounds from a catalogue's minimum and maximum: 'greater'/'less' exclude, anything else includes.

    A reversed pair has no bounds at all, so the range accepts everything.
    """
    sound = low.isNull() | high.isNull() | (low <= high)
    return F.struct(
        F.when(sound, low).alias("lower"),
        F.when(sound, high).alias("upper"),
        F.coalesce(low_note != "greater", F.lit(True)).alias("lower_inc"),
        F.coalesce(high_note != "less", F.lit(True)).alias("upper_inc"),
    )


def contains(opt: Column, value: Column) -> Column:
    """A range holds the value, or a concrete number equals it to a billionth."""
    low = opt["lower"].isNull() | (value > opt["lower"]) | (opt["lower_inc"] & (value == opt["lower"]))
    high = opt["upper"].isNull() | (value < opt["upper"]) | (opt["upper_inc"] & (value == opt["upper"]))
    near = F.abs(opt["number"] - value) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(value))
    return F.when(opt["kind"] == "range", low & high).when(opt["kind"] == "concrete", F.coalesce(near, F.lit(False))).otherwise(False)


def contains_interval(opt: Column, low: Column, high: Column) -> Column:
    """Both ends inside; a condition open on a side only suits ranges open on that side that hold its end."""
    two = F.when(opt["kind"] == "concrete", (low == high) & contains(opt, low)).otherwise(contains(opt, low) & contains(opt, high))
    up = (opt["kind"] == "range") & opt["upper"].isNull() & opt["lower"].isNotNull() & contains(opt, low)
    down = (opt["kind"] == "range") & opt["lower"].isNull() & opt["upper"].isNotNull() & contains(opt, high)
    return F.coalesce(F.when(low.isNotNull() & high.isNotNull(), two).when(low.isNotNull(), up).when(high.isNotNull(), down), F.lit(False))


def specificity(opt: Column) -> Column:
    """Smaller is more specific: no range first, then the narrower, then the larger lower bound, then by label."""
    width = F.when(opt["kind"] != "range", F.lit(0.0)).otherwise(F.coalesce(opt["upper"] - opt["lower"], F.lit(float("inf"))))
    return F.struct((opt["kind"] == "range").cast("int").alias("a"), width.alias("b"), (-F.coalesce(opt["lower"], F.lit(float("-inf")))).alias("c"), opt["label"].alias("d"))


def most_specific(options: Column) -> Column:
    """The most specific of an array of options, null if it is empty."""
    keyed = F.transform(options, lambda o: F.struct(specificity(o).alias("k"), o.alias("o")))
    return F.array_min(keyed)["o"]


#: Buckets that one range is put in at most; wider and open ones meet the values of their key without buckets.
MOST_BUCKETS = 64


def meeting(values: DataFrame, options: DataFrame, keys: list[str], at: Column, width: float) -> DataFrame:
    """Pairs of ``values`` and ``options`` (keys and an option's columns) that may hold the place ``at`` of a value.

    Ranges are cut into buckets of ``width``, and a value meets those of its own
    bucket, an equi-join; open and very wide ranges, which no bucket bounds, meet
    every value of their key. What is left to test is ``contains``.
    """
    low, high = F.floor(F.col("lower") / width), F.floor(F.col("upper") / width)
    number = F.floor(F.col("number") / width)
    # A number may equal a concrete one of the next bucket, to a billionth.
    cut = F.when((F.col("kind") == "range") & (high - low < MOST_BUCKETS), F.sequence(low, high)).when((F.col("kind") == "concrete") & number.isNotNull(), F.sequence(number - 1, number + 1))
    sorted_out = options.withColumn("__cut", cut)
    near = sorted_out.where("__cut is not null").select(*options.columns, F.explode("__cut").alias("__bucket"))
    wide = sorted_out.where("__cut is null and kind <> 'quality'").drop("__cut")
    placed = values.withColumn("__bucket", F.floor(at / width))
    return placed.join(near, [*keys, "__bucket"]).drop("__bucket").unionByName(values.join(wide, keys))
