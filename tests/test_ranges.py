"""Containment in ranges against a brute-force reading, and the kernel's twin."""

import itertools

from pyspark.sql import functions as F

from nomenclia.functions import numbers as N
from nomenclia.functions import text as X
from nomenclia.operators import kernel, ranges


def holds(row, v):
    kind, _, number, low, high, low_inc, high_inc = row
    if kind == "concrete":
        return number == v
    return kind == "range" and (low is None or v > low or (v == low and low_inc)) and (high is None or v < high or (v == high and high_inc))


def holds_interval(row, a, b):
    kind, _, number, low, high, _, _ = row
    if a is not None and b is not None:
        return holds(row, a) and holds(row, b) and (kind == "range" or a == b)
    if kind != "range" or (a is None and b is None):
        return False
    return high is None and low is not None and holds(row, a) if b is None else low is None and high is not None and holds(row, b)


def test_contains(spark):
    rows = []
    for low, high, li, hi in itertools.product((None, 1.0, 2.0), (None, 2.0, 3.0), (True, False), (True, False)):
        rows.append(("range", "x", None, low, high, li, hi))
    rows += [("concrete", "x", 2.0, None, None, True, True), ("quality", "x", None, None, None, True, True)]
    df = spark.createDataFrame(rows, "kind string, label string, number double, lower double, upper double, lower_inc boolean, upper_inc boolean")
    opt = ranges.option(*[F.col(c) for c in df.columns])
    points = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
    ends = [(1.0, 2.0), (1.5, None), (None, 2.0), (2.0, 2.0), (None, None)]
    cols = [ranges.contains(opt, F.lit(p)).alias(f"p{k}") for k, p in enumerate(points)] + [ranges.contains_interval(opt, F.lit(a).cast("double"), F.lit(b).cast("double")).alias(f"i{k}") for k, (a, b) in enumerate(ends)]
    for row, got in zip(rows, df.select(*cols).collect(), strict=True):
        assert list(got)[: len(points)] == [holds(row, p) for p in points], row
        assert list(got)[len(points) :] == [holds_interval(row, a, b) for a, b in ends], row
        # The kernel's own reading, of millimetres.
        option = dict(zip(df.columns, row, strict=True)) | {"unit": "mm"}
        c = kernel.Characteristic("x", "x", True, True, False, {}, ["mm"], [option] if row[0] != "quality" else [], 1.0)
        assert [c.permits(p, "mm") for p in points] == [holds(row, p) for p in points], row
        assert [c.permits(p / 10, "cm") for p in points] == [holds(row, p / 10 * 10) for p in points], row


def test_reversed_range_is_open(spark):
    r = spark.range(1).select(ranges.range_bounds(F.lit(5.0), F.lit(1.0), F.lit("greater"), F.lit(None).cast("string")).alias("b")).first().b
    assert (r.lower, r.upper, r.lower_inc, r.upper_inc) == (None, None, False, True)


def test_numbers(spark):
    def read(t):
        found = spark.createDataFrame([(t,)], "t string").select(N.numbers_of(X.normalize_text("t")).alias("n")).first()["n"]
        return [(n.kind, n.value if n.kind == "number" else None, n.low, n.high, list(n.dims), n.unit) for n in found]

    assert read("не менее 40 мм") == [("interval", None, 40.0, None, [], "mm")]
    assert read("более 40") == [("interval", None, 40.0, None, [], None)]
    assert read("40-50 см") == [("interval", None, 40.0, 50.0, [], "cm")]
    assert read("от 40 до 50") == [("interval", None, 40.0, 50.0, [], None)]
    assert read("1200x600x750 мм") == [("dims", None, None, None, [1200.0, 600.0, 750.0], "mm")]
    assert read("SKDB-UT6-883") == []


def test_meeting_finds_all_that_hold(spark):
    """Bucketed, wide, open and concrete options: the pairs that hold are those of the whole product."""
    import random

    from pyspark.sql import functions as F

    from nomenclia.operators import ranges

    r = random.Random(5)
    rows = []
    for k in range(120):
        low = r.choice((None, float(r.randint(-50, 50))))
        high = r.choice((None, (low or 0.0) + r.choice((0.5, 3.0, 10.0, 2000.0))))
        rows.append((f"k{k % 3}", "range", f"l{k}", None, low, high, r.random() < 0.5, r.random() < 0.5))
    rows += [("k0", "concrete", f"c{k}", float(k), None, None, True, True) for k in range(10)] + [("k0", "quality", "q", None, None, None, True, True)]
    options = spark.createDataFrame(rows, "key string, kind string, label string, number double, lower double, upper double, lower_inc boolean, upper_inc boolean")
    values = spark.createDataFrame([(k, f"k{k % 4}", x) for k, x in enumerate((-50.0, -0.5, 0.0, 3.0, 9.999999999999, 10.0, 12.5, 50.0, 1999.0) * 4)], "id int, key string, v double")
    opt = ranges.option(*[F.col(c) for c in ("kind", "label", "number", "lower", "upper", "lower_inc", "upper_inc")])
    pairs = lambda df: sorted((x.id, x.label) for x in df.where(ranges.contains(opt, F.col("v"))).collect())
    expected = pairs(values.join(options, "key"))
    assert pairs(ranges.meeting(values, options, ["key"], F.col("v"), 7.0)) == expected and len(expected) > 100
