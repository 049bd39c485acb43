"""Dyadic blocks of spans cover them exactly, and only levels that a span's length allows are tried; short spans are never cut into blocks or places."""

import random

import pytest
from pyspark.sql import functions as F

from nomenclia.operators import spans


def test_blocks(spark):
    rows = [(0, 1), (3, 4), (5, 55), (59, 109), (0, 64), (7, 2**20 + 3), (2**30 - 1, 2**30 + 1)]
    blocks = spans._blocks(F.col("a"), F.col("b"))
    assert "LOG2" in str(blocks).upper()
    for r in spark.createDataFrame(rows, "a long, b long").select("a", "b", blocks.alias("x")).collect():
        at = r.a
        for x in sorted(r.x, key=lambda x: x.block << x.level):
            assert x.block << x.level == at
            at += 1 << x.level
        assert at == r.b


def plain(rows):
    """What shows at each end of a span, by looking at all spans of the text."""
    out = []
    for doc in sorted({r[0] for r in rows}, key=str):
        own = [r for r in rows if r[0] == doc]
        ends = sorted({e for r in own for e in r[2:4]})
        for a, b in zip(ends, ends[1:]):
            over = [(-r[5], r[1], r[4]) for r in own if r[2] <= a and b <= r[3]]
            if not over:
                continue
            shown = min(over)[1:]
            if out and out[-1][0] == doc and out[-1][2] == a and tuple(out[-1][3:]) == shown:
                out[-1][2] = b
            else:
                out.append([doc, a, b, *shown])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest", [1, spans.WORD, spans.WORD + 1, spans.WORD + 2, 2 * spans.WORD + 1, 700, 2**22])
def test_pieces_of_any_length(spark, longest):
    r = random.Random(longest)
    rows = [(doc, n, a, a + r.choice((1, longest, r.randint(1, longest))), r.choice("xyz"), r.randint(0, 2)) for doc in (*range(25), None) for n in range(r.randint(0, 12)) for a in (r.choice((0, 62, 63, 126, r.randint(0, 3 * longest))),)]
    # Two spans of one number and kind that touch are one piece, in a word and over its edge.
    rows += [(90, 1, 3, 4, "x", 0), (90, 1, 4, 5, "x", 0), (91, 1, 62, 63, "x", 0), (91, 1, 63, 64, "x", 0), (92, 1, 0, 63, "x", 1), (92, 2, 63, 64, "x", 1)]
    df = spark.createDataFrame(rows, "id long, span int, start long, end long, kind string, rank int")
    got = spans.pieces(df, F.col("rank"))
    assert sorted(map(tuple, got.select("id", "start", "end", "span", "kind").collect()), key=str) == plain(rows)


def test_short_spans_are_not_cut_into_blocks(spark):
    """What is sorted and shuffled is the spans and what meets the edge of a word, not blocks: no join."""
    df = spark.range(1000).selectExpr("id % 50 as id", "cast(id as int) as span", "id % 60 as start", "id % 60 + 1 + id % 50 as end", "'name' as kind")
    got = spans.pieces(df, spans.by_kind(F.col("kind")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "level" not in plan
