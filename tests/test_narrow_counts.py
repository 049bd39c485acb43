"""Counts of narrowing and scores of names, made once for descriptions that are alike."""

import pytest
from pyspark.sql import functions as F

from nomenclia import catalog_queries as Q
from nomenclia.operators import index, match, narrow


def test_counts_against_the_fold(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3] if i % 7 else None, "uv"[i % 5 // 3] if i % 11 else None) for i in range(60)]
    part = spark.createDataFrame(rows, "id long, pool string, b string, t string")
    asked = part.unionByName(spark.createDataFrame([(100, "a", "none", "u"), (101, "b", "x", "none"), (102, None, "x", "u"), (103, "c", "x", "u")], part.schema))
    got = {r.id: (r.n0, r.n1, r.n2) for r in narrow.narrow_counts(part, asked, "pool", ["b", "t"]).collect()}
    wanted = {}
    for i, pool, *values in asked.collect():
        left = [r for r in rows if r[1] == pool and pool]
        counts = [len(left)]
        for k, v in enumerate(values):
            left = [r for r in left if v is not None and r[2 + k] == v] or left
            counts.append(len(left))
        if left:
            wanted[i] = tuple(counts)
    assert got == wanted and got[100][0] == got[100][1] > got[100][2]


@pytest.mark.parametrize("name", ["narrow_stages", "narrow_stages_whole"])
def test_stages_are_not_pairs(spark, name):
    """No plan joins the parts of a name with each other: a join of part with itself by name alone has no count below it."""
    plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "count(1)" in plan


def test_names_are_scored_once_for_like_texts(spark):
    positions = spark.createDataFrame([("1", "red ring"), ("2", "red bolt"), ("3", "blue ring")], "code string, name string")
    posting = index.postings(index.name_groups(positions))
    docs = spark.createDataFrame([(i, f"red ring, size {i} mm") for i in range(9)] + [(20, "size 4"), (21, "blue red"), (22, None)], "id long, text string")
    every = match.description_stems(docs)
    stems, of = match.shared(docs, posting)
    assert {r.id for r in stems.select("id").distinct().collect()} == {0, 21}
    idf = index.idf(posting, index.name_groups(positions))
    rows = lambda df: sorted((r.id, r.norm, round(r.score, 9), r.coverage, r.evidence, r.head) for r in df.collect())
    assert rows(match.for_each(match.score_names(stems, posting, idf), of)) == rows(match.score_names(every, posting, idf))
    assert of.where(F.col("id") == 20).isEmpty()
