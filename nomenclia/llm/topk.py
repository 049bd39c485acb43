"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments; a segment is known by its mean and deviation.
By Cauchy-Schwarz the statistics bound a pair's distance from below, and with
the norms its inner product from above. Queries first meet one block of
candidates, whose k-th best score is their threshold. In every other block the
bounds are refined from few segments to many, and only pairs (query, candidate)
that can still reach the query's threshold, which rises on the way, go on; the
survivors' products are computed exactly.

Scale: the query set is a stated share of the rows; each block of candidates
meets each block of queries once, as an own group of bounded size, and gives at
most k rows a query, of which the best k are ranked. Nothing is broadcast.

Cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; only vectors of equal length meet; equal scores
rank by id; scores beyond 64 bits count as the largest (or smallest) long; a
repeated query row is answered once for each; an empty table gives no rows;
other columns, texts of any length among them, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomenclia.llm.common import python_ready, stage

K = 5
BLOCK, QUERIES = 8192, 2048
SEGMENTS = (4, 16, 32)
#: Candidates of a block that are taken at a time, so that the k-th best rises early.
STEP = 256
#: Pairs that are taken at a time.
PAIRS = 1 << 16
#: Share of a step's pairs up to which bounds are computed pair by pair.
SPARSE = 0.2
LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v the floors of ``scale`` times the components."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(sound & finite).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the rows of ``x``: weighted means and deviations."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part, root = x[:, a:b], math.sqrt(b - a)
        mean = part.mean(1)
        out += [mean * root, np.sqrt(np.maximum(0.0, (part * part).mean(1) - mean * mean)) * root]
    return np.stack(out, 1)


def _rows(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of a with the rows ``j`` of b, pair by pair."""
    out = np.empty(len(i), a.dtype)
    for s in range(0, len(i), PAIRS):
        out[s : s + PAIRS] = (a[i[s : s + PAIRS]] * b[j[s : s + PAIRS]]).sum(1)
    return out


class Search:
    """The k best candidates of one block of queries so far; ``met`` and ``computed`` count the pairs seen and those that the bounds let through."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, thresholds: np.ndarray, k: int):
        self.queries, self.q, self.query_ids, self.k = queries, queries.astype(float), query_ids, k
        self.thresholds = thresholds.copy()
        self.levels = [statistics(self.q, s) for s in SEGMENTS]
        self.norms = np.linalg.norm(self.q, axis=1)
        self.row, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = self.computed = 0

    def survivors(self, levels: list[np.ndarray], slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that no level rules out."""
        least = (self.thresholds - slack)[:, None]
        i, j = np.nonzero(self.levels[0] @ levels[0].T >= least)
        for mine, theirs in zip(self.levels[1:], levels[1:], strict=True):
            if len(i) > SPARSE * len(mine) * len(theirs):
                inside = (mine @ theirs.T >= least)[i, j]
            else:
                inside = _rows(mine, theirs, i, j) >= least[i, 0]
            i, j = i[inside], j[inside]
        return i, j

    def block(self, block: np.ndarray, ids: np.ndarray) -> None:
        largest = max(abs(int(self.queries.max(initial=0))), abs(int(self.queries.min(initial=0))), 1) * max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))), 1)
        exact = largest * block.shape[1] < 1 << 52  # then sums of doubles are exact
        x = block.astype(float)
        norms = np.linalg.norm(x, axis=1)
        levels = [statistics(x, s) for s in SEGMENTS]
        slack = 1e-9 * (self.norms * norms.max(initial=0) + 1)
        order = np.lexsort((ids, -norms))
        for start in range(0, len(order), STEP):
            part = order[start : start + STEP]
            i, j = self.survivors([level[part] for level in levels], slack)
            self.met += len(self.q) * len(part)
            self.computed += len(i)
            j = part[j]
            own = self.query_ids[i] == ids[j]
            i, j = i[~own], j[~own]
            scores = _rows(self.q, x, i, j).astype(np.int64) if exact else np.array([max(-LARGEST - 1, min(LARGEST, int(s))) for s in _rows(self.queries.astype(object), block.astype(object), i, j)], np.int64)
            self.add(i, ids[j], scores)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids, scores = (np.concatenate(x) for x in ((self.row, row), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, ~scores, row))  # ~ turns the order of integers round
        row, ids, scores = row[order], ids[order], scores[order]
        count = np.bincount(row, minlength=len(self.q))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        keep = rank < self.k
        self.row, self.ids, self.scores = row[keep], ids[keep], scores[keep]
        full = (rank == self.k - 1) & (scores > -LARGEST - 1)
        self.thresholds[row[full]] = np.maximum(self.thresholds[row[full]], scores[full])


def _searcher(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["q_row", "query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        ids = left["vec_id"].to_numpy(np.int64)
        found = Search(np.stack(left["v"].to_numpy()), ids, left["least"].to_numpy(float), k)
        found.block(np.stack(right["v"].to_numpy()), right["vec_id"].to_numpy(np.int64))
        return pd.DataFrame({"q_row": left["q_row"].to_numpy(np.int64)[found.row], "query_id": ids[found.row], "vec_id": found.ids, "score": found.scores})

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` (both vec_id, v): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    python_ready(spark)
    numbered = stage(queries.withColumn("q_row", F.monotonically_increasing_id()), "queries")
    n, m = vectors.count(), numbered.count()
    rows, columns = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    key = lambda c, parts, salt: F.pmod(F.xxhash64(c, "v", F.lit(salt)), F.lit(parts))
    numbers = lambda to: F.sequence(F.lit(0).cast("long"), F.lit(to - 1).cast("long"))
    first = F.pmod(F.col("c"), F.lit(rows))  # the block that a block of queries meets first
    left = numbered.select("q_row", "vec_id", "v", F.size("v").alias("dim"), key("q_row", columns, 1).alias("c"))
    right = vectors.select("vec_id", "v", F.size("v").alias("dim"), key("vec_id", rows, 2).alias("r"))

    def met(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.groupBy("r", "c", "dim").cogroup(candidates.groupBy("r", "c", "dim")).applyInPandas(_searcher(k), "q_row long, query_id long, vec_id long, score long")

    every = right.select("*", F.explode(numbers(columns)).alias("c"))
    seeds = stage(met(left.select("*", F.lit(float("-inf")).alias("least"), first.alias("r")), every.where(F.col("r") == first)), "seeds")
    least = seeds.groupBy("q_row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    known = left.join(least, "q_row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = met(known.select("*", F.explode(numbers(rows)).alias("r")).where(F.col("r") != first), every.where(F.col("r") != first)).unionByName(seeds)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
