"""Rows in the order of their content over all partitions, and the runs of equal texts in it.

Sampled splitters deal the rows into ranges of bounded keys: what orders the
texts (a fingerprint, or leading characters and then a digest), then what orders
equal texts, and last the row's number. So a group of copies, and even a group
of identical rows, is cut like any other content, and no splitter holds a whole
text. Spark's external sort puts equal texts next to each other, with the whole
text as a key of its own; a task then compares each row with the one before.

A run that goes on beyond its partition is mended by a table of the partitions'
first and last runs: two rows a partition, whose whole texts are compared with
those of the neighbour. The fingerprint must tell texts apart as SHA-256 does,
since rows of other texts between equal ones would part a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import python_ready, stage

#: What ``local_runs`` adds to the columns that it carries.
RUN = "pid int, run long, head boolean, alone boolean, first_id long, edge string"


class Neighbours:
    """The rows of one partition, each compared with the one before; the last row waits for what follows it."""

    def __init__(self, pid: int, text: str, key: str, schema: pa.Schema) -> None:
        self.pid, self.text, self.key, self.schema = pid, text, key, schema
        self.waiting: pa.RecordBatch | None = None
        self.same, self.run, self.first = False, -1, None
        self.began = False

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.waiting is not None:
            batch = pa.Table.from_batches([self.waiting, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        texts = batch.column(self.text)
        same = np.append(self.same, pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool))
        out = self._given(batch.slice(0, n - 1), same[: n - 1], ~same[1:])
        self.waiting, self.same = batch.slice(n - 1), bool(same[-1])
        return out

    def last(self) -> pa.RecordBatch:
        return self._given(self.waiting, np.array([self.same]), np.array([False]), ends=True)

    def _given(self, rows: pa.RecordBatch, same: np.ndarray, parts: np.ndarray, *, ends: bool = False) -> pa.RecordBatch:
        """``rows`` with their runs; ``parts`` tells whether another text follows."""
        n = rows.num_rows
        edge = np.zeros(n, bool)
        if n:
            edge[0] |= not self.began
            edge[-1] |= ends
            self.began = True
        runs = self.run + np.cumsum(~same)
        ids = pa.concat_arrays([pa.array([self.first], pa.int64()), rows.column(self.key).cast(pa.int64())])
        first = ids.take(pa.array(np.maximum.accumulate(np.where(same, 0, np.arange(1, n + 1)))))
        if n:
            self.run, self.first = int(runs[-1]), first[-1].as_py()
        texts = pa.array([rows.column(self.text)[k].as_py() if e else None for k, e in enumerate(edge.tolist())], self.schema.field("edge").type)
        own = [rows.column(f.name).cast(f.type) for f in list(self.schema)[:-6]]
        added = [np.full(n, self.pid, np.int32), runs, ~same, ~same & parts & ~edge]
        return pa.RecordBatch.from_arrays([*own, *map(pa.array, added), first, texts], schema=self.schema)


def local_runs(rows: DataFrame, by: list[Column], text: str, order: list[Column], key: str, carry: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """``carry`` of ``rows``, with the run of equal ``text`` of each row in its partition; staged.

    ``by`` are bounded columns that order the texts, ``order`` those that order
    equal texts, ``key`` is the long identifier; ``added``
    are columns that are computed once the rows are dealt. New: the partition and the
    run's number in it, whether the run starts at the row (``head``), whether
    the row is a run of its own for sure (``alone``), the identifier of the
    run's first row, and the text itself at both ends of a partition (``edge``).
    """
    python_ready(rows.sparkSession)
    number = F.col("__number")
    sorted_rows = rows.withColumn("__number", F.monotonically_increasing_id()).repartitionByRange(*by, *order, number).sortWithinPartitions(*by, F.col(text), *order, number)
    sorted_rows = sorted_rows.withColumns(added or {})
    schema = T.StructType([*(sorted_rows.schema[c] for c in carry), *T.StructType.fromDDL(RUN)])
    arrow = to_arrow_schema(schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        near = Neighbours(TaskContext.get().partitionId(), text, key, arrow)
        for batch in batches:
            if batch.num_rows:
                yield near.add(batch)
        if near.waiting is not None:
            yield near.last()

    return stage(sorted_rows.select(*dict.fromkeys([*carry, key, text])).mapInArrow(compared, schema), "runs")


def chains(local: DataFrame) -> DataFrame:
    """(pid, run, chain_pid, chain_run, chain_first) of the runs at the ends of partitions that are part of a longer run, itself included; two rows a partition at most."""
    edges = local.where("edge is not null").groupBy("pid").agg(F.min(F.struct("run", "edge", "first_id")).alias("a"), F.max(F.struct("run", "edge", "first_id")).alias("b"))
    edges = stage(edges, "edges")
    by = Window.orderBy("pid")  # one row a partition, without its texts
    before = edges.select("pid", F.lag("pid").over(by).alias("before"))
    joined = edges.join(before, "pid").join(edges.select(F.col("pid").alias("before"), F.col("b.edge").alias("other")), "before", "left")
    flags = joined.select("pid", F.coalesce(F.col("a.edge") == F.col("other"), F.lit(False)).alias("goes_on"), (F.col("a.run") == F.col("b.run")).alias("single"))
    starts = flags.select("*", F.max(F.when(~(F.col("single") & F.col("goes_on")), F.col("pid"))).over(by).alias("start")).withColumn("start_before", F.lag("start").over(by))
    met = starts.join(edges.select("pid", F.col("a.run").alias("a"), F.col("b.run").alias("b")), "pid")
    last = met.select("pid", F.col("b").alias("run"), F.col("start").alias("chain_pid"))
    first = met.where("goes_on and not single").select("pid", F.col("a").alias("run"), F.col("start_before").alias("chain_pid"))
    heads = edges.select(F.col("pid").alias("chain_pid"), F.col("b.run").alias("chain_run"), F.col("b.first_id").alias("chain_first"))
    return stage(last.unionByName(first).join(heads, "chain_pid").select("pid", "run", "chain_pid", "chain_run", "chain_first"), "chains")


def whole_runs(local: DataFrame, joined: DataFrame) -> DataFrame:
    """``local`` with the runs of the whole table: ``head`` and ``first_id`` are those of the whole run, ``chain_pid`` and ``chain_run`` are set at the ends of partitions.

    ``joined``, of ``chains``, has two rows a partition at most, so it is broadcast.
    """
    later = F.col("chain_pid").isNotNull() & (F.col("chain_pid") != F.col("pid"))
    met = local.drop("edge").join(F.broadcast(joined), ["pid", "run"], "left")
    return met.withColumns({"head": F.col("head") & ~later, "first_id": F.when(later, F.col("chain_first")).otherwise(F.col("first_id"))}).drop("chain_first")


def with_sizes(runs: DataFrame) -> DataFrame:
    """``runs``, of ``whole_runs``, with the rows of each run (``group_size``).

    Rows that are alone are not shuffled. The others are counted and joined by
    partition and run, so that a key has no more rows than a partition.
    """
    several = runs.where("not alone")
    counted = stage(several.groupBy("pid", "run", "chain_pid", "chain_run").agg(F.count("*").alias("n")), "counted")
    of_chain = counted.where("chain_pid is not null").groupBy("chain_pid", "chain_run").agg(F.sum("n").alias("whole"))
    sizes = counted.join(F.broadcast(of_chain), ["chain_pid", "chain_run"], "left").select("pid", "run", F.coalesce("whole", "n").alias("group_size"))
    return several.join(sizes, ["pid", "run"]).unionByName(runs.where("alone").withColumn("group_size", F.lit(1).cast("long")))
