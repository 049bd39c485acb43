"""Shared pieces: the table reader, durable staging and the word definition."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.shipping import ship

#: Fixed value: a word is a run of characters other than space and ASCII 9-13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="nomenclia-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of the batches that a job's tasks hand to Python.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    with settings(spark, BATCH):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def python_ready(spark: SparkSession) -> None:
    """Get ready to run Python on the executors: the code goes there. Spark's own settings bound a batch in rows and bytes; tasks take it in slices."""
    ship(spark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that a task holds the work of a slice."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Rows of keys that travel to every executor at most (16 bytes each); more are joined by a shuffle.
FEW = 500_000


def few(keys: DataFrame) -> DataFrame:
    """``keys``, a staged table of numbers, marked for broadcast if it is counted to be small."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a 128-bit digest of the columns; the seed comes first, for hashes of several columns are chained."""
    return docs.withColumns({"__k1": F.xxhash64(*columns), "__k2": F.xxhash64(F.lit(1), *columns)})


def n_words(text) -> F.Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
