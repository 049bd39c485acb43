"""Uploads as a stream: files arrive, their rows are analysed once, states of uploads and rows are a log with snapshots.

A row's key is its upload's path and row number, so a micro-batch that is run
again after a crash analyses nothing that is done: finished keys are anti-joined
first. An upload and its rows are pending when they arrive, then processing,
then done or an error of their own. The log is append-only, by micro-batch; the
state of a key is its latest entry. ``compact`` folds the log into a snapshot,
ordered by key, so that a poll reads the snapshot and the batches after it, and
the lookup of one row a few row groups.

Rows that make the analysis fail are found by halves, after one more try of all
of them, and become errors of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nomenclia.sources.csv_lines import MOST_BYTES, read_uploads, valid_input
from nomenclia.sources.versions import Versioned
from nomenclia.staging import staged

# ---------------------------------------------------------------- fixed values
PENDING, PROCESSING, DONE, ERROR = "pending", "processing", "done", "error"
FINAL = (DONE, ERROR)
# ----------------------------------------------------------------
ITEMS = "path string, row_number int, description string, status string, result_status string, code string, candidates int, error string, at timestamp, batch long"
STATES = "path string, status string, total long, error string, at timestamp, batch long"
KEYS = {"items": ["path", "row_number"], "states": ["path"]}
SCHEMAS = {"items": ITEMS, "states": STATES}
RESULTS = "id long, result_status string, code string, candidates int"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # the table does not exist before the first batch
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resolved(rows: DataFrame, analyze: Callable[[DataFrame], DataFrame], turn: int = -1) -> DataFrame:
    """(RESULTS) of ``rows`` (id, text), without those that make ``analyze`` fail; staged."""
    try:
        found = analyze(rows).select("id", F.col("status").alias("result_status"), "code", F.size("remaining").alias("candidates"))
        return staged(found, "results")
    except PySparkException:
        if turn < 0:  # what failed may have been the cluster
            return resolved(rows, analyze, 0)
        if rows.limit(2).count() < 2:
            return rows.sparkSession.createDataFrame([], RESULTS)
        half = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2))
        one, two = (resolved(rows.where(half == k), analyze, turn + 1) for k in (0, 1))
        return one.unionByName(two)


def run_batches(spark: SparkSession, uploads: str, target: str, analyze: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process what is under ``uploads`` now and stop; run again for what came since.

    ``analyze`` takes (id, text) and returns id, status, code and remaining.
    One query a checkpoint keeps runs apart.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(uploads)

    def each(batch: DataFrame, number: int) -> None:
        rows = staged(read_uploads(batch.where(F.col("length") <= MOST_BYTES)), "uploads")
        now, none = F.current_timestamp().alias("at"), F.lit(None).cast("string").alias("error")
        log = lambda df, name: df.write.mode("append").parquet(f"{target}/{name}/batch={number}")
        good = rows.where("error is null")
        totals = good.groupBy("path").agg(F.count("*").alias("total"))
        state = lambda name: totals.select("path", F.lit(name).alias("status"), "total", none, now)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("result_status", "string"), ("code", "string"), ("candidates", "int"), ("error", "string"))]
        item = lambda df, name: df.select("path", "row_number", "description", F.lit(name).alias("status"), *nothing, now)
        failed = rows.where("error is not null").select("path", F.lit(ERROR).alias("status"), F.lit(0).cast("long").alias("total"), "error", now)
        finished = current(spark, target, "items").where(F.col("status").isin(*FINAL)).select("path", "row_number")
        todo = staged(good.join(finished, ["path", "row_number"], "left_anti").withColumn("id", F.xxhash64("path", "row_number")).withColumn("sound", valid_input(F.col("description"))), "rows")
        log(failed.unionByName(state(PENDING)), "states")
        log(item(todo, PENDING), "items")
        log(state(PROCESSING), "states")
        log(item(todo, PROCESSING), "items")
        results = resolved(todo.where("sound").select("id", F.col("description").alias("text")), analyze)
        done = todo.join(results, "id", "left")
        ok = F.col("result_status").isNotNull()
        error = F.when(~F.col("sound"), "invalid description").when(~ok, "the analysis failed")
        log(done.select("path", "row_number", "description", F.when(ok, DONE).otherwise(ERROR).alias("status"), "result_status", "code", "candidates", error.alias("error"), now), "items")
        log(state(DONE), "states")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


# ------------------------------------------------------------ states
def _snapshot(spark: SparkSession, target: str, name: str) -> tuple[DataFrame | None, int]:
    """The last snapshot of a log and the last batch that it holds."""
    kept = Versioned(spark, f"{target}/snapshots/{name}", "path")
    if not kept.version():
        return None, -1
    rows = kept.read()
    upto = rows.agg(F.max("upto")).first()[0]
    return rows, -1 if upto is None else upto


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The latest entry of each key; a state further on comes after another of one moment."""
    rank = F.array_position(F.array(*map(F.lit, (PENDING, PROCESSING, DONE, ERROR))), F.col("status"))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("at", rank.alias("rank"))).alias("r")).select(*keys, "r.*")


def current(spark: SparkSession, target: str, name: str = "items", where: str = "true") -> DataFrame:
    """The state of each key of ``name`` ('items' or 'states'), of those that ``where`` holds of: the snapshot and the batches after it.

    ``where`` is about the keys, so it reaches both scans.
    """
    kept, upto = _snapshot(spark, target, name)
    tail = _table(spark, f"{target}/{name}", SCHEMAS[name]).where(F.col("batch") > upto).where(where)
    if kept is not None:
        tail = tail.unionByName(kept.drop("upto").where(where))
    return _latest(tail, KEYS[name]).drop("batch")


def compact(spark: SparkSession, target: str) -> dict[str, int]:
    """Fold the logs into new snapshots; returns their rows. What is written meanwhile is read from the log."""
    out = {}
    for name, keys in KEYS.items():
        kept, upto = _snapshot(spark, target, name)
        tail = _table(spark, f"{target}/{name}", SCHEMAS[name]).where(F.col("batch") > upto)
        last = tail.agg(F.max("batch")).first()[0]
        if last is None:
            out[name] = 0 if kept is None else kept.count()
            continue
        # The last batch may still be written to, so it stays in the log too.
        rows = tail if kept is None else tail.unionByName(kept.drop("upto"))
        folded = _latest(rows, keys).withColumn("upto", F.lit(last - 1).cast("long"))
        out[name] = Versioned(spark, f"{target}/snapshots/{name}", "path").replace(folded.repartitionByRange(*keys).sortWithinPartitions(*keys))
    return out


def batch_status(spark: SparkSession, target: str) -> DataFrame:
    """Latest state of each upload with its progress."""
    items = current(spark, target, "items").groupBy("path").agg(F.count_if(F.col("status").isin(*FINAL)).alias("processed"))
    out = current(spark, target, "states").join(items, "path", "left").select("path", "status", "total", F.coalesce("processed", F.lit(0)).alias("processed"), "error")
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * F.col("processed") / F.col("total"))))


def batch_items(spark: SparkSession, target: str) -> DataFrame:
    """Rows of all uploads in order, the latest state of each."""
    return current(spark, target, "items").orderBy("path", "row_number")


def item(spark: SparkSession, target: str, path: str, row_number: int) -> DataFrame:
    """One row of an upload; both scans are given the key."""
    told = path.replace("\\", "\\\\").replace("'", "\\'")
    return current(spark, target, "items", f"path = '{told}' and row_number = {int(row_number)}")


def pending_items(spark: SparkSession, target: str) -> DataFrame:
    """Rows that are pending or processing, in order."""
    return current(spark, target, "items").where(~F.col("status").isin(*FINAL)).orderBy("path", "row_number")


def unfinished(spark: SparkSession, target: str) -> DataFrame:
    """Uploads that are pending or processing."""
    return current(spark, target, "states").where(~F.col("status").isin(*FINAL)).select("path")
