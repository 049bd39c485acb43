"""Results kept by text for a while: a stream of requests in which equal texts share one computation.

A request's text is compared without case and with single spaces. The first
request of a text leads: its text is computed. Those that follow within the time
to live take the leader's result, in the same micro-batch too, so nothing is
computed twice while in flight. A kept text counts as used when it is asked for;
where a bucket is full, the one that was used longest ago goes.

Keyed state holds what is kept: texts are dealt into buckets by a hash, a bucket
has at most ``capacity`` texts, and one event-time timer a bucket clears those
whose time is over. What no request that the watermark lets in can still meet is
not written at all, so a batch of many hours leaves the last one's texts. So state is bounded by buckets and capacity, and no key is hot beyond
the share of its bucket's requests. Results are a table beside the state, by
leader; the state decides who leads, and the table is written once a batch, so a
batch that is run again after a crash finds it there.

Cases: a null text is the empty text; requests of a micro-batch are taken in
order of time, then id; requests later than the watermark are dropped by Spark;
a null time comes first and is treated as the epoch; ids tell requests apart and
must be unique within the time to live; an empty batch does nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nomenclia.shipping import ship
from nomenclia.staging import staged

#: Fixed value: texts that are kept at most.
CAPACITY = 256
BUCKETS = 64
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LED = "id long, at timestamp, text string, leader long, bucket int"


def same_text(text):
    """What texts are compared by."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))


class Kept:
    """The texts that one bucket keeps: leader, time of computation and of last use, in milliseconds."""

    def __init__(self, entries: dict[str, tuple[int, int, int]], ttl: int, capacity: int) -> None:
        self.entries, self.ttl, self.capacity = entries, ttl, capacity
        self.before = dict(entries)
        self.uses = [(used, since, text) for text, (_, since, used) in entries.items()]  # a heap; entries used since have another item
        heapq.heapify(self.uses)

    def ask(self, text: str, request: int, at: int) -> int:
        """The request that leads for ``text``: itself if nothing of it is kept."""
        leader, since, used = self.entries.get(text, (request, at, at))
        if text not in self.entries or at >= since + self.ttl:
            leader, since = request, at
        self.entries[text] = (leader, since, max(at, used))
        heapq.heappush(self.uses, (max(at, used), since, text))
        while len(self.entries) > self.capacity:
            used, since, oldest = heapq.heappop(self.uses)
            if self.entries.get(oldest, (None,))[1:] == (since, used):
                del self.entries[oldest]
        return leader

    def expire(self, now: int) -> None:
        self.entries = {t: e for t, e in self.entries.items() if e[1] + self.ttl > now}

    def changes(self) -> tuple[list[str], dict[str, tuple[int, int, int]]]:
        """Texts that are gone, and entries that are new or changed."""
        return [t for t in self.before if t not in self.entries], {t: e for t, e in self.entries.items() if self.before.get(t) != e}


class Leaders(StatefulProcessor):
    """The leader of each request of a bucket."""

    def __init__(self, ttl: int, capacity: int, delay: int) -> None:
        self.ttl, self.capacity, self.delay = ttl, capacity, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("kept", "text string", "leader long, since long, used long")

    def _kept(self) -> Kept:
        return Kept({k[0]: tuple(v) for k, v in self.state.iterator()}, self.ttl, self.capacity)

    def _write(self, kept: Kept) -> None:
        gone, new = kept.changes()
        for text in gone:
            self.state.removeKey((text,))
        for text, entry in new.items():
            self.state.updateValue((text,), entry)
        if kept.entries:
            self.handle.registerTimer(min(since for _, since, _ in kept.entries.values()) + self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(rows)
        asked["ms"] = asked["at"].fillna(pd.Timestamp(0)).astype("datetime64[us]").astype("int64") // 1000
        asked = asked.sort_values(["at", "id"], na_position="first", kind="stable")
        kept = self._kept()
        leaders = [kept.ask(t, i, at) for t, i, at in zip(asked["same"], asked["id"].tolist(), asked["ms"].tolist(), strict=True)]
        # The watermark will be no less than this, so what is over by then is over for every later request.
        kept.expire(int(asked["ms"].iloc[-1]) - self.delay)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self._write(kept)
        yield pd.DataFrame({"id": asked["id"], "at": asked["at"], "text": asked["text"], "leader": leaders, "bucket": int(key[0])}).astype({"bucket": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        kept.expire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self._write(kept)
        return iter([])

    def close(self) -> None:
        pass


def leaders(requests: DataFrame, ttl: int, capacity: int = CAPACITY, buckets: int = BUCKETS, delay: str = "1 minute") -> DataFrame:
    """(LED) of ``requests`` (id long, at timestamp, text): the request whose result each of them takes.

    ``ttl`` is in milliseconds of event time, ``capacity`` is of one bucket.
    ``requests`` is a stream, read with the RocksDB state store, or a table.
    """
    ship(requests.sparkSession)
    requests.sparkSession.streams.active  # noqa: B018  a table's state needs the coordinator that this starts
    keyed = requests.select("id", "at", "text", same_text(F.col("text")).alias("same"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("same"), F.lit(buckets)).cast("int")).withWatermark("at", delay)
    late = requests.sparkSession.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {delay}"))).first()[0]
    return keyed.groupBy("bucket").transformWithStateInPandas(Leaders(ttl, capacity, late), LED, "Append", "EventTime")


def run_cached(requests: DataFrame, target: str, compute: Callable[[DataFrame], DataFrame], ttl: int, capacity: int = CAPACITY, buckets: int = BUCKETS, delay: str = "1 minute") -> StreamingQuery:
    """Answer the stream ``requests`` as far as it is there now, and stop; run again for what came since.

    ``compute`` takes (id, text), one row a text that leads, and returns id and a
    column ``result``. Read what came of it with ``answers``.
    """

    def each(batch: DataFrame, number: int) -> None:
        led = staged(batch, "led")
        spark = led.sparkSession
        if led.isEmpty() or _written(spark, f"{target}/requests/batch={number}"):
            return
        first = led.where("id = leader").select("id", "text")
        if not _written(spark, f"{target}/results/batch={number}"):
            compute(first).select(F.col("id").alias("leader"), "result").write.mode("overwrite").parquet(f"{target}/results/batch={number}")
        led.select("id", "at", "leader").write.mode("overwrite").parquet(f"{target}/requests/batch={number}")

    found = leaders(requests, ttl, capacity, buckets, delay)
    spark = requests.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the setting that it was started with
    try:
        return _started(found, target, each)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _started(found: DataFrame, target: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return found.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder has been completed."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def answers(spark: SparkSession, target: str) -> DataFrame:
    """(id, at, leader, result) of every request that has been answered."""
    asked = spark.read.parquet(f"{target}/requests").drop("batch")
    return asked.join(spark.read.parquet(f"{target}/results").drop("batch"), "leader", "left").select("id", "at", "leader", "result")
