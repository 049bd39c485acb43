"""Streams with state: results kept by text, and the latest request's result."""

import random
from collections import OrderedDict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nomenclia.streaming import cache, latest

REQUESTS = "id long, at timestamp, text string"


@pytest.fixture
def stateful(spark):
    spark.conf.set(cache.PROVIDER, cache.ROCKS)
    yield spark
    spark.conf.unset(cache.PROVIDER)


def plain_leaders(requests, ttl, capacity):
    """One bucket's requests in order: a dictionary ordered by use."""
    kept, out = OrderedDict(), {}
    for i, at, text in requests:
        key = " ".join((text or "").split()).lower()
        leader, since = kept.pop(key, (i, at))
        if at >= since + ttl:
            leader, since = i, at
        kept[key] = (leader, since)
        if len(kept) > capacity:
            kept.popitem(last=False)
        out[i] = leader
    return out


def requests_of(n, texts, seed):
    r = random.Random(seed)
    at = 1_700_000_000_000
    out = []
    for k in range(n):
        at += r.randint(1, 4000)
        out.append((k, at, r.choice(texts)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, ms long, text string").select("id", F.timestamp_millis("ms").alias("at"), "text")


@pytest.mark.parametrize("capacity", [1000, 3])
def test_leaders_of_a_table(stateful, capacity):
    texts = [f"text {k}" for k in range(9)] + ["Text  1 ", " TEXT 2", None, ""]
    rows = requests_of(400, texts, 4)
    got = {x.id: x.leader for x in cache.leaders(frame(stateful, rows), 60_000, capacity, 1).collect()}
    assert got == plain_leaders(rows, 60_000, capacity)
    assert len(set(got.values())) > len(texts)


def test_equal_texts_are_computed_once_over_restarts(spark, tmp_path):
    texts = [f"text {k}" for k in range(12)]
    rows = requests_of(300, texts, 5)
    computed = []

    def compute(docs):
        computed.extend(docs.collect())
        return docs.select("id", F.upper("text").alias("result"))

    for part in range(3):  # new files come between runs, and the last run finds none
        if part < 2:
            frame(spark, rows[150 * part : 150 * part + 150]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
        cache.run_cached(stream, str(tmp_path / "out"), compute, 120_000, 4096, 5).awaitTermination()
    expected = plain_leaders(rows, 120_000, 4096)
    got = cache.answers(spark, str(tmp_path / "out")).collect()
    assert {x.id: x.leader for x in got} == expected and len(got) == 300
    assert all(x.result == rows[x.id][2].upper() for x in got)
    assert sorted(x.id for x in computed) == sorted(set(expected.values()))


def test_a_batch_that_is_run_again_finds_its_results(spark, tmp_path):
    frame(spark, requests_of(40, ["a", "b"], 6)).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []

    def compute(docs, fail):
        calls.append(docs.count())
        if fail:
            raise RuntimeError("the run stops here")
        return docs.select("id", F.lit("x").alias("result"))

    for fail in (True, False):
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
        run = cache.run_cached(stream, str(tmp_path / "out"), lambda docs, fail=fail: compute(docs, fail), 10**9)
        if fail:
            with pytest.raises(Exception, match="the run stops here"):
                run.awaitTermination()
        else:
            run.awaitTermination()
    assert calls == [2, 2] and cache.answers(spark, str(tmp_path / "out")).where("result = 'x'").count() == 40


EVENTS = "client long, number long, at timestamp, kind string, value string"


def plain_latest(events, gap):
    out = []
    for client in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == client), key=lambda e: e[2])
        sessions = []
        for e in own:
            if sessions and e[2] < sessions[-1][-1][2] + gap:
                sessions[-1].append(e)
            else:
                sessions.append([e])
        for s in sessions:
            newest, came = max(e[1] for e in s), [e for e in s if e[3] == "result"]
            last = max((e for e in came if e[1] == newest), key=lambda e: (e[2], e[4]), default=None)
            out.append((client, newest, last and last[4], len(came) - (last is not None)))
    return sorted(out, key=str)


def events_of(n, seed):
    r = random.Random(seed)
    out, at = [], 1_700_000_000
    for k in range(n):
        at += r.choice((5, 20, 60, 2000))
        client = r.choice((1, 2, 3, None))
        out.append((client, k, at, "request", None))
        if r.random() < 0.8:
            out.append((client, k, at + r.randint(1, 300), "result", f"r{k}"))
    return out


def test_latest(spark, tmp_path):
    events = events_of(150, 3)
    shuffled = events[:]
    random.Random(1).shuffle(shuffled)
    df = lambda rows: spark.createDataFrame(rows, "client long, number long, s long, kind string, value string").select("client", "number", F.timestamp_seconds("s").alias("at"), "kind", "value")
    given = lambda df: sorted(((x.client, x.number, x.result, x.obsolete) for x in df.collect()), key=str)
    expected = plain_latest(events, 1800)
    assert given(latest.latest(df(shuffled))) == expected
    # As a stream: arrivals out of order within the delay, over two runs; then an event far ahead closes all sessions, and one far behind is dropped.
    parts = (events[:200], events[200:] + [(9, 0, 2_000_000_000, "request", None)], [(1, 10**6, 1_700_000_000, "result", "late"), (9, 1, 2_000_000_001, "request", None)])
    for part in parts:
        rows = part[:]
        random.Random(2).shuffle(rows)
        df(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        latest.latest(stream, delay="2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert given(spark.read.parquet(str(tmp_path / "out"))) == expected


class Handle:
    """Counts what a processor writes and registers."""

    def __init__(self):
        self.kept, self.timers, self.writes = {}, set(), 0

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter([((t,), e) for t, e in self.kept.items()])

    def updateValue(self, key, entry):
        self.writes += 1
        self.kept[key[0]] = entry

    def removeKey(self, key):
        del self.kept[key[0]]

    def listTimers(self):
        return iter(self.timers)

    registerTimer, deleteTimer = (lambda self, at: self.timers.add(at)), (lambda self, at: self.timers.discard(at))


def test_a_long_batch_leaves_what_later_requests_can_meet():
    rows = pd.DataFrame({"id": range(3000), "at": pd.to_datetime([i * 1000 for i in range(3000)], unit="ms"), "text": [f"text {i % 1000}" for i in range(3000)], "same": [f"text {i % 1000}" for i in range(3000)]})
    handle, leaders = Handle(), cache.Leaders(100_000, 5000, 60_000)
    leaders.init(handle)
    out = pd.concat(leaders.handleInputRows((3,), iter([rows]), None))
    assert out["leader"].tolist() == list(range(3000))  # a text comes again after ten times its time
    assert sorted(e[1] for e in handle.kept.values()) == [1000 * i for i in range(2840, 3000)] and handle.writes == 160
    assert handle.timers == {2_840_000 + 100_000}


def test_a_full_bucket_drops_the_longest_unused_at_once():
    kept, plain = cache.Kept({}, 10**9, 500), []
    for i in range(60_000):
        kept.ask(f"text {i % 1777 * 7919 % 1500}", i, i)
    for i in range(60_000):
        plain.append(f"text {i % 1777 * 7919 % 1500}")
    assert set(kept.entries) == set(list(dict.fromkeys(reversed(plain)))[:500])
