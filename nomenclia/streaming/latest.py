"""The latest request wins: of a client's requests only the newest one's result is shown.

Requests of a client are numbered. A new request makes those before it obsolete,
whether or not their results have come, and results come in any order. Requests
that follow each other within ``gap`` are one session; its state is the newest
request and the newest result, kept by Spark's session windows under a
watermark. A session closes when the watermark passes its end: then its result is
given once, and what comes later is dropped. Nothing is held of a closed session.

The state merges in any order (largest number wins), so it is combined before it
is shuffled and a busy client is one row a partition.

Cases: a session whose newest request has no result gives none (null), as the
older results are obsolete; of results with one number the largest struct of time
and value stays; null clients are a client of their own; rows without a time or
number are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP, DELAY = "30 minutes", "10 minutes"


def latest(events: DataFrame, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """(client, start, end, number, result, obsolete) of ``events`` (client, number, at, kind, value), by session.

    ``kind`` is 'request' or 'result'. ``obsolete`` counts the results that were
    not the newest request's. ``events`` is a stream, in append mode, or a table.
    """
    sound = events.where("at is not null and number is not null").withWatermark("at", delay)
    session = F.session_window("at", gap).alias("session")
    came = F.col("kind") == "result"
    # Results by number: the newest request's is the one at the end, if it is there.
    folded = sound.groupBy("client", session).agg(
        F.max("number").alias("number"),
        F.max(F.when(came, F.struct("number", "at", "value"))).alias("last"),
        F.count_if(came).alias("results"),
    )
    shown = F.col("last.number") == F.col("number")
    return folded.select(
        "client",
        F.col("session.start").alias("start"),
        F.col("session.end").alias("end"),
        "number",
        F.when(shown, F.col("last.value")).alias("result"),
        (F.col("results") - F.when(shown, 1).otherwise(0)).alias("obsolete"),
    )
