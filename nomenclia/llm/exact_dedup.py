"""Exact duplicates by sorting the table by content.

Texts are equal when they are identical without white space (the characters of
``SPACE``). Splitters sampled from the texts' leading characters and digests
range-partition the normalised texts, Spark's external sort puts equal ones next
to each other, and each is compared in whole with the one before it; see
``content_sort``. Of equal texts the row stays that has the most code points
before normalisation, then the smallest doc_id.

Scale: one shuffle of the normalised texts; the original is not moved. A group
of copies is cut over as many partitions as its rows need, because equal texts
are ranged by length, doc_id and row as well. Only rows with equals are counted
and joined, by partition and run. Nothing but splitters of bounded size and
counts reaches the driver.

Cases: null and empty texts and texts of white space alone are one group; a null
doc_id comes last among equal texts, and ``keep_id`` is null where only such
rows are equal; of rows that repeat whole, exactly one is kept, and as their
``keep_id`` is the same, ``kept`` tells which; very long texts are one row, and
are compared in whole; an empty table gives no rows; other columns of ``docs``
are not read by ``groups`` and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nomenclia.llm.content_sort import chains, local_runs, whole_runs, with_sizes

#: Fixed value: space and ASCII 9-13.
SPACE = " \t\n\x0b\x0c\r"
#: Leading characters of a text that splitters see; beyond them its digest parts texts.
LEADING = 32


def _runs(rows: DataFrame, carry: list[str]) -> DataFrame:
    """The runs of ``rows`` (text, doc_id and what is carried), with the digest of the normalised text where it is carried."""
    text = F.coalesce("text", F.lit(""))
    keyed = rows.withColumns({"norm": F.translate(text, SPACE, ""), "size": F.length(text)}).withColumn("text_sha256", F.sha2("norm", 256)).drop("text")
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    local = local_runs(keyed, [F.substring("norm", 1, LEADING), F.col("text_sha256")], "norm", order, "doc_id", carry)
    return whole_runs(local, chains(local))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text)."""
    found = with_sizes(_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text_sha256"]))
    return found.select("doc_id", F.col("first_id").alias("keep_id"), "group_size", F.col("head").alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns; whole rows are sorted along."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _runs(rows, ["row"]).where("head").select("row.*")
