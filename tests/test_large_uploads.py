"""Uploads of nations with more suppliers than one upload may have rows."""

import duckdb
from pyspark.sql import functions as F

from nomenclia import change_queries as Q
from nomenclia.sources.csv_lines import MOST_ROWS


def test_more_rows_than_an_upload_takes(spark, tmp_path):
    path = str(tmp_path / "supplier.parquet")
    n = 2 * (MOST_ROWS + 50)
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.col("id").cast("string")).alias("s_name"), (F.col("id") % 2).cast("int").alias("s_nationkey")).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}/*.parquet'")
    wanted = sorted(map(str, db.execute(Q.ORACLES["upload_states"]).fetchall()))
    got = sorted(str(tuple(r)) for r in Q.upload_states(spark, str(tmp_path)).collect())
    assert len(wanted) == n and got == wanted
