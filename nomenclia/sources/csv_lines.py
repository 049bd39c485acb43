"""Uploads of descriptions: one column of CSV in UTF-8 or Windows-1251, or an older JSON catalogue."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.shipping import ship

# ---------------------------------------------------------------- fixed values
HEADERS = frozenset(("описание", "описание товара", "наименование", "наименование товара", "товар", "description", "name", "product", "текст", "запрос"))
MOST_ROWS, MOST_CHARS, LEAST_CHARS, MOST_BYTES = 2000, 2000, 3, 5 << 20
# ----------------------------------------------------------------


def decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1251")


def delimiter_of(sample: str) -> str:
    """The one of semicolon, tab and bar that all lines of a sample have equally often, else a comma."""
    lines = [x for x in sample.splitlines() if x.strip()]
    for d in ";\t|":
        counts = {line.count(d) for line in lines}
        if lines and len(counts) == 1 and counts != {0}:
            return d
    return ","


def descriptions_of(raw: bytes) -> list[str]:
    """The descriptions of a file; raises ValueError if there are none or too many."""
    text = decoded(raw)
    d = delimiter_of(text[:4096])
    out = []
    for record in csv.reader(io.StringIO(text), delimiter=d):
        cells = [c.strip() for c in record if c.strip()]
        if cells:
            joined = re.sub(r"(\d), (\d)", r"\1,\2", ", ".join(cells)) if d == "," and len(cells) > 1 else "; ".join(cells)
            out.append(" ".join(joined.split())[:MOST_CHARS])
    if out and out[0].strip('"').strip().lower() in HEADERS:
        out = out[1:]
    out = [x for x in out if len(x) >= LEAST_CHARS]
    if not out:
        raise ValueError("no descriptions")
    if len(out) > MOST_ROWS:
        raise ValueError(f"too many rows: {len(out)}, at most {MOST_ROWS}")
    return out


def read_uploads(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as rows (path, row_number, description, error); a bad file gives one row with its error."""
    ship(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    if not content or len(content) > MOST_BYTES:
                        raise ValueError("empty file" if not content else "file too large")
                    out += [(path, n, x, None) for n, x in enumerate(descriptions_of(content), 1)]
                except (ValueError, csv.Error) as e:
                    out.append((path, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], ["path", "row_number", "description", "error"])

    return files.select("path", "content").mapInArrow(rows, "path string, row_number int, description string, error string")


def valid_input(text: Column) -> Column:
    """3 to 2000 characters, not blank, not digits alone."""
    t = F.trim(text)
    return F.length(t).between(LEAST_CHARS, MOST_CHARS) & ~t.rlike(r"^\d+$")


JSON_SCHEMA = (
    "positions array<struct<ktru_code:string,name:string,okpd2:struct<id:string,name:string>,okeis:array<struct<id:string,name:string>>,characteristics:array<struct<id:string,name:string,required:boolean,"
    "values:array<struct<id:string,is_range:boolean,range:struct<min_notation:string,min_value:double,max_notation:string,max_value:double>,is_quality:boolean,quality_description:string,okeis:array<struct<id:string,name:string>>>>>>>>"
)


def read_json_catalog(spark: SparkSession, path: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(positions, options) of an older JSON catalogue; codes already in ``existing`` are skipped, a missing notation excludes the bound."""
    p = spark.read.schema(JSON_SCHEMA).option("multiLine", "true").json(path).select(F.explode("positions").alias("p")).select("p.*").dropDuplicates(["ktru_code"])
    if existing is not None:
        p = p.join(existing.select(F.col("code").alias("ktru_code")), "ktru_code", "left_anti")
    positions = p.select(F.col("ktru_code").alias("code"), "name", F.col("okpd2.id").alias("okpd2_code"), F.col("okpd2.name").alias("okpd2_name"), F.lit(False).alias("is_template"))
    v = p.select("ktru_code", F.explode("characteristics").alias("c")).select("ktru_code", "c.name", "c.required", F.explode_outer("c.values").alias("v"))
    unit = F.array_join(F.transform("v.okeis", lambda u: u["name"]), "; ")
    options = v.select(
        F.col("ktru_code").alias("code"), F.col("name").alias("char"), "required", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("int").alias("char_type"), F.lit(1).alias("choice_type"),
        F.when(F.col("v.is_quality"), "quality").when(F.col("v.is_range"), "range").alias("option_kind"),
        F.when(F.col("v.is_quality"), F.col("v.quality_description")).otherwise(F.concat_ws("..", F.col("v.range.min_value").cast("string"), F.col("v.range.max_value").cast("string"))).alias("label"),
        F.when(unit != "", unit).alias("unit"), F.lit(None).cast("double").alias("number"), F.col("v.range.min_value").alias("lower"), F.col("v.range.max_value").alias("upper"),
        (F.col("v.range.min_notation") == "greaterOrEqual").alias("lower_inc"), (F.col("v.range.max_notation") == "lessOrEqual").alias("upper_inc"),
    )
    return positions, options.fillna(False, ["lower_inc", "upper_inc"])
