"""The older importers' outputs: JSON catalogues from XML files and zips, category trees from spreadsheets.

Kept apart from the current importers, whose rules differ: only the first
range of a value counts, a value without a range is a quality, and forbidden
units drop rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.shipping import ship
from nomenclia.sources.catalog_xml import SCHEMA, tidy, truth
from nomenclia.sources.supplier_xlsx import plain_column, sheet_rows, under_headers


def name_filter(names: DataFrame, targets: DataFrame, mode: str = "exact") -> DataFrame:
    """Rows of ``names`` (name) that equal, or contain, one of ``targets`` (target), normalised."""
    keyed = names.withColumn("__n", plain_column(F.col("name")))
    wanted = targets.select(plain_column(F.col("target")).alias("__t")).where("__t <> ''").distinct()
    if mode == "exact":
        return keyed.join(wanted, F.col("__n") == F.col("__t"), "left_semi").drop("__n")
    if mode == "contains":
        # A name that contains a target has the target's first three characters (or all of a shorter one).
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("__n") - n + 1), lambda k: F.substring(F.col("__n"), k, F.lit(n)))
        held = F.array_distinct(F.concat(*[F.when(F.length("__n") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
        near = keyed.select("__n").distinct().select("__n", F.explode(held).alias("__g")).join(wanted.withColumn("__g", F.substring("__t", 1, 3)), "__g")
        return keyed.join(near.where(F.contains("__n", "__t")).select("__n").distinct(), "__n", "left_semi").drop("__n")
    raise ValueError(f"unknown mode {mode}")


def target_names(spark: SparkSession, path: str) -> DataFrame:
    """One target a line; comments start with #."""
    return spark.read.text(path).select(F.trim("value").alias("target")).where("target <> '' and not startswith(target, '#')")


def zipped_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml): the XML members of the zips under ``path``, one row each."""
    ship(spark)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".xml"):
                            yield pa.RecordBatch.from_arrays([pa.array([f"{file}!{name}"]), pa.array([z.read(name).decode("utf-8-sig")])], ["file", "xml"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(members, "file string, xml string")


def positions_of(members: DataFrame) -> DataFrame:
    """Raw positions of whole XML texts: cut at position elements, each parsed with the catalogue's schema."""
    bare = F.regexp_replace("xml", r"<(/?)\w+:", "<$1")
    cut = members.select("file", F.explode(F.regexp_extract_all(bare, F.lit(r"(?s)<position[ >].*?</position>"), F.lit(0))).alias("x"))
    return cut.select("file", F.from_xml("x", SCHEMA).alias("p")).select("file", "p.data.*")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw positions of all XML files under ``path``, any name, directories included, each file once."""
    raw = spark.read.format("xml").option("rowTag", "position").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").schema(SCHEMA).load(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), "data.*")


def _units(units: Column) -> Column:
    named = F.transform(F.coalesce(units, F.array().cast("array<struct<code:string,name:string>>")), lambda u: F.struct(u["code"].alias("id"), u["name"].alias("name")))
    return F.array_distinct(named)


def json_catalog(raw: DataFrame) -> DataFrame:
    """(ktru_code, name, okpd2, okeis, characteristics) of active positions, nested as the older JSON has them."""
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")

    def value(v: Column, k: Column, code: Column) -> Column:
        first = F.get(v["rangeSet"]["valueRange"], F.lit(0))
        bounds = F.struct(first["minMathNotation"].alias("min_notation"), number(first["min"]).alias("min_value"), first["maxMathNotation"].alias("max_notation"), number(first["max"]).alias("max_value"))
        return F.struct(F.concat_ws("-v", code, k.cast("string")).alias("id"), first.isNotNull().alias("is_range"), F.when(first.isNotNull(), bounds).alias("range"), first.isNull().alias("is_quality"), F.when(first.isNull(), tidy(v["qualityDescription"])).alias("quality_description"), _units(v["OKEI"]).alias("okeis"))

    def characteristic(c: Column) -> Column:
        return F.struct(c["code"].alias("id"), c["name"].alias("name"), truth(c["isRequired"]).alias("required"), F.transform(c["values"]["value"], lambda v, k: value(v, k, c["code"])).alias("values"))

    active = raw.where("status = 'ACTIVE' and trim(code) <> '' and trim(name) <> ''")
    return active.select(
        tidy(F.col("code")).alias("ktru_code"), tidy(F.col("name")).alias("name"), F.struct(F.col("OKPD2.code").alias("id"), F.col("OKPD2.name").alias("name")).alias("okpd2"), _units(F.col("OKEIs.OKEI")).alias("okeis"),
        F.transform(F.filter("characteristics.characteristic", lambda c: truth(c["actual"])), characteristic).alias("characteristics"),
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_sheets(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of all sheets under ``path``: the first row that has the first of ``columns`` (name to header) is the header; a column whose name contains the header will do."""
    found = under_headers(sheet_rows(spark, path), {c: " ".join(h.lower().replace("ё", "е").replace(".", "").split()) for c, h in columns.items()}, 1, again=False, within=True)
    return found.select("file", *columns)
