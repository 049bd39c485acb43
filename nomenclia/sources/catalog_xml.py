"""Catalogue exports in XML, as tables.

Files are split by ``position`` elements and read with a fixed schema. Only
actual exports, active positions and actual characteristics count; of a code
that occurs twice the first by file and place stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
ACTUAL, NOT_ACTUAL = r"(?i)^nsiKTRUNew_all.*actual.*\.xml$", r"(?i)not[-_]?actual"
OKEI = "OKEI array<struct<code:string,name:string>>"
RANGE = f"struct<min:string,max:string,minMathNotation:string,maxMathNotation:string,{OKEI.replace(' ', ':', 1)}>"
VALUE = f"struct<valueCode:string,valueFormat:string,{OKEI.replace(' ', ':', 1)},qualityDescription:string,rangeSet:struct<valueRange:array<{RANGE}>,{OKEI.replace(' ', ':', 1)}>,valueSet:struct<concreteValue:array<string>,{OKEI.replace(' ', ':', 1)}>>"
CHARACTERISTIC = f"struct<code:string,name:string,actual:string,isRequired:string,type:string,kind:string,choiceType:string,values:struct<value:array<{VALUE}>>>"
SCHEMA = (
    "data struct<code:string,name:string,status:string,version:string,isTemplate:string,OKPD2:struct<code:string,name:string>,parentPositionInfo:struct<code:string>,"
    "applicationDateStart:string,applicationDateEnd:string,rubricators:struct<rubricatorInfo:array<struct<name:string>>>,OKEIs:struct<OKEI:array<struct<code:string,name:string>>>,"
    f"characteristics:struct<characteristic:array<{CHARACTERISTIC}>>>"
)
# ----------------------------------------------------------------


def tidy(text: Column) -> Column:
    """Single spaces, and null for nothing."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(out != "", out)


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def decimal(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("decimal(38,10)")


def moment(text: Column) -> Column:
    """Local date and time of an ISO text; a zone is dropped."""
    return F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")


def is_actual(name: Column) -> Column:
    return name.rlike(ACTUAL) & ~name.rlike(NOT_ACTUAL)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Raw positions of the actual exports under ``path``, one row a code."""
    raw = spark.read.format("xml").option("rowTag", "position").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(SCHEMA).load(path)
    raw = raw.select("data.*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("place"), F.monotonically_increasing_id().alias("ord"))
    sound = raw.where(is_actual(F.col("file")) & (F.col("status") == "ACTIVE")).withColumn("code", tidy(F.col("code"))).withColumn("name", tidy(F.col("name"))).where("code is not null and name is not null")
    first = F.row_number().over(Window.partitionBy("code").orderBy("file", "place", "ord"))
    return sound.withColumn("__n", first).where("__n = 1").drop("__n", "place", "ord")


def positions(raw: DataFrame) -> DataFrame:
    return raw.select(
        "code", "name", F.col("OKPD2.code").alias("okpd2_code"), tidy(F.col("OKPD2.name")).alias("okpd2_name"), "status", F.col("version").try_cast("int").alias("version"), truth(F.col("isTemplate")).alias("is_template"),
        F.col("parentPositionInfo.code").alias("parent_code"), moment(F.col("applicationDateStart")).alias("start"), moment(F.col("applicationDateEnd")).alias("end"),
        F.array_join(F.transform("rubricators.rubricatorInfo", lambda r: tidy(r["name"])), "; ").alias("rubricators"),
    )


def characteristics(raw: DataFrame) -> DataFrame:
    """Actual characteristics with ``char_id``, a digest of code and place, and their raw values."""
    each = raw.select("code", F.posexplode("characteristics.characteristic").alias("place", "c")).where(truth(F.col("c.actual")))
    return each.select(
        F.xxhash64("code", "place").alias("char_id"), "code", tidy(F.col("c.name")).alias("name"), truth(F.col("c.isRequired")).alias("required"), F.col("c.code").alias("char_code"),
        F.col("c.type").try_cast("int").alias("char_type"), F.col("c.kind").try_cast("int").alias("kind"), F.col("c.choiceType").try_cast("int").alias("choice_type"), F.col("c.values.value").alias("raw_values"),
    ).where("name is not null")


def _plain(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def values(chars: DataFrame) -> DataFrame:
    """One row for each quality, range and concrete number, with label, bounds and units."""
    v = chars.select("char_id", "code", F.posexplode("raw_values").alias("place", "v"))
    units = F.concat(*[F.coalesce(c, F.array().cast("array<struct<code:string,name:string>>")) for c in (F.col("v.OKEI"), F.col("v.rangeSet.OKEI"), F.col("v.valueSet.OKEI"), F.flatten(F.col("v.rangeSet.valueRange.OKEI")))])
    v = v.withColumn("units", F.array_distinct(F.filter(F.transform(units, lambda u: F.coalesce(tidy(u["name"]), tidy(u["code"]))), lambda u: u.isNotNull())))
    v = v.withColumn("unit", F.when(F.size("units") > 0, F.array_join("units", "; "))).withColumn("suffix", F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")))
    v = v.withColumn("value_code", F.col("v.valueCode")).withColumn("value_format", F.col("v.valueFormat"))
    keep = ["char_id", "code", "place", "unit", "value_code", "value_format"]
    none = F.lit(None).cast("decimal(38,10)")
    quality = v.where(tidy(F.col("v.qualityDescription")).isNotNull()).select(*keep, F.lit("quality").alias("option_kind"), tidy(F.col("v.qualityDescription")).alias("label"), none.alias("number"), none.alias("lower"), none.alias("upper"), F.lit(True).alias("lower_inc"), F.lit(True).alias("upper_inc"), F.lit(False).alias("reversed"))
    r = v.select(*keep, "suffix", F.explode("v.rangeSet.valueRange").alias("r")).withColumn("low", decimal(F.col("r.min"))).withColumn("high", decimal(F.col("r.max")))
    low_sign, high_sign = F.when(F.col("r.minMathNotation") == "greater", ">").otherwise("≥"), F.when(F.col("r.maxMathNotation") == "less", "<").otherwise("≤")
    parts = F.array_compact(F.array(F.concat(low_sign, F.lit(" "), _plain(F.col("low"))), F.concat(high_sign, F.lit(" "), _plain(F.col("high")))))
    bad = F.coalesce(F.col("low") > F.col("high"), F.lit(False))
    ranges = r.select(*keep, F.lit("range").alias("option_kind"), F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " и "), "suffix")).otherwise(F.coalesce("unit", F.lit("диапазон"))).alias("label"), none.alias("number"), F.when(~bad, F.col("low")).alias("lower"), F.when(~bad, F.col("high")).alias("upper"), F.coalesce(F.col("r.minMathNotation") != "greater", F.lit(True)).alias("lower_inc"), F.coalesce(F.col("r.maxMathNotation") != "less", F.lit(True)).alias("upper_inc"), bad.alias("reversed"))
    c = v.select(*keep, "suffix", F.explode("v.valueSet.concreteValue").alias("n")).withColumn("n", decimal(F.trim("n"))).where("n is not null")
    concrete = c.select(*keep, F.lit("concrete").alias("option_kind"), F.concat(_plain(F.col("n")), "suffix").alias("label"), F.col("n").alias("number"), none.alias("lower"), none.alias("upper"), F.lit(True).alias("lower_inc"), F.lit(True).alias("upper_inc"), F.lit(False).alias("reversed"))
    return quality.unionByName(ranges).unionByName(concrete)


def okei(raw: DataFrame) -> DataFrame:
    """The unit dictionary: key (the code, or the name marked as such), code, name, and a dense id."""
    units = raw.select(F.explode("OKEIs.OKEI").alias("u")).unionByName(raw.select(F.explode("characteristics.characteristic").alias("c")).select(F.explode("c.values.value").alias("v")).select(F.explode("v.OKEI").alias("u")))
    keyed = units.select(F.coalesce(tidy(F.col("u.code")), F.concat(F.lit("name:"), tidy(F.col("u.name")))).alias("key"), tidy(F.col("u.code")).alias("code"), tidy(F.col("u.name")).alias("name")).where("key is not null")
    once = keyed.groupBy("key").agg(F.first("code", True).alias("code"), F.min("name").alias("name"))
    return once.withColumn("id", F.dense_rank().over(Window.orderBy("key")))


def options(chars: DataFrame, vals: DataFrame) -> DataFrame:
    """Characteristics joined with their values, as the analysis reads them; one row without a value if there is none."""
    numbers = vals.select("char_id", "option_kind", "label", "unit", *[F.col(c).cast("double").alias(c) for c in ("number", "lower", "upper")], "lower_inc", "upper_inc")
    return chars.join(numbers, "char_id", "left").select("code", F.col("name").alias("char"), "required", "kind", "char_type", "choice_type", "option_kind", "label", "unit", "number", "lower", "upper", "lower_inc", "upper_inc")


def statistics(raw: DataFrame, chars: DataFrame, vals: DataFrame) -> DataFrame:
    """One row of import counts."""
    kinds = vals.agg(F.count_if(F.col("option_kind") == "quality").alias("values_quality"), F.count_if(F.col("option_kind") == "range").alias("values_range"), F.count_if(F.col("option_kind") == "concrete").alias("values_concrete"), F.count_if("reversed").alias("invalid_ranges"))
    return raw.agg(F.count("*").alias("positions")).crossJoin(chars.agg(F.count("*").alias("characteristics"))).crossJoin(kinds)


def ingest(spark: SparkSession, path: str, target: str) -> dict[str, DataFrame]:
    """Read the exports under ``path`` and replace the tables under ``target``.

    All tables are written beside the old ones first; the pointer file that
    names the current version is replaced last, so readers see whole versions.
    """
    import uuid

    raw = read_positions(spark, path)
    chars = characteristics(raw)
    vals = values(chars)
    tables = {"positions": positions(raw), "characteristics": chars.drop("raw_values"), "values": vals, "okei": okei(raw), "options": options(chars, vals)}
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{target}/{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{target}/current")
    return {name: spark.read.parquet(f"{target}/{version}/{name}") for name in tables}


def current(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    version = spark.read.schema("version string").json(f"{target}/current").first()["version"]
    return {name: spark.read.parquet(f"{target}/{version}/{name}") for name in ("positions", "characteristics", "values", "okei", "options")}
