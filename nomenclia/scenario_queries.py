"""Whole analyses over the driver's tables, with SQL that knows the outcome from how the texts are made.

The catalogue is an XML export of ``nation``: four positions a nation, by
material and length. The descriptions are the rows of ``supplier``: the name of
the supplier's nation with a material and, mostly, a length in millimetres or
centimetres; some have no length, some are words of no catalogue.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.operators.match import for_each
from nomenclia.plans import analysis, response
from nomenclia.sources import catalog_xml
from nomenclia.staging import folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = (
    "насос садовый,клапан бытовой,кабель уличный,провод настенный,лампа переносная,фонарь складной,датчик цифровой,счетчик оптический,экран резиновый,монитор стальной,принтер садовый,"
    "сканер бытовой,ковер уличный,матрац настенный,одеяло переносное,подушка складная,ведро цифровое,лопата оптическая,грабли резиновые,топор стальной,скамья садовая,полка бытовая,шкаф уличный,молоток настенный,стремянка переносная"
).split(",")
STRANGE = "абракадабра пупыр"
MATERIALS, SAID = ("Деревянный", "Металлический"), ("деревянный", "металлический")
LENGTHS = ((100, 200), (200, 400))

_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
SQL = f"""WITH n AS (SELECT n_nationkey AS k, {_LIST}[n_nationkey + 1] AS name FROM nation),
p AS (SELECT k, v, 'P' || k || '-' || v AS code, name, CASE v % 2 WHEN 0 THEN '{MATERIALS[0]}' ELSE '{MATERIALS[1]}' END AS material, CASE WHEN v < 2 THEN '≥ 100 и < 200 Миллиметр' ELSE '≥ 200 и < 400 Миллиметр' END AS length FROM n, range(4) t(v)),
d AS (SELECT s_suppkey AS id, name, k, s_suppkey % 2 AS m, 100 + (s_suppkey * 7 % 30) * 10 AS mm, CASE WHEN s_suppkey % 7 = 0 THEN 'none' WHEN s_suppkey % 5 = 0 THEN 'open' ELSE 'full' END AS kind FROM supplier JOIN n ON k = s_nationkey),
total AS (SELECT count(*) AS total FROM p)
"""


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = SQL + sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _name(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col(key) + 1).cast("int"))


def exported(spark: SparkSession, d: str) -> str:
    """A folder with an XML export of the catalogue, one file."""
    v = F.col("v")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[x if isinstance(x, Column) else F.lit(x) for x in inner], F.lit(f"</{name}>"))
    about = "<actual>true</actual><isRequired>true</isRequired><type>{0}</type><kind>{0}</kind><choiceType>1</choiceType>"
    material = tag("characteristic", "<code>c1</code><name>Материал корпуса</name>" + about.format(1), tag("values", tag("value", tag("qualityDescription", F.when(v % 2 == 0, MATERIALS[0]).otherwise(MATERIALS[1])))))
    bound = lambda k: F.when(v < 2, str(LENGTHS[0][k])).otherwise(str(LENGTHS[1][k]))
    length = tag("characteristic", "<code>c2</code><name>Длина</name>" + about.format(2), tag("values", tag("value", "<OKEI><code>003</code><name>Миллиметр</name></OKEI>", tag("rangeSet", tag("valueRange", tag("min", bound(0)), tag("max", bound(1)), "<minMathNotation>greaterOrEqual</minMathNotation><maxMathNotation>less</maxMathNotation>")))))
    data = tag("data", tag("code", F.concat_ws("-", F.concat(F.lit("P"), F.col("n_nationkey").cast("string")), v.cast("string"))), tag("name", _name("n_nationkey")), "<status>ACTIVE</status><version>1</version><isTemplate>false</isTemplate><OKPD2><code>31.01</code><name>Прочее</name></OKPD2>", tag("characteristics", material, length))
    rows = _table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v")).select(tag("position", data).alias("x"))
    whole = rows.agg(F.concat(F.lit("<export>"), F.array_join(F.collect_list("x"), "\n"), F.lit("</export>")).alias("value"))  # four rows a nation
    path = f"{folder(spark)}/export-{uuid.uuid4().hex}"
    whole.write.text(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(place(path)) if f.getPath().getName().startswith("part-"))
    files.rename(part, place(path, "nsiKTRUNew_all_1_actual.xml"))
    return path


def ingested(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return catalog_xml.ingest(spark, exported(spark, d), f"{folder(spark)}/tables-{uuid.uuid4().hex}")


def catalog(spark: SparkSession, d: str) -> analysis.Catalog:
    tables = ingested(spark, d)
    supplier = spark.createDataFrame([], "category string, name string, kind string, unit string")
    return analysis.Catalog(tables["positions"], tables["options"], supplier)


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("s_suppkey")
    mm = 100 + (i * 7 % 30) * 10
    length = F.when(i % 3 == 0, F.concat((mm / 10).cast("int").cast("string"), F.lit(" см"))).otherwise(F.concat(mm.cast("int").cast("string"), F.lit(" мм")))
    named = F.concat(_name("s_nationkey"), F.lit(", материал корпуса "), F.when(i % 2 == 0, SAID[0]).otherwise(SAID[1]))
    text = F.when(i % 7 == 0, STRANGE).when(i % 5 == 0, named).otherwise(F.concat(named, F.lit(", длина "), length))
    return _table(spark, d, "supplier").select(i.cast("long").alias("id"), text.alias("text"))


def analyzed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, analysis.Catalog]:
    """Analyses, one of all equal descriptions; (id, like) of every description; the catalogue."""
    known = catalog(spark, d)
    first, of = analysis.shared(descriptions(spark, d))
    return analysis.analyze_each(first, known), of, known


@query("SELECT code, name, material AS label, 'quality' AS kind, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM p UNION ALL SELECT code, name, length, 'range', CASE WHEN v < 2 THEN 100 ELSE 200 END, CASE WHEN v < 2 THEN 200 ELSE 400 END FROM p")
def ingest_values(spark, d):
    t = ingested(spark, d)
    return t["values"].join(t["positions"].select("code", "name"), "code").select("code", "name", "label", F.col("option_kind").alias("kind"), F.col("lower").cast("double").alias("lower"), F.col("upper").cast("double").alias("upper"))


@query("SELECT id, CASE kind WHEN 'none' THEN 'name_not_found' WHEN 'open' THEN 'need_more_info' ELSE 'resolved' END AS status, CASE kind WHEN 'full' THEN 'P' || k || '-' || (m + CASE WHEN mm < 200 THEN 0 ELSE 2 END) END AS code, CASE kind WHEN 'open' THEN 2 WHEN 'full' THEN 1 END AS remaining FROM d")
def analyze_codes(spark, d):
    got, of, _ = analyzed(spark, d)
    return for_each(got.select("id", "status", "code", F.when(F.col("remaining").isNotNull(), F.size("remaining")).alias("remaining")), of)


@query(
    """SELECT id, 'Материал корпуса' AS title, 'ok' AS status, CASE m WHEN 0 THEN 'Деревянный' ELSE 'Металлический' END AS normalized, CASE m WHEN 0 THEN 'Деревянный' ELSE 'Металлический' END AS matched FROM d WHERE kind <> 'none'
    UNION ALL SELECT id, 'Длина', 'ok', CAST(mm AS VARCHAR), CASE WHEN mm < 200 THEN '≥ 100 и < 200 Миллиметр' ELSE '≥ 200 и < 400 Миллиметр' END FROM d WHERE kind = 'full'"""
)
def analyze_facts(spark, d):
    got, of, _ = analyzed(spark, d)
    return for_each(got.where("facts is not null").select("id", F.inline("facts")).select("id", "title", "status", "normalized", "matched"), of)


@query(
    """SELECT id, 0 AS place, 'catalog' AS kind, NULL::BIGINT AS before, total AS after FROM d, total UNION ALL SELECT id, 1, 'name', total, CASE kind WHEN 'none' THEN 0 ELSE 4 END FROM d, total
    UNION ALL SELECT id, 2, 'characteristic', 4, 2 FROM d WHERE kind <> 'none' UNION ALL SELECT id, 3, 'characteristic', 2, 1 FROM d WHERE kind = 'full'"""
)
def analyze_stages(spark, d):
    got, of, _ = analyzed(spark, d)
    return for_each(got.select("id", F.posexplode("stages").alias("place", "s")).select("id", "place", "s.kind", "s.before", "s.after"), of)


@query("SELECT id, 1 AS place, 'Длина' AS name, '≥ 100 и < 200 Миллиметр; ≥ 200 и < 400 Миллиметр' AS options FROM d WHERE kind = 'open'")
def analyze_questions(spark, d):
    got, of, _ = analyzed(spark, d)
    return for_each(got.where("suggestions is not null").select("id", F.inline("suggestions")).select("id", "place", "name", F.array_join("options.label", "; ").alias("options")), of)


@query(
    """SELECT id, 'Материал корпуса' AS name, CASE m WHEN 0 THEN 'Деревянный' ELSE 'Металлический' END AS value, 'ok' AS status FROM d WHERE kind <> 'none'
    UNION ALL SELECT id, 'Длина', CASE WHEN kind = 'open' THEN NULL WHEN mm < 200 THEN '≥ 100 и < 200 Миллиметр' ELSE '≥ 200 и < 400 Миллиметр' END, CASE kind WHEN 'open' THEN 'missing' ELSE 'ok' END FROM d WHERE kind <> 'none'"""
)
def analyze_specification(spark, d):
    got, of, known = analyzed(spark, d)
    return for_each(response.specification(staged(got.where("facts is not null"), "analyses"), known.options).select("id", "name", "value", "status"), of)


@query(
    """SELECT id, 'candidate' AS what, 1 AS place, 'P' || k || '-' || (m + CASE WHEN kind = 'full' AND mm >= 200 THEN 2 ELSE 0 END) AS value FROM d WHERE kind <> 'none' UNION ALL SELECT id, 'candidate', 2, 'P' || k || '-' || (m + 2) FROM d WHERE kind = 'open'
    UNION ALL SELECT id, 'ok facts', 0, CASE kind WHEN 'full' THEN '2 of 2' ELSE '1 of 1' END FROM d WHERE kind <> 'none'
    UNION ALL SELECT id, 'message', 0, CASE kind WHEN 'none' THEN 'name_not_found' WHEN 'open' THEN 'need_more_info' ELSE 'resolved' END FROM d"""
)
def analyze_outputs(spark, d):
    """Candidates, counts of facts and messages of the analyses."""
    got, of, known = analyzed(spark, d)
    got = staged(got, "analyses", wide=True)
    found = got.where("facts is not null")
    candidates = response.candidates(found, known.positions).select("id", F.lit("candidate").alias("what"), "place", F.col("code").alias("value"))
    quality = response.quality(found).select("id", F.lit("ok facts").alias("what"), F.lit(0).alias("place"), F.concat_ws(" of ", F.col("ok").cast("string"), F.col("facts").cast("string")).alias("value"))
    messages = response.messages(got).select("id", F.lit("message").alias("what"), F.lit(0).alias("place"), F.col("kind").alias("value"))
    return for_each(candidates.unionByName(quality).unionByName(messages), of)


@query("SELECT id, name AS corrected FROM d")
def typo_corrections(spark, d):
    """Names whose first word lacks its fourth letter where it has six or more."""
    known = catalog(spark, d)
    name = _name("s_nationkey")
    short = F.when(F.length(F.substring_index(name, " ", 1)) >= 6, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 100))).otherwise(name)
    return analysis.check_typos(_table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), short.alias("text")), analysis.build_index(known)).select("id", "corrected")
