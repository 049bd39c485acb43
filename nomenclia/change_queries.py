"""Queries of what changes over time: results kept by text, latest requests, row-level changes, edits; and of spans and bitmaps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.operators import bitmaps, edits, replace, spans
from nomenclia.sources import constraints
from nomenclia.sources.csv_lines import MOST_ROWS
from nomenclia.sources.versions import Versioned
from nomenclia.staging import folder, staged
from nomenclia.streaming import batches, cache, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOUR = 3_600_000


@query(f"""
WITH RECURSIVE e AS (SELECT event_id AS id, epoch_ms(ts) AS ms, ts, event_type || ' of ' || user_id AS text, user_id FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY ts, id) AS place,
    1 + count(*) OVER (PARTITION BY text ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND {HOUR - 1} FOLLOWING) AS past
  FROM e
), l AS (SELECT text, place, past, id FROM n WHERE place = 1 UNION ALL SELECT n.text, n.place, n.past, n.id FROM l JOIN n ON n.text = l.text AND n.place = l.past)
SELECT n.id, max_by(l.id, l.place) AS leader, any_value(c_name) AS result
FROM n JOIN l ON l.text = n.text AND l.place <= n.place LEFT JOIN customer ON c_custkey = user_id GROUP BY n.id
""")
def cached_answers(spark, d):
    """Each event asks for its user's name; texts are answered once an hour."""
    requests = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.concat_ws(" of ", "event_type", "user_id").alias("text"))
    names = table(spark, d, "customer")

    def compute(docs: DataFrame) -> DataFrame:
        user = F.regexp_extract("text", r"\d+$", 0).cast("long")
        return docs.join(names, user == F.col("c_custkey"), "left").select("id", F.col("c_name").alias("result"))

    target = f"{folder(spark)}/answers-{uuid.uuid4().hex}"
    cache.run_cached(requests, target, compute, HOUR, capacity=100_000).awaitTermination()
    return cache.answers(spark, target).select("id", "leader", "result")


@query("""
WITH e AS (SELECT user_id AS client, epoch_us(ts) // 600000000 AS number, ts, CASE WHEN event_type IN ('click', 'view') THEN 'request' ELSE 'result' END AS kind, value FROM events),
f AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM e WINDOW w AS (PARTITION BY client ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY client ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f),
g AS (
  SELECT client, session, min(ts) AS a, max(ts) AS b, max(number) AS number, count(*) FILTER (WHERE kind = 'result') AS results,
    max({'number': number, 'ts': ts, 'value': value}) FILTER (WHERE kind = 'result') AS last
  FROM s GROUP BY client, session
)
SELECT client, epoch_us(a) AS start_us, epoch_us(b + INTERVAL 30 MINUTE) AS end_us, number, CASE WHEN last.number = number THEN last.value END AS result,
  CAST(results - CASE WHEN last.number = number THEN 1 ELSE 0 END AS BIGINT) AS obsolete
FROM g
""")
def latest_results(spark, d):
    """Clicks and views are requests of ten minutes, the other events results."""
    e = table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type").isin("click", "view"), "request").otherwise("result")
    found = latest.latest(e.select(F.col("user_id").alias("client"), F.expr("unix_micros(cast(ts as timestamp)) div 600000000").alias("number"), at.alias("at"), kind.alias("kind"), "value"))
    return found.select("client", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "number", "result", F.col("obsolete").cast("long").alias("obsolete"))


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders),
b AS (SELECT * FROM a WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)),
c AS (SELECT * FROM b UNION ALL SELECT -1 - c_custkey, 'N', '5-LOW', c_acctbal FROM customer),
d AS (SELECT * FROM c WHERE NOT o_orderpriority = '1-URGENT')
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS first_deleted, (SELECT count(*) FROM c) - (SELECT count(*) FROM d) AS then_deleted, (SELECT count(*) FROM b) AS before
FROM d GROUP BY o_orderstatus, o_orderpriority
""")
def row_changes(spark, d):
    """Orders as a versioned table: written, deleted from, added to, deleted from again; an old version is read beside the last."""
    t = Versioned(spark, f"{folder(spark)}/orders-{uuid.uuid4().hex}", "o_orderkey")
    t.replace(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"))
    first = t.delete("o_orderstatus = 'F' and o_totalprice > 200000")
    old = t.version()
    t.insert(table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit("5-LOW").alias("o_orderpriority"), F.col("c_acctbal").alias("o_totalprice")))
    then = t.delete("o_orderpriority = '1-URGENT'")
    before = t.read(old).count()
    counted = t.read().groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return counted.select("*", F.lit(first).cast("long").alias("first_deleted"), F.lit(then).cast("long").alias("then_deleted"), F.lit(before).cast("long").alias("before"))


@query("""
WITH s AS (
  SELECT l_orderkey AS id, l_linenumber AS span, l_partkey % 60 AS a, l_partkey % 60 + CAST(l_quantity AS BIGINT) AS b,
    CASE l_returnflag WHEN 'A' THEN 'typo' WHEN 'N' THEN 'name' ELSE 'characteristic' END AS kind, CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 1 ELSE 2 END AS rank
  FROM lineitem
), c AS (SELECT id, span, kind, rank, unnest(range(a, b)) AS pos FROM s),
q AS (SELECT id, pos, min({'rank': -rank, 'span': span, 'kind': kind}) AS m FROM c GROUP BY id, pos), p AS (SELECT id, pos, m.span AS span, m.kind AS kind FROM q),
f AS (SELECT *, pos - row_number() OVER (PARTITION BY id, span, kind ORDER BY pos) AS run FROM p)
SELECT id, min(pos) AS start, max(pos) + 1 AS "end", span, kind FROM f GROUP BY id, span, kind, run
""")
def painted_spans(spark, d):
    """The lines of an order as spans, shown by the priority of their flag."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "typo").when(flag == "N", "name").otherwise("characteristic")
    start = F.col("l_partkey") % 60
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("span"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), kind.alias("kind"))
    return spans.pieces(rows, spans.by_kind(F.col("kind")))


@query("""
WITH l AS (
  SELECT user_id AS session, event_id AS number, value::VARCHAR AS value,
    CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'remove' WHEN 'purchase' THEN 'select' WHEN 'error' THEN 'undo' ELSE 'set' END AS action,
    CASE WHEN value >= 10 THEN 'Key ' ELSE ' kEY ' END || (CAST(floor(value) AS BIGINT) % 7) AS name,
    CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS undoes
  FROM events
), k AS (SELECT l.* FROM l WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM l u WHERE u.action = 'undo' AND u.session = l.session AND u.undoes = l.number)),
n AS (SELECT session, lower(trim(name)) AS key, max(number) AS number FROM k WHERE action IN ('set', 'remove') GROUP BY session, key),
j AS (SELECT k.* FROM k JOIN n ON k.session = n.session AND k.number = n.number),
o AS (
  SELECT session, string_agg(CASE WHEN action = 'set' THEN trim(name) || '=' || value END, ';' ORDER BY number) AS overrides,
    string_agg(CASE WHEN action = 'remove' THEN trim(name) END, ';' ORDER BY number) AS excluded, max(number) AS changed
  FROM j GROUP BY session
), p AS (SELECT session, max(number) AS number, arg_max(value, number) AS code FROM k WHERE action = 'select' GROUP BY session)
SELECT s.session, coalesce(overrides, '') AS overrides, coalesce(excluded, '') AS excluded, CASE WHEN changed IS NULL OR p.number > changed THEN code END AS selected_code
FROM (SELECT DISTINCT session FROM l) s LEFT JOIN o ON o.session = s.session LEFT JOIN p ON p.session = s.session
""")
def edit_state(spark, d):
    """Events as a log of edits; an error takes back the user's action before it."""
    from pyspark.sql import Window

    kind = F.col("event_type")
    action = F.when(kind == "click", edits.REMOVE).when(kind == "purchase", edits.SELECT).when(kind == "error", edits.UNDO).otherwise(edits.SET)
    name = F.concat(F.when(F.col("value") >= 10, "Key ").otherwise(" kEY "), (F.floor("value") % 7).cast("string"))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), action.alias("action"), name.alias("name"), F.col("value").cast("string").alias("value"), F.when(kind == "error", before).alias("undoes"))
    listed = F.array_join(F.transform("overrides", lambda o: F.concat_ws("=", o["name"], o["value"])), ";")
    return edits.state(log).select("session", listed.alias("overrides"), F.array_join("excluded", ";").alias("excluded"), "selected_code")


@query("""
WITH h AS (SELECT DISTINCT l_partkey AS code, l_returnflag || l_linenumber AS key FROM lineitem),
k AS (SELECT DISTINCT key FROM h)
SELECT a.key || '+' || b.key AS "set", count(*) AS n FROM k a JOIN k b ON a.key < b.key JOIN h x ON x.key = a.key JOIN h y ON y.key = b.key AND y.code = x.code GROUP BY 1
""")
def bitmap_pools(spark, d):
    """Parts that were ordered with each two of the flags and line numbers."""
    having = staged(table(spark, d, "lineitem").select(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("key"), F.col("l_partkey").alias("code")).distinct(), "having")
    numbers = staged(bitmaps.numbered(having.select("code")), "numbers")
    index = staged(bitmaps.build(having, numbers), "bitmaps")
    # Three flags and seven line numbers: 21 keys at any size.
    keys = index.agg(F.array_sort(F.collect_set("key")).alias("keys"))
    pairs = keys.select(F.explode(F.flatten(F.transform("keys", lambda a: F.transform(F.filter("keys", lambda b: b > a), lambda b: F.array(a, b))))).alias("keys"))
    pairs = pairs.select(F.concat_ws("+", "keys").alias("set"), "keys")
    return bitmaps.counts(bitmaps.all_of(index, pairs))


@query("""
SELECT f.p_partkey AS id, count(*) AS n0, count(*) FILTER (p.p_brand = f.p_brand) AS n1, count(*) FILTER (p.p_brand = f.p_brand AND p.p_type = f.p_type) AS n2
FROM part f JOIN part p USING (p_name) GROUP BY f.p_partkey
""")
def pool_stages(spark, d):
    """Pool sizes of narrowing by name, brand and type, read from bitmaps: each distinct description's once."""
    part = table(spark, d, "part")
    keys = {"n0": ["p_name"], "n1": ["p_name", "p_brand"], "n2": ["p_name", "p_brand", "p_type"]}
    key = lambda c: F.concat(F.lit(f"{c}="), c)
    having = staged(part.select(F.col("p_partkey").alias("code"), F.explode(F.array(*map(key, keys["n2"]))).alias("key")), "having")
    index = staged(bitmaps.build(having, bitmaps.numbered(having.select("code"))), "bitmaps")
    met = part.select(F.col("p_partkey").alias("id"), *keys["n2"])
    for n, columns in keys.items():
        sets = part.select(F.concat_ws("|", *map(key, columns)).alias("set"), F.array(*map(key, columns)).alias("keys")).distinct()
        counted = bitmaps.counts(bitmaps.all_of(index, sets)).withColumnRenamed("n", n)
        met = met.withColumn("set", F.concat_ws("|", *map(key, columns))).join(counted, "set").drop("set")
    return met.select("id", *keys)


@query("""
WITH t AS (SELECT p_partkey AS id, p_name || ', size ' || p_size || ' mm, brand ' || p_brand AS text, upper(split_part(p_name, ' ', 2)) AS matched, p_brand AS name, p_partkey % 10 AS k, strpos(p_name, split_part(p_name, ' ', 2)) AS pos FROM part),
e AS (
  SELECT *, CASE WHEN k = 0 THEN name || ', ' || text WHEN k = 1 THEN name ELSE substr(text, 1, pos - 1) || name || substr(text, pos + len(matched)) END AS renamed,
    CASE WHEN k = 0 THEN len(name) + 2 WHEN k = 1 THEN NULL ELSE len(name) - len(matched) END AS moved
  FROM t
)
SELECT id, renamed, substr(renamed, CAST(strpos(text, 'size') + moved AS BIGINT), 4) AS word, CAST(strpos(text, 'size') - 1 + moved AS INTEGER) AS start FROM e
""")
def renamed_texts(spark, d):
    """The second word of a part's name, as a name that was found, gives way to its brand; the word 'size' is found again after it."""
    text = F.concat("p_name", F.lit(", size "), F.col("p_size").cast("string"), F.lit(" mm, brand "), "p_brand")
    k, word = F.col("p_partkey") % 10, F.upper(F.element_at(F.split("p_name", " "), 2))
    matched = F.when(k == 0, "no such words").when(k == 1, "").otherwise(word)
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), replace.name_edit(text, matched, F.col("p_brand"), k == 1).alias("e"))
    at = F.position(F.lit("size"), F.col("text"))
    moved = replace.carry(docs.select("id", (at - 1).alias("start"), (at + 3).alias("end")), docs.select("id", F.lit(1).alias("number"), "e.at", "e.removed", "e.added"))
    met = docs.select("id", replace.edited(F.col("text"), F.array("e")).alias("renamed")).join(moved, "id", "left")
    return met.select("id", "renamed", F.substring(F.col("renamed"), F.col("start") + 1, F.col("end") - F.col("start")).alias("word"), "start")


@query("""
WITH v AS (
  SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS is_range, l_returnflag = 'A' AS is_quality, CASE WHEN l_returnflag = 'R' OR l_quantity > 49 THEN l_quantity END AS number,
    CASE WHEN l_quantity <> 7 THEN l_quantity END AS lo, CASE WHEN l_quantity <> 7 THEN 60 - l_linenumber * l_quantity / 2 END AS hi, CASE WHEN l_linenumber = 1 THEN ' ' ELSE l_linestatus END AS said
  FROM lineitem
), r AS (
  SELECT *, is_range::INT + is_quality::INT + (number IS NOT NULL)::INT > 1 AS a, is_range AND lo IS NULL AND hi IS NULL AS b, coalesce(NOT (lo <= hi), false) AS c, is_quality AND trim(said) = '' AS d FROM v
)
SELECT rule, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (
  SELECT NULL AS rule, l_orderkey FROM r WHERE NOT (a OR b OR c OR d) UNION ALL SELECT 'one kind', l_orderkey FROM r WHERE a UNION ALL SELECT 'range has bounds', l_orderkey FROM r WHERE b
  UNION ALL SELECT 'bounds in order', l_orderkey FROM r WHERE c UNION ALL SELECT 'quality is said', l_orderkey FROM r WHERE d
) GROUP BY rule
""")
def checked_values(spark, d):
    """Lines of orders as values of a catalogue: those that keep its rules (rule null), and by rule those in quarantine."""
    flag, n, q = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (flag == "N").alias("is_range"), (flag == "A").alias("is_quality"), F.when((flag == "R") | (q > 49), q).alias("concrete_value"),
        F.when(q != 7, q).alias("lower"), F.when(q != 7, 60 - n * q / 2).alias("upper"), F.lit(True).alias("lower_inc"), F.lit(True).alias("upper_inc"), F.when(n == 1, " ").otherwise(F.col("l_linestatus")).alias("quality_description"),
    )
    checked = constraints.check(rows, constraints.VALUE_RULES, folder(spark))
    kept = checked.kept.select(F.lit(None).cast("string").alias("rule"), "l_orderkey")
    return kept.unionByName(checked.refused.select(F.explode(constraints.BROKEN).alias("rule"), "l_orderkey")).groupBy("rule").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '[' || lo || ',' || hi || ')' WHEN 1 THEN '(' || lo || ',]' WHEN 2 THEN '(,' || hi || ')' END AS range
FROM (SELECT p_partkey, p_size, CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(floor(p_retailprice) + p_size AS BIGINT) AS hi FROM part)
""")
def range_texts(spark, d):
    low, k = F.floor("p_retailprice").cast("long"), F.col("p_size") % 4
    some = k != 3
    return table(spark, d, "part").select("p_partkey", constraints.range_text(F.when(k < 2, low), F.when((k == 0) | (k == 2), low + F.col("p_size")), F.when(some, k == 0), F.when(some, k == 1)).alias("range"))


@query("""
SELECT s_nationkey AS nation, s_name AS description, CASE WHEN s_suppkey % 9 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN s_suppkey % 9 <> 0 THEN upper(s_name) END AS code, 100.0::DOUBLE AS percent, 'done' AS upload
FROM supplier WHERE s_suppkey % 9 <> 0
UNION ALL SELECT s_nationkey, CAST(100000 + s_suppkey AS VARCHAR), 'error', NULL, 100.0, 'done' FROM supplier WHERE s_suppkey % 9 = 0
""")
def upload_states(spark, d):
    """Uploads for each nation, of as many rows as one may have, its suppliers' names as rows (every ninth a number, which is no description); states after a run, a snapshot and a run without news."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 9 == 0, (100_000 + F.col("s_suppkey")).cast("string")).otherwise(F.col("s_name")).alias("description"))
    uploads, target = (f"{folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("uploads", "states"))
    rows.repartition("nation").write.option("header", "true").option("maxRecordsPerFile", MOST_ROWS).partitionBy("nation").csv(uploads)
    answer = lambda docs: docs.select("id", F.lit("resolved").alias("status"), F.upper("text").alias("code"), F.array("text").alias("remaining"))
    for _ in range(2):
        batches.run_batches(spark, uploads, target, answer).awaitTermination()
        batches.compact(spark, target)
    uploads_now = batches.batch_status(spark, target).select("path", "percent", F.col("status").alias("upload"))
    return batches.current(spark, target).join(uploads_now, "path").select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "description", "status", "code", "percent", "upload")
