"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.llm import exact_dedup, filter_audit, lm, mixing, ngram_join, ogg, packing, records, secrets, substring, topk, toxicity, variants
from nomenclia.llm.common import n_words, stage, staging_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stage(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    mixed = mixing.mix(sized, size=F.col("size"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"), F.round("repeat_position", 9).alias("repeat_position"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return packing.pack(cut)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(toxicity.fold() != 0))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (toxicity.fold(folds=7) == 2).alias("held_out"), "text")
    return lm.score(docs, ~F.col("held_out"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.from_media(ogg.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return records.build_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.spans_text(F.col("base_spans")), 256).alias("base_sha256"), secrets.spans_text(F.col("all_spans")).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.masks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return filter_audit.audit(filter_audit.counters(failed, table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.forms(variants.words(table(spark, sf_dir, "documents").select("doc_id", "text"), variants.one_lost))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mix_sources": op1_mix_sources,
    "op2_pack_documents": op2_pack_documents,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_topk_search": op5_topk_search,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_ogg_media": op7_ogg_media,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_token_records": op9_token_records,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
}
OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS cycle FROM s),
w AS (SELECT *, CASE cycle WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM o),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, cycle, least(cap::DOUBLE, w * (max(level) OVER ())) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.cycle, CAST(round(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(size, greatest(0, goal - before)) AS one, least(size, greatest(0, goal - before - source_size)) AS two FROM p
), u AS (SELECT *, least(1.0::DOUBLE, (before + one / 2.0::DOUBLE) / target) AS u1, least(1.0::DOUBLE, (before + source_size + two / 2.0::DOUBLE) / target) AS u2 FROM c),
f AS (
  SELECT doc_id, size, source_size, target, one + two AS taken,
    CASE WHEN one > 0 THEN CASE cycle
      WHEN 0 THEN CASE WHEN u1 <= 0.625 THEN 2 * u1 / (1.5 + sqrt(2.25 - 2 * u1)) ELSE 0.5 + 2 * (u1 - 0.625) / (1 + sqrt(1 - 2 * (u1 - 0.625))) END
      WHEN 1 THEN CASE WHEN u1 <= 0.375 THEN 2 * u1 / (0.5 + sqrt(0.25 + 2 * u1)) ELSE 0.5 + 2 * (u1 - 0.375) / (1 + sqrt(1 + 2 * (u1 - 0.375))) END
      ELSE u1 END END AS position,
    CASE WHEN two > 0 THEN CASE cycle
      WHEN 0 THEN CASE WHEN u2 <= 0.625 THEN 2 * u2 / (1.5 + sqrt(2.25 - 2 * u2)) ELSE 0.5 + 2 * (u2 - 0.625) / (1 + sqrt(1 - 2 * (u2 - 0.625))) END
      WHEN 1 THEN CASE WHEN u2 <= 0.375 THEN 2 * u2 / (0.5 + sqrt(0.25 + 2 * u2)) ELSE 0.5 + 2 * (u2 - 0.375) / (1 + sqrt(1 + 2 * (u2 - 0.375))) END
      ELSE u2 END END AS repeat_position
  FROM u
)
SELECT doc_id, size, source_size, target, taken, round(position, 9) AS position, round(repeat_position, 9) AS repeat_position FROM f
"""

OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.own, b.own, c.own, d.own, e.own] AS owns
  FROM f a, f b, f c, f d, f e WHERE a.own + b.own + c.own + d.own + e.own = 31 AND a.own | b.own | c.own | d.own | e.own = 31
), s AS (SELECT filter_order, step, owns[step] AS own, coalesce(list_sum(owns[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)),
g AS (
  SELECT c.part, s.filter_order, CAST(s.step AS INTEGER) AS step, s.own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""

#: Near words are joined by the word with one place left out: the same place in both, or the whole of the shorter word.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(i))
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents
), c AS (SELECT d, run, count(*) AS n FROM r WHERE len(run) >= 5 GROUP BY d, run),
b AS (SELECT *, hex(d || ':' || run) AS bytes FROM c),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda k: ('0x' || substr(bytes, 2 * k + 1, 2))::BIGINT)),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) AS h
  FROM b, tab
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word FROM h
  ) WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), p AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM w)),
e AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM p x JOIN p y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT p.word, w.word, w.n FROM p JOIN w ON w.word = p.rest
  UNION SELECT w.word, p.word, p.n FROM p JOIN w ON w.word = p.rest
), f AS (
  SELECT w.word, w.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.near_n >= 2 * w.n THEN q.near END AS form, CASE WHEN q.near_n >= 2 * w.n THEN q.near_n END AS form_n
  FROM w LEFT JOIN (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM e
  ) q ON q.word = w.word AND q.place = 1
), walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.at WHERE e.form IS NULL
"""

OP13_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, len(coalesce(text, '')) AS size FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op5_topk_search": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_dedup": OP13_SQL}
