"""The registered queries themselves, on a folder of small tables, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from nomenclia.llm.queries import QUERIES, vocabulary

TEXTS = brute.texts(9)[:110] + brute.texts(9)[-8:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(2)
    docs = [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int("w1 " in (t or ""))) for k, t in enumerate(TEXTS) if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(16)]) for k in range(120)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def rows(spark, folder, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, folder).collect()}


def ids(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_op1(spark, folder):
    got = rows(spark, folder, "op1_mix_sources")
    assert {k: r["size"] for k, r in got.items()} == {k: len(brute.words(t)) for k, t in enumerate(TEXTS)}
    assert all(0 <= r.taken <= 2 * r["size"] for r in got.values())


def test_op2(spark, folder):
    got = QUERIES["op2_pack_documents"](spark, folder).collect()
    whole = {k: [*ids("byte_bpe_50k.json", t), 0] for k, t in enumerate(TEXTS)}
    assert all(crc(whole[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for b in bins.values() for _, n in b) == sum(map(len, whole.values()))
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [at for at, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048


def test_op3(spark, folder):
    got = rows(spark, folder, "op3_ngram_join")
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(TEXTS))] == brute.classes(TEXTS)


def test_op4(spark, folder):
    got = rows(spark, folder, "op4_toxicity")
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items()) and len(got) == len(TEXTS)


def test_op5(spark, folder):
    table = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op5_topk_search"](spark, folder).collect())
    expected = []
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(table[q], v, strict=True)), k) for k, v in table.items() if k != q)[:5]
        expected += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert got == expected


def test_op6(spark, folder):
    got = rows(spark, folder, "op6_suffix_tree_lm")
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(TEXTS))}
    tokens = {k: [*brute.lower_words(t), None] for k, t in enumerate(TEXTS)}
    known = {w for k, ws in tokens.items() if not held[k] for w in ws}
    for k, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known) == (held[k], len(tokens[k]), sum(w in known for w in tokens[k])) and r.score < 0
        assert r.train_tokens == sum(len(ws) for j, ws in tokens.items() if not held[j])


def test_op7(spark, folder):
    got = rows(spark, folder, "op7_ogg_media")
    for k, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        assert (got[k].n_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = {}
    for k, t in enumerate(TEXTS):
        assert same.setdefault(t or "", (got[k].media_sha256, got[k].feature)) == (got[k].media_sha256, got[k].feature)


def test_op8(spark, folder):
    got = rows(spark, folder, "op8_repeated_passages")
    for k, kept in enumerate(brute.removed(TEXTS)):
        n = len(brute.words(TEXTS[k]))
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, n - len(kept.split()), hashlib.sha256(kept).hexdigest())


def test_op9(spark, folder):
    got, at = rows(spark, folder, "op9_token_records"), 0
    for k, t in enumerate(TEXTS):
        whole = [*ids("word_bpe_49k.json", t), 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)


def test_op10(spark, folder):
    got = rows(spark, folder, "op10_secret_scan")
    names = ("assign", "access", "hex")
    for k, t in enumerate(TEXTS):
        spans = brute.secret_spans(t)
        said = ",".join(f"{names[kind]}:{a}:{b}" for a, kind, b in spans)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(s[1] == n for s in spans) for n in range(3))
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(got[k].spans.split(",")) or not spans


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    """Folders with empty tables, and with rows that repeat, null ids, texts and labels."""
    paths = {}
    for kind in ("empty", "repeated"):
        paths[kind] = str(tmp_path_factory.mktemp(kind))
        for name in ("documents", "labels", "embeddings"):
            df = spark.read.parquet(f"{folder}/{name}.parquet").limit(30 if kind == "repeated" else 0)
            key = df.columns[0]
            if kind == "repeated":
                first = df.where(f"{key} < 3")
                nulls = df.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
                same = first.withColumn("text", F.lit("other words of one id")) if name == "documents" else first
                df = df.unionByName(first).unionByName(first).unionByName(same).unionByName(nulls).unionByName(nulls)
            df.write.parquet(f"{paths[kind]}/{name}.parquet")
    return paths


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    assert QUERIES[name](spark, odd["empty"]).count() == 0
    got = QUERIES[name](spark, odd["repeated"])
    n = spark.read.parquet(f"{odd['repeated']}/documents.parquet").count()
    rows = got.collect()
    if name in ("pipeline", "op5_topk_search"):
        assert rows
    elif name == "op12_spelling_variants":
        docs = spark.read.parquet(f"{odd['repeated']}/documents.parquet").select("doc_id", "text").collect()
        assert {r.word: r.n for r in rows} == brute.plain_words(docs)
    elif name == "op11_filter_audit":
        parts = {r.source or "" for r in spark.read.parquet(f"{odd['repeated']}/documents.parquet").collect()}
        assert len(rows) == 600 * len(parts) and sum(r.kept + r.removed for r in rows if r.step == 1) == 120 * n
    elif name == "op2_pack_documents":
        assert sum(r.start == 0 for r in rows) == n
    else:
        assert len(rows) == n and sum(r.doc_id is None for r in rows) == 2
