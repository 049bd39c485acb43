"""Operators that sort or join the whole table by content: filter audit, spelling variants and exact duplicates."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from nomenclia.llm import exact_dedup, filter_audit, variants
from nomenclia.llm.common import settings

#: Partitions as small as possible, so that runs are cut.
MANY = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = brute.texts(3)[:60] + [None, "", " \n", "same words here"] * 3
    texts += ["copy of one text"] * 150 + ["copy of  one\ttext "] * 20 + ["A SHOUT & more"] * 40
    out = [(k, t, None if k % 7 == 0 else ["", "a", "b"][k % 3]) for k, t in enumerate(texts)]
    out += [(3, "copy of one text", "a")] * 5 + [(None, "copy of one text", "b")] * 4 + [(None, None, None), (None, "alone", "a"), (2**40, "same words here", "c")]
    r.shuffle(out)
    return out


def plain_groups(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in exact_dedup.SPACE)
    best, size = {}, Counter(norm(t) for _, t, _ in rows)
    for k, t, _ in rows:
        rank = (-len(t or ""), k is None, k or 0)
        best[norm(t)] = min(best.get(norm(t), rank), rank)
    keep = {n: None if r[1] else r[2] for n, r in best.items()}
    return Counter((k, keep[norm(t)], size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for k, t, _ in rows), len(best)


@pytest.mark.parametrize("conf", [MANY, {}])
def test_exact_dedup(spark, rows, conf):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumns({"norm": F.lit(1), "pid": F.lit("x"), "head": F.col("doc_id")})
    with settings(spark, conf):
        got = exact_dedup.groups(docs).collect()
        whole = exact_dedup.keep_one(docs)
        kept = whole.collect()
    expected, n = plain_groups(rows)
    assert Counter((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got) == expected
    stay = [x for x in got if x.kept]
    assert len({x.text_sha256 for x in stay}) == len(stay) == n and all(x.doc_id == x.keep_id for x in stay)
    assert whole.columns == docs.columns and sorted(str((x.doc_id, hashlib.sha256("".join((x.text or "").split()).encode()).hexdigest())) for x in kept) == sorted(str((x.doc_id, x.text_sha256)) for x in stay)


def plain_audit(rows, labels):
    masks = []
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    for k, t, source in rows:
        t = t or ""
        w = brute.words(t)
        failed = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > least[t])
        masks.append((source or "", {x for x, f in zip("ABCDE", failed, strict=True) if f}, *labels.get(k, (0, 0))))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                go = [m for m in left if x in m[1]]
                removed[x] += len(go)
                left = [m for m in left if x not in m[1]]
                out[part, "".join(order), step] = [x, len(left), len(go), sum(x in m[1] for m in own) - len(go), sum(m[1] == {x} for m in own), sum(m[2] == 1 for m in go), sum(m[3] == 1 for m in go)]
        for key, row in out.items():
            if key[0] == part:
                row.append(removed[row[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


@pytest.mark.parametrize("conf", [MANY, {}])
def test_filter_audit(spark, rows, conf):
    labels = {k: (k % 2, int(k % 5 == 0)) for k in range(0, 200, 3)}
    given = [(k, *v) for k, v in labels.items()] + [(3, None, None), (3, 0, 0), (None, 1, 1), (2**41, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumns({"mask": F.lit("x"), "print": F.lit(2), "part": F.lit(0)})
    with settings(spark, conf):
        counted = filter_audit.counters(filter_audit.masks(docs), spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
        got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in filter_audit.audit(counted).collect()}
    assert got == plain_audit(rows, labels)


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(n):
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


@pytest.fixture(scope="module")
def spellings():
    """Words with edits of each kind at each end, letters of two bytes, a very long one, and many that share all but their end or start."""
    r = random.Random(8)
    letters = "abcdefghij" + "éÀÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "x" * 200]
    some = []
    for w in base:
        some += [w] * r.randint(1, 40)
        for _ in range(6):
            k, c = r.randrange(len(w) + 1), r.choice(letters)
            some += [r.choice((w[:k] + c + w[k:], w[: k - 1] + w[k:] if k else w, w[:k] + c + w[k + 1 :]))] * r.randint(1, 12)
    some += ["shared" + "".join(r.choice("abc") for _ in range(4)) for _ in range(300)] + ["".join(r.choice("abc") for _ in range(4)) + "shared" for _ in range(300)]
    some += ["kettle"] * 60 + ["kettla"] * 20 + ["kottla"] * 5  # a path of two forms
    some = [w.upper() if r.random() < 0.1 and w.isascii() else w for w in some]
    r.shuffle(some)
    docs = [(k, " ".join(some[k::97]) + "; 1234 four") for k in range(97)]
    return docs + [(None, docs[0][1]), (5, docs[5][1]), (200, None), (201, ""), (202, "..., -")]


@pytest.mark.parametrize("dear", [variants.DEAR, 30])
def test_spelling_variants(spark, spellings, dear):
    docs = spark.createDataFrame(spellings, "doc_id long, text string").withColumns({"word": F.lit(1), "run": F.lit("x"), "n": F.lit("y")})
    counted = variants.words(docs, variants.one_lost)
    n = {x.word: x.n for x in counted.collect()}
    assert n == brute.plain_words(spellings) and len(n) > 150
    pairs = variants.near_pairs(counted, dear).collect()
    assert len({frozenset((x.word, x.near)) for x in pairs}) == len(pairs)
    assert {frozenset((x.word, x.near)) for x in pairs} == {frozenset((v, w)) for v in n for w in n if v < w and one_edit(v, w)}
    if dear == variants.DEAR:
        got = variants.forms(counted).collect()
        assert {x.word: tuple(x)[1:] for x in got} == plain_forms(n) and len(got) == len(n)
        assert {x.word: (x.form, x.root) for x in got}["kottla"] == ("kettla", "kettle")


def test_large_groups_are_parted(spark):
    """Words that share their first half are not paired within it."""
    words = ["prefix" + a + b + c + d for a in "abcdef" for b in "abcdef" for c in "abcdef" for d in "abcdef"]
    counted = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert variants.near_pairs(counted, 200).count() == len(words) * 20 // 2


def test_runs_of_one_partition_and_many(spark):
    """A group of identical rows is cut over partitions, and so is a text longer than a splitter."""
    long = "long opening " * 200
    rows = [(None, long + str(k // 40)) for k in range(120)] + [(7, "x")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    with settings(spark, MANY):
        got = exact_dedup.groups(docs).groupBy("group_size", "keep_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("k")).collect()
    assert {tuple(x) for x in got} == {(40, None, 120, 3), (100, 7, 100, 1)}
