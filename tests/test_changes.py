"""Painting of spans, folds of edits and bitmaps, against plain versions."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from nomenclia.operators import bitmaps, edits, replace, spans
from nomenclia.sources import constraints


def plain_pieces(rows):
    out = []
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc and r[2] is not None and r[3] is not None]
        shown = {}
        for _, span, a, b, kind in own:
            rank = spans.PRIORITY.index(kind) + 1 if kind in spans.PRIORITY else 0
            for at in range(max(0, a), b):
                shown[at] = min(shown.get(at, (9,)), (-rank, span, kind))
        for at in sorted(shown):
            if out and out[-1][0] == doc and out[-1][2] == at and out[-1][3] == shown[at][1]:
                out[-1][2] += 1
            else:
                out.append([doc, at, at + 1, *shown[at][1:]])
    return sorted(map(tuple, out))


def test_pieces(spark):
    r = random.Random(3)
    rows = []
    for doc in range(30):
        for span in range(r.randint(0, 14)):
            a = r.randint(-3, 70)
            rows.append((doc, span, a, a + r.choice((0, 1, 2, 7, 30, 64, 200)), r.choice((*spans.PRIORITY, "other"))))
    rows += [(50, 1, 0, 2_000_000_000, "name"), (50, 2, 5, 1_000_000_000, "typo"), (51, 1, None, 4, "typo"), (51, 2, 3, None, "name")]
    df = spark.createDataFrame(rows, "id long, span long, start int, end int, kind string")
    got = sorted((x.id, x.start, x.end, x.span, x.kind) for x in spans.pieces(df, spans.by_kind(F.col("kind"))).collect())
    assert got == plain_pieces([x for x in rows if x[0] < 50]) + [(50, 0, 5, 1, "name"), (50, 5, 1_000_000_000, 2, "typo"), (50, 1_000_000_000, 2_000_000_000, 1, "name")]


def test_blocks_cover_once(spark):
    rows = [(a, b) for a in range(20) for b in range(a + 1, 21)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", spans._blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    for x in got:
        covered = sorted(at for k in x.blocks for at in range(k.block << k.level, (k.block + 1) << k.level))
        assert covered == list(range(x.a, x.b)) and len(x.blocks) <= 2 * (x.b - x.a).bit_length()


def plain_state(actions):
    """The store of an interface: every action in turn, without those that are undone."""
    out = {}
    for session in {a[0] for a in actions}:
        own = [a for a in actions if a[0] == session and a[1] is not None]
        undone = {a[5] for a in own if a[2] == "undo"}
        overrides, excluded, selected = {}, {}, None
        for _, number, action, name, value, _ in sorted(own, key=lambda a: a[1]):
            if number in undone and action != "undo":
                continue
            key = (name or "").strip().lower()
            if action in ("set", "remove") and key:
                overrides.pop(key, None), excluded.pop(key, None)
                selected = None
                if action == "set":
                    overrides[key] = (name.strip(), value)
                else:
                    excluded[key] = name.strip()
            elif action == "select":
                selected = value
        if own:
            out[session] = (list(overrides.values()), list(excluded.values()), selected)
    return out


def test_edits_in_any_order(spark):
    r = random.Random(6)
    actions = []
    for session in range(25):
        for number in range(r.randint(1, 14)):
            action = r.choice(("set", "set", "remove", "select", "undo"))
            name = r.choice(("Цвет", " цвет ", "ЦВЕТ", "Масса", "", None)) if action in ("set", "remove") else None
            actions.append((session, number, action, name, r.choice(("a", "b", None)), r.randint(0, 14) if action == "undo" else None))
    actions += [(99, None, "set", "x", "y", None), (100, 1, "undo", None, None, 2), (100, 2, "set", "x", "y", None)]
    expected = plain_state(actions)
    for seed in (1, 2):
        shuffled = actions[:]
        random.Random(seed).shuffle(shuffled)
        df = spark.createDataFrame(shuffled, "session long, number long, action string, name string, value string, undoes long").repartition(3)
        got = {x.session: ([tuple(o) for o in x.overrides], x.excluded, x.selected_code) for x in edits.state(df).collect()}
        assert got == expected


def test_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "BLOCK", 9000)
    r = random.Random(4)
    codes = [f"c{k}" for k in range(40_000)]  # beyond one block of bits
    having = [(f"k{k}", c) for k in range(4) for c in r.sample(codes, 9000)] + [("all", c) for c in codes] + [("k0", codes[0])] * 3 + [(None, "c1"), ("k1", None), ("none", "z")]
    df = spark.createDataFrame(having, "key string, code string")
    numbers = bitmaps.numbered(df.select("code"))
    assert sorted(x.number for x in numbers.collect()) == list(range(1, 40_002))
    index = bitmaps.build(df, numbers)
    sets = {"+".join(s): list(s) for n in (1, 2, 3) for s in combinations(("k0", "k1", "k2", "all"), n)} | {"twice": ["k0", "k0"], "gone": ["k0", "no such"], "apart": ["k3", "none"]}
    asked = spark.createDataFrame(list(sets.items()), "set string, keys array<string>")
    found = bitmaps.all_of(index, asked)
    of = {k: {c for key, c in having if key == k and c} for k in ("k0", "k1", "k2", "k3", "all", "none", "no such")}
    expected = {s: set.intersection(*(of[k] for k in keys)) for s, keys in sets.items()}
    assert {x.set: x.n for x in bitmaps.counts(found).collect()} == {s: len(v) for s, v in expected.items() if v}
    got = {}
    for x in bitmaps.positions(found.where(F.col("set").isin("k0+k1+k2", "twice", "gone", "apart")), numbers).collect():
        got.setdefault(x.set, set()).add(x.code)
    assert got == {s: expected[s] for s in ("k0+k1+k2", "twice")}


def test_spans_over_edits(spark):
    """Each letter of a text is a span; after edits in turn it stands where its letter is, or is gone."""
    r = random.Random(9)
    rows, spans_, expected = [], [], {}
    for doc in range(40):
        letters = [chr(0x430 + k) for k in range(r.randint(0, 30))]
        text, edits_ = list(letters), []
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(text))
            removed = r.randint(0, min(5, len(text) - at))
            added = "".join(r.choice("xyz") for _ in range(r.randint(0, 6)))
            edits_.append((at, removed, added))
            text[at : at + removed] = list(added)
        rows.append((doc, "".join(letters), edits_))
        spans_ += [(doc, k, k + 1, c) for k, c in enumerate(letters)]
        expected[doc] = "".join(text)
    docs = spark.createDataFrame(rows, f"id long, text string, edits array<struct<{replace.EDIT.replace(' ', ':')}>>".replace(",:", ","))
    got = {x.id: x.t for x in docs.select("id", replace.edited(F.col("text"), F.col("edits")).alias("t")).collect()}
    assert got == expected
    edits_ = docs.select("id", F.posexplode("edits").alias("number", "e")).select("id", "number", "e.*").orderBy(F.rand(3))
    moved = replace.carry(spark.createDataFrame(spans_, "id long, start int, end int, letter string"), edits_).collect()
    assert {(x.id, x.start, x.letter) for x in moved} == {(doc, k, c) for doc, t in expected.items() for k, c in enumerate(t) if c not in "xyz"}
    assert all(x.end == x.start + 1 for x in moved)


def test_name_edits(spark):
    rows = [("Стул Школьный, синий", "стул школьный", "Парта", False), ("синий стол", "шкаф", "Парта", False), ("что-то", "", "Парта", True), ("что-то", "", "Парта", False), (None, None, "Парта", True)]
    df = spark.createDataFrame(rows, "t string, m string, n string, u boolean").withColumn("e", replace.name_edit(F.col("t"), F.col("m"), F.col("n"), F.col("u")))
    assert [x.r for x in df.select(replace.edited(F.col("t"), F.array("e")).alias("r")).collect()] == ["Парта, синий", "Парта, синий стол", "Парта", "Парта, что-то", "Парта"]
    tokens = spark.createDataFrame([([("Стул",), ("синий",), ("Школьный",)], [2, 0])], "t array<struct<text:string>>, e array<int>")
    assert tokens.select(replace.matched_text(F.col("t"), F.col("e")).alias("m")).first()["m"] == "Стул Школьный"


def test_constraints(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, 200)], "k long, v int")
    rules = {"not negative": F.col("v") >= 0, "small": "v < 100"}
    checked = constraints.check(rows, rules, str(tmp_path))
    assert [r.k for r in checked.kept.collect()] == [1] and checked.kept.columns == rows.columns
    assert {r.k: r.broken for r in checked.refused.collect()} == {2: ["not negative", "small"], 3: ["not negative"], 4: ["small"]}
    assert {r.rule: r.n for r in checked.counts().collect()} == {None: 1, "not negative": 2, "small": 2}
    assert constraints.check(rows, {}, str(tmp_path)).kept.count() == 4 and constraints.check(rows.limit(0), rules, str(tmp_path)).refused.count() == 0
    with pytest.raises(ValueError):
        constraints.check(rows.withColumn("broken", F.lit(1)), rules, str(tmp_path))
    texts = spark.createDataFrame([(1.0, 2.5, True, False), (None, 2.0, False, True), (None, None, None, None)], "a double, b double, c boolean, d boolean")
    assert [r.t for r in texts.select(constraints.range_text(*map(F.col, "abcd")).alias("t")).collect()] == ["[1.0,2.5)", "(,2.0]", None]
