"""Numbers as one pattern, and the judgement of claims by joins, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from nomenclia.functions import numbers as N
from nomenclia.functions import text as X
from nomenclia.functions import units as U
from nomenclia.operators import offers

NUMBERS = {
    "длина 320 мм": [("number", 320.0, None, None, "mm", "320 мм")],
    "320мм": [("number", 320.0, None, None, "mm", "320мм")],
    "масса 0,5 кг длина рукоятки 32 см": [("number", 0.5, None, None, "kg", "0,5 кг"), ("number", 32.0, None, None, "cm", "32 см")],
    "модель AB-12": [],
    "12-5-3": [],
    "5шт2": [],
    "a12.5": [],
    "(12)": [("number", 12.0, None, None, None, "12")],
    "300x200x15 мм": [("dims", 300.0, None, None, "mm", "300x200x15 мм")],
    "не менее 5 кг": [("interval", 5.0, 5.0, None, "kg", "не менее 5 кг")],
    "до 10 кг": [("interval", 10.0, None, 10.0, "kg", "до 10 кг")],
    "от 5 до 10 см": [("interval", 5.0, 5.0, 10.0, "cm", "от 5 до 10 см")],
    "5 – 10 см": [("interval", 5.0, 5.0, 10.0, "cm", "5 - 10 см")],
    "10 мм до 2 см": [("interval", 10.0, 10.0, 2.0, "cm", "10 мм до 2 см")],
    "≥ 4 л": [("interval", 4.0, 4.0, None, "l", "≥ 4 л")],
    "до: 5": [("number", 5.0, None, None, None, "5")],
    "более 3,5 квт·ч": [("interval", 3.5, 3.5, None, "kwh", "более 3,5 квт·ч")],
    "диаметр 5 м2": [("number", 5.0, None, None, "m2", "5 м2")],
    "": [],
    None: [],
}


def test_numbers(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string").select("t", N.numbers_of(X.normalize_text("t")).alias("n"))
    for r in df.collect():
        text = X.plain_text(r.t)
        assert [(n.kind, n.value, n.low, n.high, n.unit, n.text) for n in r.n] == NUMBERS[r.t], r.t
        assert all(text[n.start : n.end] == n.text for n in r.n)
    assert df.where("t like '300x%'").first()["n"][0].dims == [300.0, 200.0, 15.0]


def test_unit_spellings(spark):
    """The alternation and the lookup find the unit that trying every pattern finds."""
    said = sorted({s for pattern, _, _ in U.ALIASES for s in U.spellings(pattern)} | {"кв. м", "об. / мин", "градусов цельсия", "л. с.", "А ч", "мм.", "мин..", "abc", "с5", "м/с2"})
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", U.unit_after(F.col("t")).alias("u")).collect()
    for r in got:
        known = U.plain_unit_at(r.t, 0)
        assert (r.u and (r.u.unit, r.u.length, r.u.weak)) == (known and (known[0].key, known[1], known[2])), r.t


UNITS = {"mm": ("Миллиметр", "length", 1.0), "cm": ("Сантиметр", "length", 10.0), "kg": ("Килограмм", "mass", 1000.0)}


def options(rows):
    """Option rows of (code, char, kind, label, unit, number, lower, upper)."""
    return [("p", code, char, True, 1, 2 if kind in ("range", "concrete") else 1, 1, kind, label, unit and UNITS[unit][0], number, low, high, True, False) for code, char, kind, label, unit, number, low, high in rows]


SCHEMA = "pool string, code string, char string, required boolean, kind int, char_type int, choice_type int, option_kind string, label string, unit string, number double, lower double, upper double, lower_inc boolean, upper_inc boolean"


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(f"c{k}", "Длина", "range", f"{100 * k}-{100 * k + 100}", "mm", None, 100.0 * k, 100.0 * k + 100) for k in range(5)]
    rows += [("c0", "Длина", "concrete", "7 см", "cm", 7.0, None, None), ("c5", "Длина", "quality", "12-15", None, None, None, None), ("c6", "Длина", None, None, None, None, None, None)]
    rows += [("c1", "Сорт", None, None, None, None, None, None)]
    rows += [(f"c{k}", "Цвет", "quality", x, None, None, None, None) for k, x in enumerate(("Синий", "Темно-синий", "Красный", "Зеленый лак"))]
    rows += [("c9", "Масса", "range", "от 3", "kg", None, 3.0, None)]
    df = spark.createDataFrame(options(rows), SCHEMA)
    positions = offers.by_position(df)
    offered = offers.offers(positions)
    return rows, offered, offers.characteristics(positions, offered)


def plain_number(rows, char, number, low, high, unit, said):
    """(status, accepted, matched)."""
    own = [r for r in rows if r[1] == char]
    units = {r[4] for r in own if r[4]}
    if unit and units and all(UNITS[u][1] != UNITS[unit][1] for u in units):
        return "unit_mismatch", [], None

    def inside(r, v):
        v = v * UNITS[unit][2] / UNITS[r[4]][2] if unit and r[4] else v
        return abs(r[5] - v) < 1e-9 if r[2] == "concrete" else (r[6] is None or v >= r[6]) and (r[7] is None or v < r[7])

    def fits(r):
        if r[2] not in ("range", "concrete") or (unit and r[4] and UNITS[unit][1] != UNITS[r[4]][1]):
            return False
        if number is not None:
            return inside(r, number)
        if low is not None and high is not None:
            return inside(r, low) and inside(r, high) and (r[2] == "range" or low == high)
        return r[2] == "range" and (r[7] is None and inside(r, low) if low is not None else r[6] is None and inside(r, high))

    accepted, matched = set(), []
    for code in {r[0] for r in own}:
        mine = [r for r in own if r[0] == code and r[3]]
        good = [r for r in mine if fits(r)] or [r for r in mine if r[2] == "quality" and r[3] == said.replace(" ", "")]
        if good or not mine:
            accepted.add(code)
        matched += good
    rank = lambda r: (r[2] == "range", 0.0 if r[2] != "range" else float("inf") if None in (r[6], r[7]) else r[7] - r[6], -(r[6] if r[6] is not None else float("-inf")), r[3])
    if not any(r[3] for r in own):
        return "no_constraints", sorted(accepted), None
    return "ok" if accepted else "invalid", sorted(accepted), min(matched, key=rank)[3] if matched else None


def test_numbers_are_judged(spark, pool):
    rows, offered, chars = pool
    r = random.Random(2)
    claims = []
    for k in range(300):
        char, unit = r.choice(("Длина", "Длина", "Масса", "Сорт")), r.choice((None, "mm", "cm", "kg"))
        ends = sorted(r.choice((0.5, 3.0, 7.0, 70.0, 100.0, 149.0, 150.0, 199.9, 200.0, 499.0, 500.0)) for _ in range(2))
        number, low, high = r.choice(((ends[0], None, None), (None, ends[0], ends[1]), (None, ends[0], None), (None, None, ends[1])))
        claims.append((str(k), "p", char.lower(), number, low, high, unit, r.choice(("x", "12 - 15"))))
    df = spark.createDataFrame(claims, "claim string, pool string, key string, number double, low double, high double, unit string, said string")
    got = {x.claim: x for x in offers.check_numbers(df, offered, chars).collect()}
    assert len(got) == 300
    for claim, _, key, number, low, high, unit, said in claims:
        expected = plain_number(rows, key.capitalize(), number, low, high, unit, said)
        x = got[claim]
        assert (x.status, x.accepted, x.matched) == expected, (claims[int(claim)], x, expected)
    assert {x.status for x in got.values()} == {"ok", "invalid", "no_constraints", "unit_mismatch"}
    one = lambda number, unit: [x for c, x in zip(claims, (got[c[0]] for c in claims), strict=True) if c[2] == "длина" and c[3] == number and c[6] == unit][0]
    assert one(7.0, "cm").normalized == "70" and one(7.0, "cm").unit == "мм" and one(7.0, "cm").matched == "7 см" and one(7.0, "cm").notes[0].startswith("converted")
    assert one(149.0, None).notes == ["unit not given, мм assumed"]


def test_labels_are_judged(spark, pool):
    rows, offered, chars = pool
    claims = [("1", "p", "цвет", "Синий"), ("2", "p", "цвет", "Лиловый"), ("3", "p", "сорт", "любой")]
    got = {x.claim: x for x in offers.check_labels(spark.createDataFrame(claims, "claim string, pool string, key string, label string"), offered, chars).collect()}
    assert (got["1"].status, got["1"].accepted, got["1"].matched) == ("ok", ["c0"], "Синий")
    assert (got["2"].status, got["2"].accepted, got["2"].has, len(got["2"].suggestions)) == ("invalid", [], ["c0", "c1", "c2", "c3"], 4)
    assert (got["3"].status, got["3"].accepted) == ("no_constraints", ["c1"])


def test_words_find_their_label(spark, pool):
    _, _, chars = pool
    texts = {"синий": "Синий", "СИНИЕ": "Синий", "лаком зеленым": "Зеленый лак", "краснй": "Красный", "темно-синй": "Темно-синий", "лиловый": None, "": None}
    df = spark.createDataFrame([(t, "p", "цвет", t) for t in texts], "claim string, pool string, key string, text string")
    got = {x.claim: (x.label, x.hints) for x in offers.nearest_labels(df, chars).collect()}
    assert {t: got.get(t, (None,))[0] for t in texts} == texts
    assert "Красный" in got["краснй"][1]


def test_names_find_their_characteristic(spark, pool):
    _, _, chars = pool
    df = spark.createDataFrame([("p", n) for n in ("Длина", "длина", "длинна", "вязкость")], "pool string, name string")
    got = {x.name: x.key for x in offers.nearest_names(df, chars, 85.0).collect()}
    assert got == {"Длина": "длина", "длина": "длина", "длинна": "длина"}
