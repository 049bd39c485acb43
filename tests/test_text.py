"""Scalar functions against literal expectations, and column functions against their plain twins."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomenclia.functions import similarity as S
from nomenclia.functions import text as X
from nomenclia.functions import units as U

WORDS = "стулья стул диван дивана кровати молотка перчаток мужские кожаная аккумуляторная сетевая деревянный зимняя новейший ёмкость вес длинность регулировкой ученический abc x5 матрас жёлтый".split()


@pytest.mark.parametrize("a,b", ["стулья стул".split(), "дивана диван".split(), "кровати кровать".split(), "молотка молоток".split(), "перчаток перчатки".split(), "мужские мужской".split()])
def test_same_stem(a, b):
    assert X.plain_word_stem(a) == X.plain_word_stem(b)


@pytest.mark.parametrize("a,b,like", [("кожаная", "кожи", True), ("аккумуляторная", "аккумулятора", True), ("сетевая", "сети", True), ("деревянный", "дерева", True), ("зимняя", "зима", True), ("стол", "стул", False), ("черный", "череп", False), ("дерево", "дерн", False)])
def test_roots(a, b, like):
    assert (X.plain_similarity(X.plain_word_stem(a), X.plain_word_stem(b)) > 0) == like


def test_columns_agree_with_twins(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for r in df.select("w", X.word_stem(F.col("w")).alias("s"), X.root(X.word_stem(F.col("w"))).alias("r"), X.stem(F.col("w"), True).alias("v")).collect():
        stem = X.plain_word_stem(r.w)
        assert (r.s, r.r, r.v) == (stem, X.plain_root(stem), X.plain_stem(r.w, True))


def test_tokens(spark):
    text = "Кол-во 5 шт, выс. 45см, «ЛДСП» 15,6"
    plain = X.plain_tokens(X.plain_text(text))
    assert (plain[0].norm, plain[0].text) == ("количество", "Кол-во")
    assert {"высота"} <= {t.norm for t in plain} and "15.6" in [t.norm for t in plain]
    texts = [text, "800 Вт, 1500 об/мин", "a😀б 5", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.tokens_of(X.normalize_text(F.col("t")))).collect()]
    for t, g in zip(texts, got, strict=True):
        assert [tuple(x) for x in g] == [(k.norm, k.kind, k.start, k.end, k.text) for k in X.plain_tokens(X.plain_text(t), False)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_normalisation_keeps_offsets(text):
    assert len(X.plain_text(text)) == len(text)


def test_numbers_and_units(spark):
    assert [X.plain_format(v) for v in (0.5, 320.0)] == ["0,5", "320"]
    row = spark.createDataFrame([(0.5, 320.0)], "a double, b double").select(X.format_number(F.col("a")), X.format_number(F.col("b")), X.interval_text(F.col("a"), F.lit(None).cast("double"))).first()
    assert list(row) == ["0,5", "320", "≥ 0,5"]
    u = U.UNITS
    assert U.plain_convert(32, u["cm"], u["mm"]) == 320 and U.plain_convert(0.5, u["kg"], u["g"]) == 500 and U.plain_convert(1, u["kg"], u["mm"]) is None
    assert [U.plain_okei(n).key for n in ("Миллиметр", "Кубический сантиметр; миллилитр", "Дюйм (25,4 мм)")] == ["mm", "ml", "inch"]
    text = "800 Вт, 1500 об/мин, 45см, 2 кв.м, 18 В"
    found = [U.plain_unit_at(text, t.end) for t in X.plain_tokens(text) if t.kind == "number"]
    assert [f[0].key for f in found] == ["w", "rpm", "cm", "m2", "v"] and [f[2] for f in found] == [False] * 4 + [True]
    got = spark.createDataFrame([(" Вт,",), ("см",), (" кв.м",), (" В",), ("abc",)], "t string").select(U.unit_after(F.col("t"))["unit"]).collect()
    assert [g[0] for g in got] == ["w", "cm", "m2", "v", None]


def test_similarity():
    assert (S.osa("ca", "abc"), S.osa("ab", "ba"), S.osa("стулл", "стул")) == (3, 1, 1)
    assert S.wratio("abc", "abc") == 100 and S.wratio("", "a") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("абв", max_size=7), st.text("абв", max_size=7))
def test_osa_is_symmetric(a, b):
    assert S.osa(a, b) == S.osa(b, a) >= 0
