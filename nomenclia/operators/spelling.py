"""Spelling against the catalogue's vocabulary, as a blocked join, and corrections of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenclia.functions import text as X
from nomenclia.functions.similarity import osa_column
from nomenclia.shipping import ship

# ---------------------------------------------------------------- fixed values
# Common words that no catalogue lists but nobody misspelt.
GENERAL = (
    "китай россия рф германия италия турция япония корея сша тайвань вьетнам индия беларусь белоруссия польша чехия франция "
    "испания казахстан узбекистан швеция финляндия малайзия таиланд индонезия бренд марка модель артикул производитель "
    "изготовитель страна происхождения упаковка коробка комплект набор штук шт новый новая новое новые оригинал оригинальный "
    "гарантия цвет размер белый черный серый синий красный зеленый желтый коричневый бежевый голубой розовый фиолетовый "
    "оранжевый бордовый хаки темный светлый ltd llc inc ооо зао оао ао ип"
).split()
# ----------------------------------------------------------------
SHORT, NEAR, FAR = 7, 1, 2


def unknown_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct Cyrillic words of four letters or more (column word) that neither the vocabulary nor its stems know."""
    spark = words.sparkSession
    general = spark.createDataFrame([(w,) for w in GENERAL], "word string")
    stems = vocabulary.select("word").unionByName(general).distinct().select(X.word_stem(F.col("word")).alias("stem")).distinct()
    asked = words.where((F.length("word") >= 4) & F.col("word").rlike("^[а-я]")).select("word").distinct()
    return asked.join(vocabulary.select("word"), "word", "left_anti").withColumn("stem", X.word_stem(F.col("word"))).join(stems, "stem", "left_anti").select("word")


def undoubled(word: Column) -> Column:
    """All spellings of ``word`` with one of two equal neighbours left out."""
    places = F.filter(F.sequence(F.lit(2), F.length(word)), lambda i: F.substring(word, i, F.lit(1)) == F.substring(word, i - 1, F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def suggestions(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, suggestion, distance) for unknown words with a near neighbour of the same first letter.

    Blocked by first letter and length; the built-in distance with twice the
    bound (a swap is two plain edits) leaves few pairs for the exact one.
    """
    most = F.when(F.length("word") <= SHORT, NEAR).otherwise(FAR)
    asked = unknown_words(words, vocabulary).withColumn("most", most).withColumn("first", F.substring("word", 1, 1)).withColumn("len", F.explode(F.sequence(F.length("word") - F.col("most"), F.length("word") + F.col("most"))))
    known = vocabulary.where("length(word) >= 3").select(F.col("word").alias("suggestion"), "weight", F.substring("word", 1, 1).alias("first"), F.length("word").alias("len"))
    near = asked.join(known, ["first", "len"]).where(F.levenshtein("word", "suggestion", 2 * FAR) >= 0)
    ship(words.sparkSession)
    found = near.withColumn("distance", osa_column(F.col("word"), F.col("suggestion"), FAR)).where("distance <= most")
    order = F.struct("distance", ~F.array_contains(undoubled(F.col("word")), F.col("suggestion")), -F.col("weight"), F.abs(F.length("suggestion") - F.length("word")), "suggestion")
    return found.groupBy("word").agg(F.min_by(F.struct("suggestion", "distance"), order).alias("s")).select("word", "s.suggestion", "s.distance")


def issues(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, start, end, original, suggestion, distance) of the misspelt words of ``docs`` (id, text)."""
    tokens = docs.select("id", F.explode(X.tokens_of(X.normalize_text(F.col("text")))).alias("t")).where("t.kind = 'word'")
    return tokens.join(found, F.col("t.norm") == F.col("word")).select("id", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.text").alias("original"), "suggestion", "distance")


def corrected(docs: DataFrame, issue: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``corrected``: replacements spliced in by offset, capitals kept."""
    lists = issue.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "original", "suggestion"))).alias("issues"))

    def splice(s: Column, x: Column) -> Column:
        word = F.when(F.substring(x["original"], 1, 1).rlike("(?U)^\\p{Lu}"), F.concat(F.upper(F.substring(x["suggestion"], 1, 1)), F.substring(x["suggestion"], F.lit(2), F.length(x["suggestion"])))).otherwise(x["suggestion"])
        return F.struct(F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), word).alias("out"), x["end"].alias("at"))

    done = F.aggregate("issues", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), splice)
    joined = docs.join(lists, "id", "left").withColumn("__d", F.when(F.col("issues").isNotNull(), done))
    return joined.withColumn("corrected", F.when(F.col("__d").isNull(), F.col("text")).otherwise(F.concat("__d.out", F.substring(F.col("text"), F.col("__d.at") + 1, F.length("text"))))).drop("__d", "issues")
