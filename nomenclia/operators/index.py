"""The catalogue index as tables: name groups, postings, weights, vocabulary and phrases.

Inputs: ``positions`` (code, name, okpd2_name, ...), ``char_names`` (name, n),
``quality`` (label), ``supplier`` (category, name, kind, unit). Stems are
computed once for each distinct word and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenclia.functions import text as X


def stems_of(words: Column) -> Column:
    return F.transform(words, X.word_stem)


def _words(text: Column) -> Column:
    """Plain words of two letters or more, for the vocabulary."""
    return F.filter(F.regexp_extract_all(X.normalize_phrase(text), F.lit(r"[a-zа-я]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def with_phrase(df: DataFrame, column: str, phrase: str) -> DataFrame:
    """``df`` with the normalised phrase of ``column``, made once for each distinct value."""
    known = df.select(F.col(column).alias("__value")).distinct().withColumn(phrase, X.normalize_phrase(F.col("__value")))
    return df.join(known, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")


def name_groups(positions: DataFrame) -> DataFrame:
    """(norm, name, words, members): positions whose names are the same phrase; the name of the least code stands for all."""
    named = positions.groupBy("name").agg(F.min("code").alias("code"), F.count("*").alias("n")).withColumn("norm", X.normalize_phrase(F.col("name")))
    grouped = named.groupBy("norm").agg(F.min_by("name", "code").alias("name"), F.sum("n").alias("members"))
    return grouped.withColumn("name", F.trim(F.regexp_replace("name", r"(?U)\s+", " "))).withColumn("words", X.words_of(F.col("norm")))


def postings(groups: DataFrame) -> DataFrame:
    """(norm, place, stem, root): the distinct stems of each group's name in order, ``size`` of them."""
    word = groups.select("norm", F.posexplode("words").alias("place", "word"))
    stems = word.select("word").distinct().withColumn("stem", X.word_stem(F.col("word")))
    first = word.join(stems, "word").groupBy("norm", "stem").agg(F.min("place").alias("place"))
    return first.withColumn("root", X.root(F.col("stem"))).withColumn("size", F.count("*").over(Window.partitionBy("norm")))


def idf(posting: DataFrame, groups: DataFrame) -> DataFrame:
    """(stem, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    n = groups.agg(F.count("*").alias("n_groups"))
    df = posting.groupBy("stem").agg(F.count_distinct("norm").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("stem", "df", (F.log((F.col("n_groups") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def vocabulary(groups: DataFrame, positions: DataFrame, char_names: DataFrame, quality: DataFrame, supplier: DataFrame) -> DataFrame:
    """(word, weight): names count three times a group, characteristics twice, everything else once."""
    parts = [
        groups.select(F.explode(_words(F.col("name"))).alias("word"), F.lit(3).alias("w")),
        positions.groupBy("okpd2_name").agg(F.count("*").alias("w")).select(F.explode(_words(F.col("okpd2_name"))).alias("word"), "w"),
        char_names.select(F.explode(_words(F.col("name"))).alias("word"), F.lit(2).alias("w")),
        quality.select(F.explode(_words(F.col("label"))).alias("word"), F.lit(1).alias("w")),
        supplier.select(F.explode(_words(F.col("name"))).alias("word"), F.lit(1).alias("w")),
        supplier.select("category").distinct().select(F.explode(_words(F.col("category"))).alias("word"), F.lit(1).alias("w")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("word").agg(F.sum("w").alias("weight"))


def phrases(char_names: DataFrame, supplier: DataFrame) -> DataFrame:
    """(phrase, source, n, is_flag, categories): names of characteristics in the catalogue and at suppliers.

    A supplier's phrase is a flag if all its kinds are 'Признак'; five
    categories are kept, by name.
    """
    ours = char_names.groupBy(X.normalize_phrase(F.col("name")).alias("phrase")).agg(F.sum("n").alias("n"))
    theirs = supplier.groupBy(X.normalize_phrase(F.col("name")).alias("phrase")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_and(F.col("kind") == "Признак"), F.lit(False)).alias("is_flag"),
        F.slice(F.array_sort(F.collect_set("category")), 1, 5).alias("categories"),
    )
    return ours.select("phrase", F.lit("catalogue").alias("source"), "n", F.lit(False).alias("is_flag"), F.array().cast("array<string>").alias("categories")).unionByName(theirs.withColumn("source", F.lit("supplier")))


def phrase_stems(phrase: DataFrame) -> DataFrame:
    """(phrase, source, stem, n_stems): the distinct stems of each phrase."""
    words = phrase.select("phrase", "source", F.explode(X.words_of(F.col("phrase"))).alias("word"))
    stems = words.select("word").distinct().withColumn("stem", X.word_stem(F.col("word")))
    out = words.join(stems, "word").select("phrase", "source", "stem").distinct()
    return out.withColumn("n_stems", F.count("*").over(Window.partitionBy("phrase", "source")))


def find_phrases(queries: DataFrame, stems: DataFrame, phrase: DataFrame) -> DataFrame:
    """For ``queries`` (id, stem): the best phrase holding all of an id's stems.

    Relational division: as many matches as the id has stems. Best by the
    share of the phrase that is covered, the catalogue first, then by count and name.
    """
    wanted = queries.distinct().withColumn("wanted", F.count("*").over(Window.partitionBy("id")))
    whole = wanted.join(stems, "stem").groupBy("id", "phrase", "source").agg(F.count_distinct("stem").alias("hit"), F.first("wanted").alias("wanted"), F.first("n_stems").alias("n_stems")).where("hit = wanted")
    ranked = whole.join(phrase.select("phrase", "source", "n"), ["phrase", "source"])
    order = F.struct((-F.col("wanted") / F.col("n_stems")).alias("a"), F.col("source").alias("b"), (-F.col("n")).alias("c"), F.col("phrase").alias("d"))
    return ranked.groupBy("id").agg(F.min_by(F.struct("phrase", "source"), order).alias("p")).select("id", "p.phrase", "p.source")


def best_category(queries: DataFrame, categories: DataFrame) -> DataFrame:
    """For ``queries`` (id, stem) the supplier category with most similar stems whose first stem is among them.

    ``categories`` holds (category, place, stem, root). Similar means equal, or
    one derived from the other, as unions of equi-joins on stems and roots.
    """
    q = queries.distinct().withColumn("root", X.root(F.col("stem")))
    hit = similar(q, categories, ["id"], ["category", "place"])
    size = categories.groupBy("category").agg(F.count_distinct("stem").alias("n"))
    found = hit.groupBy("id", "category").agg(F.count_distinct("place").alias("overlap"), F.min("place").alias("head")).where("head = 0").join(size, "category")
    order = F.struct((-F.col("overlap")).alias("a"), F.col("n").alias("b"), F.col("category").alias("c"))
    return found.groupBy("id").agg(F.min_by("category", order).alias("category"))


def similar(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs of similar stems with ``sim``: both sides have stem and root.

    Four equi-joins stand for the similarity: equal stems, the root of one
    equal to the other (either way), and equal roots that both were cut to.
    """
    a = left.select(*left_cols, F.col("stem").alias("stem_a"), F.col("root").alias("root_a"))
    b = right.select(*right_cols, F.col("stem").alias("stem_b"), F.col("root").alias("root_b"))
    long_enough = (F.length("stem_a") >= 3) & (F.length("stem_b") >= 3)
    both_cut = (F.col("root_a") != F.col("stem_a")) & (F.col("root_b") != F.col("stem_b")) & (F.length("root_a") >= 4)
    joins = [
        a.join(b, F.col("stem_a") == F.col("stem_b")).withColumn("sim", F.lit(X.EXACT)),
        a.join(b, F.col("root_a") == F.col("stem_b")).where(long_enough).withColumn("sim", F.lit(X.ROOT)),
        a.join(b, F.col("stem_a") == F.col("root_b")).where(long_enough).withColumn("sim", F.lit(X.ROOT)),
        a.join(b, F.col("root_a") == F.col("root_b")).where(long_enough & both_cut).withColumn("sim", F.lit(X.ROOT)),
    ]
    whole = joins[0]
    for j in joins[1:]:
        whole = whole.unionByName(j)
    keys = [*left_cols, *right_cols]
    return whole.groupBy(*keys).agg(F.max_by(F.struct("sim", "stem_a", "stem_b"), F.struct("sim", "stem_a", "stem_b")).alias("m")).select(*keys, "m.sim", "m.stem_a", "m.stem_b")


def statistics(groups: DataFrame, positions: DataFrame, phrase: DataFrame, vocab: DataFrame, supplier: DataFrame) -> DataFrame:
    """One row of counts of the index."""
    one = positions.agg(F.count("*").alias("positions"))
    for df, name in ((groups, "name_groups"), (phrase.where("source = 'catalogue'"), "catalogue_characteristics"), (supplier.select("category").distinct(), "supplier_categories"), (phrase.where("source = 'supplier'"), "supplier_characteristics"), (vocab, "vocabulary")):
        one = one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return one
