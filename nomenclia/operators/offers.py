"""What a pool of positions permits, and the validation of what texts say against it, as joins.

A pool is a set of positions that some descriptions share. Its characteristics
are merged by normalised name; positions with the same options of a
characteristic share one row of offers. Claims of texts are made distinct before
they meet the offers, so a value that many descriptions name is judged once a
pool, and each claim meets the distinct lists of its characteristic alone.

A claim is a number or an interval with its unit, a permitted label, or words
that may be one.

Cases: a characteristic without any options accepts everything; a unit of
another dimension than all of a characteristic's units is a mismatch; a number
without a unit is taken in the characteristic's; the unit of a characteristic is
that of most options, ties by key; texts equal to a label's phrase decide before
equal stems, those before likeness; null codes and names are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenclia.functions import similarity
from nomenclia.functions import text as X
from nomenclia.functions import units as U
from nomenclia.operators import ranges

# ---------------------------------------------------------------- fixed values
SURE, MARGIN, HINT, LIKE_MOST = 88, 5, 60, 5
SAME_STEMS, SAME_PHRASE = 95.0, 100.0
SUGGESTED = 8
# ----------------------------------------------------------------

OPTION = "struct<kind:string,lower:double,upper:double,number:double,label:string,norm:string,unit:string,dimension:string,factor:double,lower_inc:boolean,upper_inc:boolean>"


def by_position(options: DataFrame) -> DataFrame:
    """(pool, key, code, options, ...) of ``options`` (pool, code, char, required, kind, char_type, choice_type, option_kind, label, unit, number, lower, upper, lower_inc, upper_inc)."""
    unit, norm = F.col("__unit"), F.col("__norm")
    yes = F.lit(True)
    # Texts are parsed once for each distinct one.
    options = options.where("code is not null and char is not null")
    for column, name, of in (("char", "key", X.normalize_phrase(F.col("__text"))), ("label", "__norm", X.normalize_phrase(F.col("__text"))), ("unit", "__unit", U.unit_from_okei(F.substring_index("__text", "; ", 1)))):
        options = options.join(options.select(F.col(column).alias("__text")).distinct().withColumn(name, of), F.col(column).eqNullSafe(F.col("__text"))).drop("__text")
    option = F.struct(
        F.col("option_kind").alias("kind"), "lower", "upper", "number", "label", norm.alias("norm"), unit.alias("unit"), U.dimension(unit).alias("dimension"), U.factor(unit).alias("factor"),
        F.coalesce("lower_inc", yes).alias("lower_inc"), F.coalesce("upper_inc", yes).alias("upper_inc"),
    )
    numeric = F.coalesce(F.col("char_type") == 2, F.lit(False)) | F.coalesce(F.col("option_kind").isin("range", "concrete"), F.lit(False))
    return options.groupBy("pool", "key", "code").agg(
        F.array_sort(F.collect_set(F.when(F.col("label").isNotNull(), option))).cast(f"array<{OPTION}>").alias("options"),
        F.min(F.trim(F.regexp_replace("char", r"(?U)\s+", " "))).alias("name"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required"), F.min("kind").alias("kind"),
        F.bool_or(numeric).alias("numeric"), F.bool_or(F.coalesce(F.col("choice_type") != 2, yes)).alias("single"),
    )


def offers(positions: DataFrame) -> DataFrame:
    """(pool, key, options, codes) of ``by_position``: the positions that share a list of options."""
    return positions.groupBy("pool", "key", "options").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def characteristics(positions: DataFrame, offered: DataFrame) -> DataFrame:
    """(pool, key, name, required, kind, numeric, single, boolean, all, labels, units, codes, discrimination): a pool's characteristics."""
    of = positions.groupBy("pool", "key").agg(F.min("name").alias("name"), F.bool_or("required").alias("required"), F.min("kind").alias("kind"), (F.bool_or("numeric") & (2 * F.count_if("numeric") >= F.count("*"))).alias("numeric"), F.bool_or("single").alias("single"))
    norms = lambda options: F.array_sort(F.array_distinct(F.transform(options, lambda o: o["norm"])))
    lists = offered.groupBy("pool", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("options")))).alias("all"), F.count_distinct(norms(F.col("options"))).alias("sets"), F.array_sort(F.flatten(F.collect_list("codes"))).alias("codes"))
    units = offered.select("pool", "key", F.explode("options").alias("o"), F.size("codes").alias("n")).where("o.unit is not null").groupBy("pool", "key", "o.unit").agg(F.sum("n").alias("n"))
    units = units.groupBy("pool", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "unit"))), lambda u: u["unit"]).alias("units"))
    labels = F.filter("all", lambda o: (o["kind"] == "quality") & (o["norm"] != ""))
    norm = F.transform("labels", lambda x: x["norm"])
    boolean = (F.size("labels") > 0) & F.forall(norm, lambda x: x.isin("да", "нет"))
    met = of.join(lists, ["pool", "key"]).join(units, ["pool", "key"], "left").withColumn("labels", F.transform(labels, lambda o: F.struct(o["norm"].alias("norm"), o["label"].alias("label"))))
    weight = F.col("sets") + F.coalesce(F.col("kind") == 1, F.lit(False)).cast("int") + 0.5 * F.col("required").cast("int")
    return met.select("pool", "key", "name", "required", "kind", "numeric", "single", boolean.alias("boolean"), "all", "labels", F.coalesce("units", F.array().cast("array<string>")).alias("units"), "codes", weight.alias("discrimination"))


def suggested(options: Column) -> Column:
    return F.slice(F.array_distinct(F.transform(options, lambda o: o["label"])), 1, SUGGESTED)


RESULT = ("status", "matched", "accepted", "has", "normalized", "unit", "notes", "suggestions")


def _notes(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes))


def check_numbers(claims: DataFrame, offered: DataFrame, chars: DataFrame) -> DataFrame:
    """(claim, *RESULT) of ``claims`` (claim, pool, key, number, low, high, unit, said): a number, or an interval if it is null, and the words it was said in."""
    unit, plain = F.col("unit"), lambda t: F.replace(F.replace(F.lower(F.trim(t)), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    shown = F.when(F.col("number").isNotNull(), X.format_number(F.col("number"))).otherwise(X.interval_text(F.col("low"), F.col("high")))
    forms = F.array(plain(shown), plain(F.col("said")), plain(F.concat_ws("-", X.format_number(F.col("low")), X.format_number(F.col("high")))))
    asked = claims.withColumns({"shown": shown, "forms": forms, "dimension": U.dimension(unit), "factor": U.factor(unit)})

    def fits(o: Column) -> Column:
        to = lambda v: F.when(F.col("factor").isNull() | o["factor"].isNull(), v).otherwise(v * F.col("factor") / o["factor"])
        return F.when(F.col("number").isNotNull(), ranges.contains(o, to(F.col("number")))).otherwise(ranges.contains_interval(o, to(F.col("low")), to(F.col("high"))))

    near = F.filter("options", lambda o: (o["kind"] != "quality") & F.coalesce(o["dimension"] == F.col("dimension"), F.lit(True)))
    as_text = F.filter("options", lambda o: (o["kind"] == "quality") & F.array_contains(F.col("forms"), plain(o["norm"])))
    met = asked.join(offered, ["pool", "key"]).withColumn("near", near).withColumn("good", F.filter("near", fits))
    met = met.withColumn("good", F.when(F.size("good") > 0, F.col("good")).otherwise(as_text))
    accepts = (F.size("good") > 0) | (F.size("options") == 0)
    judged = met.groupBy("claim").agg(
        F.array_sort(F.flatten(F.collect_list(F.when(accepts, F.col("codes"))))).alias("accepted"),
        F.array_sort(F.flatten(F.collect_list("codes"))).alias("has"),
        F.min(F.array_min(F.transform("good", ranges.specificity)))["d"].alias("matched"),
        F.bool_or((F.size("near") > 0) | (F.size("good") > 0)).alias("unit_fits"),
        F.bool_or(F.size("options") > 0).alias("limited"),
    )
    whole = asked.join(judged, "claim").join(chars.select("pool", "key", "units", F.col("all")), ["pool", "key"])
    symbol = lambda u: U.symbol(u)
    target = F.get("units", F.lit(0))
    foreign = unit.isNotNull() & (F.size("units") > 0) & ~F.exists("units", lambda u: U.dimension(u) == F.col("dimension"))
    other = unit.isNotNull() & target.isNotNull() & (unit != target) & (U.dimension(target) == F.col("dimension"))
    to = lambda v: v * F.col("factor") / U.factor(target)
    turned = F.when(F.col("number").isNotNull(), X.format_number(to(F.col("number")))).otherwise(X.interval_text(to(F.col("low")), to(F.col("high"))))
    lost = (F.size("accepted") == 0) & F.col("limited")
    status = F.when(foreign, "unit_mismatch").when(~F.col("limited"), "no_constraints").when(~lost, "ok").when(unit.isNotNull() & ~F.col("unit_fits"), "unit_mismatch").otherwise("invalid")
    expected = F.array_join(F.array_sort(F.array_distinct(F.transform("units", symbol))), ", ")
    notes = F.when(foreign, F.array(F.concat(F.lit("unit "), symbol(unit), F.lit(" does not fit; expected "), expected))).otherwise(
        _notes(
            F.when(target.isNotNull() & unit.isNull(), F.concat(F.lit("unit not given, "), symbol(target), F.lit(" assumed"))),
            F.when(other & F.col("number").isNotNull(), F.concat(F.lit("converted: "), "said", F.lit(" = "), turned, F.lit(" "), symbol(target))),
            F.when(lost, "outside every permitted range or value"),
        )
    )
    none = F.array().cast("array<string>")
    return whole.select(
        "claim",
        status.alias("status"),
        F.when(~foreign & F.col("limited") & ~lost, F.col("matched")).alias("matched"),
        F.when(foreign, none).otherwise(F.col("accepted")).alias("accepted"),
        "has",
        F.when(other & ~foreign, turned).otherwise(F.col("shown")).alias("normalized"),
        F.coalesce(F.when(~foreign, symbol(target)), symbol(unit), F.lit("")).alias("unit"),
        notes.alias("notes"),
        F.when(foreign | lost, suggested(F.col("all"))).otherwise(none).alias("suggestions"),
    )


def check_labels(claims: DataFrame, offered: DataFrame, chars: DataFrame) -> DataFrame:
    """(claim, *RESULT) of ``claims`` (claim, pool, key, label): positions that permit the label."""
    norm = X.normalize_phrase(F.col("label"))
    accepts = (F.size("options") == 0) | F.exists("options", lambda o: (o["kind"] == "quality") & (o["norm"] == F.col("norm")))
    judged = claims.withColumn("norm", norm).join(offered, ["pool", "key"]).groupBy("claim", "pool", "key", "label").agg(
        F.array_sort(F.flatten(F.collect_list(F.when(accepts, F.col("codes"))))).alias("accepted"), F.array_sort(F.flatten(F.collect_list("codes"))).alias("has"), F.bool_or(F.size("options") > 0).alias("limited")
    )
    lost, none = (F.size("accepted") == 0) & F.col("limited"), F.array().cast("array<string>")
    return judged.join(chars.select("pool", "key", "all"), ["pool", "key"]).select(
        "claim",
        F.when(~F.col("limited"), "no_constraints").when(lost, "invalid").otherwise("ok").alias("status"),
        F.when(F.col("limited") & ~lost, F.col("label")).alias("matched"),
        "accepted",
        "has",
        F.col("label").alias("normalized"),
        F.lit("").alias("unit"),
        _notes(F.when(lost, "not among the permitted values")).alias("notes"),
        F.when(lost, suggested(F.col("all"))).otherwise(none).alias("suggestions"),
    )


def _stems(phrase: Column) -> Column:
    """Distinct stems of a phrase's words and numbers, without stop words."""
    found = F.filter(X.tokens_of(phrase), lambda t: t["kind"].isin("word", "number"))
    stems = F.transform(found, lambda t: F.when(t["kind"] == "word", X.word_stem(X.expanded(t["norm"]))).otherwise(t["norm"]))
    return F.array_distinct(F.filter(stems, lambda s: ~s.isin(*sorted(X.STOPWORDS))))


def nearest_labels(claims: DataFrame, chars: DataFrame) -> DataFrame:
    """(claim, label, hints) of ``claims`` (claim, pool, key, text): the label that the words stand for, or null, and labels like them.

    The same phrase, the same stems, or the likest label if it is sure and no other is near it.
    """
    asked = claims.withColumn("norm", X.normalize_phrase(F.col("text"))).where("norm <> ''").withColumn("stems", _stems(F.col("norm")))
    labels = chars.select("pool", "key", F.explode("labels").alias("l")).select("pool", "key", F.col("l.norm").alias("theirs"), F.col("l.label").alias("label"))
    each = labels.join(labels.select("theirs").distinct().withColumn("their_stems", _stems(F.col("theirs"))), "theirs")
    met = asked.join(each, ["pool", "key"]).withColumn("like", similarity.wratio_column(F.col("norm"), F.col("theirs")))
    same = (F.size("stems") == F.size("their_stems")) & (F.size("stems") > 0) & F.forall("their_stems", lambda t: F.exists("stems", lambda s: X.stem_similarity(s, t) > 0))
    score = F.when(F.col("norm") == F.col("theirs"), SAME_PHRASE).when(same, SAME_STEMS)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("like")).alias("like"), "label")))
    found = met.groupBy("claim").agg(F.slice(ranked, 1, LIKE_MOST).alias("best"), F.min(F.when(score.isNotNull(), F.struct((-score).alias("s"), "theirs", "label")))["label"].alias("exact"))
    top, second = -F.col("best")[0]["like"], -F.get("best", F.lit(1))["like"]
    sure = (top >= SURE) & (second.isNull() | (top - second >= MARGIN))
    hints = F.transform(F.filter("best", lambda b: -b["like"] >= HINT), lambda b: b["label"])
    return found.select("claim", F.coalesce("exact", F.when(sure, F.col("best")[0]["label"])).alias("label"), hints.alias("hints"))


def nearest_names(asked: DataFrame, chars: DataFrame, cutoff: float) -> DataFrame:
    """(name, pool, key) of ``asked`` (pool, name): the characteristic of that name, or the likest of ``cutoff`` or more."""
    distinct = asked.distinct().withColumn("norm", X.normalize_phrase(F.col("name")))
    met = distinct.join(chars.select("pool", "key"), "pool").withColumn("like", F.when(F.col("norm") == F.col("key"), 1000.0).otherwise(similarity.wratio_column(F.col("norm"), F.col("key")))).where(F.col("like") >= cutoff)
    place = F.row_number().over(Window.partitionBy("pool", "name").orderBy(F.desc("like"), "key"))
    return met.withColumn("place", place).where("place = 1").select("pool", "name", "key")
