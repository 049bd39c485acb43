"""Narrowing of candidate sets by facts, next questions, refinements, confidence and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGE = "struct<kind:string,title:string,before:bigint,after:bigint,applied:boolean,note:string>"
ABSENT = "no remaining position has it"
CONFLICT = "contradicts other characteristics"


def stage(kind: str, title: Column, before: Column, after: Column, applied: Column, note: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), title.cast("string").alias("title"), before.cast("bigint").alias("before"), after.cast("bigint").alias("after"), applied.alias("applied"), note.cast("string").alias("note"))


def narrow_facts(candidates: Column, facts: Column) -> Column:
    """Fold of facts (title, has, accepted) over the candidate codes: ``remaining`` and ``stages``.

    A fact that no remaining position has, or that none accepts, is noted and
    not applied; any other keeps the positions that accept it.
    """
    start = F.struct(candidates.alias("remaining"), F.array().cast(f"array<{STAGE}>").alias("stages"))

    def step(s: Column, f: Column) -> Column:
        has, ok = F.arrays_overlap(s["remaining"], f["has"]), F.array_intersect(s["remaining"], f["accepted"])
        applied = has & (F.size(ok) > 0)
        kept = F.when(applied, ok).otherwise(s["remaining"])
        note = F.when(~has, ABSENT).when(F.size(ok) == 0, CONFLICT)
        return F.struct(kept.alias("remaining"), F.concat(s["stages"], F.array(stage("characteristic", f["title"], F.size(s["remaining"]), F.size(kept), applied, note))).alias("stages"))

    return F.aggregate(facts, start, step)


def narrow_counts(positions: DataFrame, described: DataFrame, pool: str, facts: list[str]) -> DataFrame:
    """``described`` (id, pool, facts) with ``n0``, ``n1``, ...: how many of the pool's positions are left before and after each fact in turn.

    ``narrow_facts`` where a position has one value of each fact and only the
    numbers are asked for: descriptions of one pool with the same values are one,
    positions are counted by the values of each set of facts, and a set is looked
    up. A fact that none of what is left accepts (a null among them) is not applied.
    """
    of = [pool, *facts]
    counted = positions.where(F.col(pool).isNotNull()).groupBy(*of).agg(F.count("*").alias("n"))
    used = lambda mask, k: mask.bitwiseAND(1 << k) != 0
    key = lambda mask, k, c: F.when(used(mask, k), F.col(c))
    by_set = counted.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(facts)) - 1)))).where(" and ".join([f"(mask & {1 << k} = 0 or `{c}` is not null)" for k, c in enumerate(facts)]))
    by_set = by_set.groupBy(pool, "mask", *[key(F.col("mask"), k, c).alias(f"k{k}") for k, c in enumerate(facts)]).agg(F.sum("n").alias("found"))
    by_set = by_set.withColumnRenamed(pool, "of").withColumnRenamed("mask", "set")
    asked = described.select(*of).distinct().join(by_set.where("set = 0").select(F.col("of").alias(pool), F.col("found").alias("n0")), pool).withColumn("mask", F.lit(0))
    for k in range(len(facts)):
        wanted = F.col("mask").bitwiseOR(1 << k)
        same = (F.col(pool) == F.col("of")) & (wanted == F.col("set"))
        for j, c in enumerate(facts):
            same = same & key(wanted, j, c).eqNullSafe(F.col(f"k{j}"))
        asked = asked.join(by_set, same, "left").select(*of, *[f"n{j}" for j in range(k + 1)], F.coalesce("found", f"n{k}").alias(f"n{k + 1}"), F.when(F.col("found").isNotNull(), wanted).otherwise(F.col("mask")).alias("mask"))
    asked = asked.drop("mask").withColumnsRenamed({c: f"__{c}" for c in of})
    same = F.col(pool) == F.col(f"__{pool}")
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return described.join(asked, same).drop(*[f"__{c}" for c in of])


def around(stages: Column, total: Column, names: Column, found: Column, spoken: Column, spoken_names: Column, chosen: Column, code: Column, left: Column) -> Column:
    """The stages of facts with those before (catalogue of ``total`` positions, names with ``found``) and after them.

    ``spoken``: how many the free words' groups leave, ``chosen`` the user's
    code, ``left`` the number that remains at the end.
    """
    yes, none = F.lit(True), F.lit(None)
    facts_left = F.coalesce(F.try_element_at(stages, F.lit(-1))["after"], found.cast("bigint"))
    first = F.array(stage("catalog", F.lit("catalogue"), none, total, yes, none), stage("name", F.array_join(F.slice(names, 1, 4), "; "), total, found, yes, none))
    group = F.when(spoken < facts_left, F.array(stage("okpd2", F.array_join(F.slice(spoken_names, 1, 2), "; "), facts_left, spoken, yes, none)))
    user = F.when(chosen.isNotNull(), F.array(stage("user", chosen, spoken, F.lit(1), yes, none)))
    final = F.when(code.isNotNull() & (left > 1), F.array(stage("final", code, left, F.lit(1), yes, F.lit("no template"))))
    empty = F.array().cast(f"array<{STAGE}>")
    return F.concat(first, stages, *[F.coalesce(x, empty) for x in (group, user, final)])


def prefer_group(remaining: DataFrame) -> DataFrame:
    """Of (id, code, overlap) the rows with the most overlap, if it is above zero."""
    return remaining.withColumn("most", F.max("overlap").over(Window.partitionBy("id"))).where("most = 0 or overlap = most").drop("most")


def final_code(remaining: Column, templates: Column, chosen: Column | None = None) -> Column:
    """The chosen code if there is one, the only one left, or the only one left that is no template."""
    concrete = F.array_except(remaining, templates)
    out = F.when(F.size(remaining) == 1, remaining[0]).when(F.size(concrete) == 1, concrete[0])
    return out if chosen is None else F.coalesce(chosen, out)


def pool(remaining: DataFrame) -> DataFrame:
    """Of (id, code, is_template): positions that are no templates if two or more are, else all; with ``pool_size`` of two or more."""
    w = Window.partitionBy("id")
    kept = remaining.withColumn("concrete", F.sum((~F.col("is_template")).cast("int")).over(w)).where("concrete < 2 or not is_template")
    return kept.withColumn("pool_size", F.count("*").over(w)).where("pool_size >= 2").select("id", "code", "pool_size")


def discriminating(pools: DataFrame, values: DataFrame) -> DataFrame:
    """(id, char, kinds, present, pool_size): distinct sets of labels of each characteristic over the pool, the lack of it one of them.

    ``values`` holds (code, char, label). Two sets or more are needed.
    """
    signatures = pools.join(values, "code").groupBy("id", "char", "code", "pool_size").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    counted = signatures.groupBy("id", "char").agg(F.count_distinct("labels").alias("sets"), F.count("*").alias("present"), F.first("pool_size").alias("pool_size"))
    return counted.withColumn("kinds", F.col("sets") + (F.col("present") < F.col("pool_size")).cast("int")).where("kinds >= 2").drop("sets")


def option_counts(pools: DataFrame, values: DataFrame, most: int | None = 15) -> DataFrame:
    """(id, char, label, n, place): the options of each characteristic by frequency, ``most`` of them, all without it."""
    counted = pools.join(values, "code").groupBy("id", "char", "label").agg(F.count_distinct("code").alias("n"))
    w = Window.partitionBy("id", "char").orderBy(F.desc("n"), "label")
    return _first(counted.withColumn("place", F.row_number().over(w)), most)


def _first(placed: DataFrame, most: int | None) -> DataFrame:
    return placed if most is None else placed.where(F.col("place") <= most)


def suggest(pools: DataFrame, values: DataFrame, characteristics: DataFrame, used: DataFrame, most: int | None = 5, most_options: int | None = 15) -> DataFrame:
    """Next questions: (id, place, char, score, options), ``most`` of them with ``most_options`` each, all without these.

    ``characteristics`` holds (char, kind, required), ``used`` (id, char).
    """
    known = discriminating(pools, values).join(characteristics, "char").join(used, ["id", "char"], "left_anti")
    score = F.col("kinds") + F.when(F.col("kind") == 1, 2.0).otherwise(0.0) + F.col("required").cast("double") + F.col("present") / F.col("pool_size")
    options = option_counts(pools, values, most_options)
    listed = options.groupBy("id", "char").agg(F.array_sort(F.collect_list(F.struct("place", "label", "n"))).alias("options"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "char")
    scored = known.withColumn("score", score).join(listed, ["id", "char"])
    everywhere = F.forall("options", lambda o: o["n"] == F.col("pool_size")) & (F.col("present") == F.col("pool_size"))
    return _first(scored.where(~everywhere).withColumn("place", F.row_number().over(w)), most).select("id", "place", "char", "score", "options")


def refinements(remaining: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """Counts of the remaining positions by ``keys``, the ``most`` frequent, all without it; none where there is one value only."""
    counted = remaining.groupBy("id", *keys).agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    ranked = counted.withColumn("values", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), *keys)))
    return _first(ranked.where(F.col("values") > 1), most).drop("values")


LEVELS = ("none", "low", "medium", "high")


def final_confidence(levels: Column, code: Column) -> Column:
    """The least level over the surviving groups if a code was reached, else the greatest."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    places = F.transform(levels, lambda x: F.array_position(names, x).cast("int"))
    return F.element_at(names, F.coalesce(F.when(code.isNotNull(), F.array_min(places)).otherwise(F.array_max(places)), F.lit(1)))


def status(found: Column, code: Column, confidence: Column) -> Column:
    return F.when(~found, "name_not_found").when(code.isNotNull() & (confidence != "low"), "resolved").when(code.isNotNull(), "low_confidence").otherwise("need_more_info")


def validity_note(start: Column, end: Column, now: Column) -> Column:
    """A note if a position is not yet, or no longer, in force at ``now``."""
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    return F.when(start > now, F.concat(F.lit("in force from "), day(start))).when(end < now, F.concat(F.lit("expired on "), day(end)))
