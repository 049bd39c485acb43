"""What a caller sees of an analysis: specification rows, candidates, counts, messages, and the choice between two texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenclia.functions import text as X
from nomenclia.operators import kernel
from nomenclia.operators.narrow import CONFLICT, validity_note

CANDIDATES, OPTIONS = 20, 60
# The better of two analyses is the one further up.
STATUS_RANK = ("name_not_found", "low_confidence", "need_more_info", "resolved")
NOT_RECOGNIZED = ("unrecognized", "no_value", "missing")
ERRORS = ("invalid", "unit_mismatch")
NONE_REMAIN = 10**6



def usable_facts(facts: Column) -> Column:
    return F.filter(facts, lambda f: f["status"].isin(*kernel.USABLE) & f["key"].isNotNull())


def characteristic_schema(options: DataFrame) -> DataFrame:
    """(char, name, required, kind, numeric, boolean, labels, unit): characteristics over the given positions.

    Numeric if at least half of the positions say so; boolean if only yes and
    no are permitted; labels are distinct, first 60 by text.
    """
    norm = X.normalize_phrase(F.col("char"))
    numeric = (F.col("char_type") == 2) | F.col("option_kind").isin("range", "concrete")
    by_position = options.groupBy(norm.alias("key"), "code").agg(F.min("char").alias("name"), F.bool_or(F.coalesce(numeric, F.lit(False))).alias("numeric"), F.bool_or("required").alias("required"), F.min("kind").alias("kind"), F.collect_set("label").alias("labels"), F.min("unit").alias("unit"))
    whole = by_position.groupBy("key").agg(F.min("name").alias("name"), F.bool_or("required").alias("required"), F.min("kind").alias("kind"), (2 * F.count_if("numeric") >= F.count("*")).alias("majority"), F.bool_or("numeric").alias("any_numeric"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("all"), F.min("unit").alias("unit"))
    lower = F.transform("all", lambda x: F.lower(x))
    boolean = (F.size("all") > 0) & (F.size(F.array_except(lower, F.array(F.lit("да"), F.lit("нет")))) == 0)
    return whole.select("key", "name", "required", "kind", (F.col("majority") & F.col("any_numeric")).alias("numeric"), boolean.alias("boolean"), F.slice("all", 1, OPTIONS).alias("labels"), "unit")


def char_type(kind: Column) -> Column:
    return F.when(kind == 1, "quality").when(kind == 2, "quantity").otherwise("unknown")


def specification(results: DataFrame, options: DataFrame) -> DataFrame:
    """(id, key, name, required, type, value, unit, status): facts, and required characteristics of the remaining positions that nobody gave."""
    facts = results.select("id", F.explode("facts").alias("f")).select("id", F.col("f.key").alias("key"), F.col("f.title").alias("name"), F.coalesce("f.matched", "f.normalized").alias("value"), "f.unit", "f.status", "f.source", "f.ord")
    needed = results.select("id", F.explode("remaining").alias("code")).join(options.select("code", "char", "required", "kind"), "code").groupBy("id", X.normalize_phrase(F.col("char")).alias("key")).agg(F.min("char").alias("full_name"), F.bool_or("required").alias("required"), F.min("kind").alias("kind"))
    joined = facts.join(needed, ["id", "key"], "full")
    kept = joined.where(F.col("status").isNotNull() | F.col("required"))
    return kept.select("id", "key", F.coalesce("name", "full_name").alias("name"), F.coalesce("required", F.lit(False)).alias("required"), char_type(F.col("kind")).alias("type"), "value", "unit", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce("ord", F.lit(1 << 20)).alias("place")).orderBy("id", F.desc("required"), "place", "key")


def candidates(results: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, place, code, name, matched): remaining positions, templates last, by matched facts; 20 at most."""
    used = results.select("id", F.explode("remaining").alias("code"), usable_facts(F.col("facts")).alias("facts"))
    named = used.withColumn("matched", F.size(F.filter("facts", lambda f: F.array_contains(f["accepted"], F.col("code"))))).join(positions.select("code", "name", "is_template"), "code")
    w = Window.partitionBy("id").orderBy("is_template", F.desc("matched"), "code")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= CANDIDATES).select("id", "place", "code", "name", "matched")


def quality(results: DataFrame) -> DataFrame:
    """(id and counts): facts by outcome."""
    count = lambda *s: F.size(F.filter("facts", lambda f: f["status"].isin(*s))).alias(s[0])
    return results.select("id", F.size("facts").alias("facts"), *[count(s) for s in ("ok", "no_constraints", "invalid", "unit_mismatch", "ambiguous", "no_value", "supplier_only", "other_catalogue", "unrecognized")])


def rows(results: DataFrame, options: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Rows of a specification in the order they are shown: what the text says by place, then what the user gave, then what is missing.

    (id, place, key, name, source, value, unit, status, required, type, in_specification,
    matched_range, options). Required is what the final position requires, or else
    any position that has the characteristic. A usable fact is in the
    specification unless the final position does not accept it. Missing are the
    characteristics of the final position, or those that all remaining positions
    (templates aside, if others remain; ``templates`` has their codes) require.
    """
    final = F.when(F.col("status").isin("resolved", "low_confidence"), F.col("code"))
    base = results.where("facts is not null").withColumn("final", final)
    own = options.where("code is not null").groupBy("code", X.normalize_phrase(F.col("char")).alias("key")).agg(
        F.min("char").alias("full_name"), F.bool_or(F.coalesce("required", F.lit(False))).alias("required"), F.min("kind").alias("kind"), F.array_sort(F.collect_set("label")).alias("labels")
    )
    facts = base.select("id", "final", F.explode("facts").alias("f")).select("id", "final", "f.*")
    # What the positions in question say of a fact's characteristic.
    scope = facts.where("key is not null").select("id", "ord", "key", F.explode(F.when(F.col("final").isNotNull(), F.array("final")).otherwise(F.col("has"))).alias("code"))
    about = scope.join(own, ["code", "key"]).groupBy("id", "ord").agg(F.bool_or("required").alias("required"), F.min("kind").alias("kind"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    usable = F.col("status").isin(*kernel.USABLE) & F.col("key").isNotNull()
    said = facts.join(about, ["id", "ord"], "left").select(
        "id", F.when(F.col("source") == "user", 1).otherwise(0).alias("part"), F.coalesce("start", F.lit(10**9)).alias("at"), "ord", "key", F.col("title").alias("name"), "source", F.col("normalized").alias("value"), "unit", "status",
        F.coalesce("required", F.lit(False)).alias("required"), char_type(F.col("kind")).alias("type"), (usable & (F.col("final").isNull() | ~F.array_contains("has", F.col("final")) | F.array_contains("accepted", F.col("final")))).alias("in_specification"),
        F.when(F.col("value_kind").isin("number", "interval"), F.col("matched")).alias("matched_range"), F.slice(F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))), 1, OPTIONS).alias("options"),
    )
    left = base.select("id", "final", F.explode(F.when(F.col("final").isNotNull(), F.array("final")).otherwise(F.col("remaining"))).alias("code"))
    if templates is not None:
        marked = left.join(templates.select("code", F.lit(True).alias("template")), "code", "left").withColumn("template", F.coalesce("template", F.lit(False)))
        left = marked.withColumn("others", F.max((~F.col("template")).cast("int")).over(Window.partitionBy("id"))).where("not template or others = 0").drop("template", "others")
    size = left.groupBy("id").agg(F.count("*").alias("n"))
    needed = left.join(own, "code").groupBy("id", "final", "key").agg(F.count("*").alias("have"), F.count_if("required").alias("require"), F.min("full_name").alias("name"), F.min("kind").alias("kind"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))
    open_ = needed.join(size, "id").where("final is not null or require = n").join(facts.where("key is not null").select("id", "key").distinct(), ["id", "key"], "left_anti")
    none = F.lit(None).cast("string")
    missing = open_.select(
        "id", F.lit(2).alias("part"), F.lit(0).alias("at"), F.lit(0).alias("ord"), "key", "name", F.lit("reference").alias("source"), none.alias("value"), F.lit("").alias("unit"), F.lit("missing").alias("status"),
        (F.col("require") > 0).alias("required"), char_type(F.col("kind")).alias("type"), F.lit(False).alias("in_specification"), none.alias("matched_range"), F.slice("labels", 1, OPTIONS).alias("options"),
    )
    place = F.row_number().over(Window.partitionBy("id").orderBy("part", "at", "ord", "key"))
    return said.unionByName(missing).withColumn("place", place).drop("part", "at", "ord")


def counts(results: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, recognized, errors, ambiguous, unrecognized, required_total, required_filled) of ``results`` and their ``rows``."""
    of = lambda *s: F.size(F.filter("facts", lambda f: f["status"].isin(*s)))
    facts = results.where("facts is not null").select("id", F.size(usable_facts(F.col("facts"))).alias("recognized"), of(*ERRORS).alias("errors"), of("ambiguous").alias("ambiguous"), of("unrecognized").alias("unrecognized"))
    needed = shown.groupBy("id").agg(F.count_if("required").alias("required_total"), F.count_if(F.col("required") & F.col("in_specification")).alias("required_filled"))
    zero = F.lit(0).cast("long")
    return facts.join(needed, "id", "left").select("id", "recognized", "errors", "ambiguous", "unrecognized", F.coalesce("required_total", zero).alias("required_total"), F.coalesce("required_filled", zero).alias("required_filled"))


#: Level and kind of a message by the fact's status.
FACT_MESSAGES = {"unrecognized": ("warning", "unrecognized_characteristic"), "invalid": ("error", "invalid_value"), "unit_mismatch": ("error", "invalid_value"), "ambiguous": ("warning", "ambiguous_value"), "no_value": ("info", "no_value")}


def messages(results: DataFrame, typos: DataFrame | None = None, positions: DataFrame | None = None, now: Column | None = None, most: int | None = None) -> DataFrame:
    """(id, level, kind, text): what to tell a user about each analysis.

    One message of the outcome (what to add, if it is open), one for each fact
    that is not as it should be, and one each for misspelt words (``typos``: id,
    word, suggestion), a final position that is not in force (``positions``:
    code, start, end), descriptions with ``most`` positions or more if the
    analyses looked at no more, and
    a name that was found in part.
    """
    names = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    asked = F.transform("suggestions", lambda s: s["name"])
    by_name = F.exists("refinements", lambda r: r["code"].isNull())
    kinds = F.transform("refinements", lambda r: r["name"])
    several = F.concat(F.lit("several names fit ("), F.size("refinements").cast("string"), F.lit("): "), names(kinds, 4), F.when(F.size("suggestions") > 0, F.concat(F.lit("; or tell "), names(asked, 3))).otherwise(""))
    more = F.when(by_name & (F.size("refinements") > 0), several).when(F.size("suggestions") > 0, F.concat(F.lit("not enough is known; tell "), names(asked, 4))).when(F.size("refinements") > 0, F.concat(F.lit("positions differ by group alone: "), names(kinds, 3))).otherwise("the positions that remain do not differ by characteristics; choose one")
    state = F.col("status")
    text = F.when(state == "resolved", F.concat(F.lit("one position fits: "), "code")).when(state == "name_not_found", "no such product name").when(state == "low_confidence", "the name is matched in part; check it").otherwise(more)
    level = F.when(state == "resolved", "success").otherwise("warning")
    out = results.select("id", level.alias("level"), state.alias("kind"), text.alias("text"))
    told = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(lv).alias("level"), F.lit(k).alias("kind")) for s, (lv, k) in FACT_MESSAGES.items()])
    each = results.select("id", F.explode("facts").alias("f")).withColumn("m", F.get(F.filter(told, lambda m: m["status"] == F.col("f.status")), F.lit(0))).where("m is not null")
    value = F.trim(F.concat_ws(" ", "f.normalized", "f.unit"))
    allowed = F.when(F.size("f.suggestions") > 0, F.concat(F.lit("; permitted: "), F.array_join(F.slice("f.suggestions", 1, 5), "; "))).otherwise("")
    said = F.when(F.col("m.kind") == "invalid_value", F.concat("f.title", F.lit(": "), value, F.lit(" is not permitted"), allowed)).when(F.col("m.kind") == "no_value", F.concat("f.title", F.lit(": no value is given"))).otherwise(F.concat_ws(": ", "f.title", "f.normalized", F.array_join("f.notes", "; ")))
    out = out.unionByName(each.select("id", "m.level", "m.kind", said.alias("text")))
    # A fact that is right by itself, but against the others.
    conflicts = results.select("id", F.explode("stages").alias("s")).where(F.col("s.note") == CONFLICT)
    out = out.unionByName(conflicts.select("id", F.lit("warning").alias("level"), F.lit("conflict").alias("kind"), F.concat_ws(": ", "s.title", "s.note").alias("text")))
    info = F.lit("info").alias("level")
    if typos is not None:
        words = typos.groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws(" → ", "word", "suggestion"))).alias("w"))
        out = out.unionByName(words.select("id", info, F.lit("typos").alias("kind"), F.concat(F.lit("words that may be misspelt: "), names(F.col("w"), 5)).alias("text")))
    if positions is not None:
        note = validity_note(F.col("start"), F.col("end"), F.current_timestamp() if now is None else now)
        dated = results.where("code is not null").select("id", "code").join(positions.select("code", "start", "end"), "code").withColumn("text", note).where("text is not null")
        out = out.unionByName(dated.select("id", info, F.lit("validity").alias("kind"), "text"))
    if most is not None:
        found = F.get(F.filter("stages", lambda s: s["kind"] == "name"), F.lit(0))["after"]
        out = out.unionByName(results.where(found >= most).select("id", info, F.lit("truncated").alias("kind"), F.lit(f"{most} positions have this name, and no more were looked at").alias("text")))
    return out.unionByName(results.where("confidence = 'low' and status not in ('low_confidence', 'name_not_found')").select("id", F.lit("warning").alias("level"), F.lit("name_low_confidence").alias("kind"), F.lit("the product's name was found in part only").alias("text")))


def choose(results: DataFrame) -> DataFrame:
    """Of the analyses of an id from ``text`` and ``rewriter`` (column source) the better one; the text's own wins a tie.

    By status, confirmed facts less errors, fewer remaining positions, fewer
    unrecognised facts, more recognised ones. A fact that contradicts others is
    an error and not confirmed.
    """
    facts = F.coalesce("facts", F.array().cast(results.schema["facts"].dataType))
    of = lambda test: F.size(F.filter(facts, test))
    conflicts = F.size(F.filter(F.coalesce("stages", F.array().cast(results.schema["stages"].dataType)), lambda s: s["note"] == CONFLICT))
    confirmed = of(lambda f: f["status"].isin(*kernel.USABLE)) - conflicts
    errors = of(lambda f: f["status"].isin(*ERRORS)) + conflicts
    remaining = F.when(F.col("status") == "name_not_found", NONE_REMAIN).otherwise(F.size("remaining"))
    unrecognized, recognized = of(lambda f: f["status"] == "unrecognized"), of(lambda f: ~f["status"].isin(*NOT_RECOGNIZED))
    ranks = F.array(*[F.lit(s) for s in STATUS_RANK])
    parts = (F.array_position(ranks, F.col("status")), confirmed - errors, -remaining, -unrecognized, recognized, F.col("source") == "text")
    best = results.groupBy("id").agg(F.max_by("source", F.struct(*[x.alias(f"k{n}") for n, x in enumerate(parts)])).alias("source"))
    return results.join(best, ["id", "source"])


def get_position(positions: DataFrame, options: DataFrame, codes: list[str]) -> DataFrame:
    """Whole positions in the order asked for: (ord, code, name, characteristics array of (name, options))."""
    values = options.groupBy("code", "char").agg(F.array_sort(F.collect_list(F.struct("label", "unit"))).alias("options"))
    chars = values.groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("char").alias("name"), "options"))).alias("characteristics"))
    asked = F.array(*[F.lit(c) for c in codes])
    return positions.where(F.col("code").isin(*codes)).join(chars, "code", "left").withColumn("ord", F.array_position(asked, F.col("code"))).select("ord", "code", "name", "characteristics").orderBy("ord")
