"""Spans of a text by priority: disjoint pieces, each with the span that shows there.

A span covers the characters from its start to before its end. Where spans
overlap, the one of highest priority shows, of equals the first in order. A text
is cut into words of 63 characters; a span is a mask of bits in its first word
and one in its last. In a word the spans go by priority, and each shows the bits
that none before it has: one window over (text, word), so that what is sorted and
shuffled is the spans once or twice, never their characters or pieces.

The whole words between the first and the last of a long span are cut into dyadic
blocks, two a level at most; a word lies in one block of each level, so which long
spans cover a stretch of words is an equi-join on blocks. What shows there joins
the words that have masks, and stands as it is in the others. Whether there are
any such spans is asked first, of the lengths alone.

Pieces that meet at the edge of a word and show one span are joined.

Cases: spans that begin before the text are cut, those that are empty or have an
end missing are dropped; texts of one id are one text;
ends may lie beyond the text, as the text is not looked at; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Kinds of spans, the most important last.
PRIORITY = ("name", "characteristic", "unrecognized", "typo")
# ----------------------------------------------------------------

LEVELS = 31
#: Characters of a word, as many as a long has bits beside its sign; all of them.
WORD, ALL = 63, 2**63 - 1
#: What tells which span shows, the first in this order.
SHOWN = ("rank", "span", "kind")


def _blocks(start: Column, end: Column) -> Column:
    """The (level, block) that together cover start to end: at each level the first if it is odd, and the one before the end if that is odd."""

    def at(level: Column) -> Column:
        low, high = F.ceil(start / F.pow(F.lit(2.0), level)).cast("long"), F.floor(end / F.pow(F.lit(2.0), level)).cast("long")
        first = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("block")))
        last = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("block")))
        return F.array_compact(F.array(first, last))

    # A block is no longer than the span, so no level above the span's length has any.
    highest = F.least(F.floor(F.log2((end - start).cast("double"))).cast("int"), F.lit(LEVELS - 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), highest), at))


def _masks(sound: DataFrame) -> DataFrame:
    """(id, word, mask, SHOWN): the bits of the first and of the last word of each span."""
    last = F.floor((F.col("end") - 1) / WORD)
    word = F.explode(F.array_distinct(F.array(F.floor(F.col("start") / WORD), last))).alias("word")
    low = F.greatest(F.col("start") - F.col("word") * WORD, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("word") * WORD, F.lit(WORD)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - (high - low))
    return sound.select("id", "start", "end", word, *SHOWN).select("id", "word", F.call_function("shiftleft", ones, low).alias("mask"), *SHOWN)


def _stretches(sound: DataFrame) -> DataFrame:
    """(id, start, end, show): what shows of spans, where neighbours may show the same one."""
    show = F.struct(*SHOWN)
    held = sound.select("id", F.explode(_blocks(F.col("start"), F.col("end"))).alias("b"), show.alias("show")).groupBy("id", "b.level", "b.block").agg(F.min("show").alias("show"))
    ends = sound.select("id", F.explode(F.array("start", "end")).alias("start")).distinct()
    between = ends.withColumn("end", F.lead("start").over(Window.partitionBy("id").orderBy("start"))).where("end is not null")
    # A stretch lies within one block of each level that has any of it, so its first place tells; only levels that the text's spans have are asked.
    levels = held.groupBy(F.col("id").alias("of")).agg(F.collect_set("level").alias("levels"))
    asked = between.join(levels, F.col("id").eqNullSafe(F.col("of"))).select("id", "start", "end", F.explode("levels").alias("at"))
    asked = asked.withColumn("in", F.floor(F.col("start") / F.pow(F.lit(2.0), F.col("at"))).cast("long"))
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("level")) & (F.col("in") == F.col("block"))
    return asked.join(held.withColumnRenamed("id", "of"), same).groupBy("id", "start", "end").agg(F.min("show").alias("show"))


def _beside(long: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``long`` (id, start, end, show; in words) as masks of the words that have some, and as pieces (id, start, end, SHOWN; in words) of the others."""
    none = F.lit(None)
    words = masks.select("id", F.col("word").alias("start")).distinct().select("id", "start", none.cast("long").alias("end"), none.cast(long.schema["show"].dataType).alias("show"))
    by = Window.partitionBy("id").orderBy("start", F.col("end").isNull())
    met = long.unionByName(words).withColumns({"next": F.lead("start").over(by), "held": F.last(F.when(F.col("end").isNotNull(), F.struct("end", "show")), ignorenulls=True).over(by)})
    is_word = F.col("end").isNull()
    over = met.where(is_word & (F.col("held.end") > F.col("start"))).select("id", F.col("start").alias("word"), F.lit(ALL).alias("mask"), "held.show.*")
    free = met.where("held is not null").select("id", (F.col("start") + is_word.cast("int")).alias("start"), F.least("next", "held.end").alias("end"), "held.show.*")
    return over, free.where("start < end")


def _runs(bits: Column) -> Column:
    """The (first, end) of each run of ones in ``bits``."""
    empty = F.array().cast("array<struct<first:int,end:int>>")
    firsts = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", bits, F.lit(1))))
    lasts = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftrightunsigned", bits, F.lit(1))))
    lowest = lambda x: F.bit_count(x.bitwiseAND(-x) - 1).cast("int")
    without = lambda x: x.bitwiseAND(x - 1)

    def step(s: Column, _: Column) -> Column:
        run = F.struct(lowest(s["firsts"]).alias("first"), (lowest(s["lasts"]) + 1).alias("end"))
        return F.struct(without(s["firsts"]).alias("firsts"), without(s["lasts"]).alias("lasts"), F.concat(s["runs"], F.array(run)).alias("runs"))

    state = F.struct(firsts.alias("firsts"), lasts.alias("lasts"), empty.alias("runs"))
    return F.aggregate(F.sequence(F.lit(1), F.bit_count(firsts).cast("int")), state, step, lambda s: s["runs"])


def pieces(spans: DataFrame, rank: Column) -> DataFrame:
    """(id, start, end, span, kind) of ``spans`` (id, span, start int, end int, kind): where which span shows.

    ``span`` tells a text's spans apart and orders those of equal ``rank``; the largest ``rank`` shows.
    """
    place = spans.select(F.coalesce("start", "end")).schema[0].dataType
    sound = spans.where("start is not null").select("id", F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"), (-rank).alias("rank"), "span", "kind").where("start < end")
    masks, free = _masks(sound), None
    longest = sound.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    if longest > WORD + 1:  # whole words between the first and the last
        middle = sound.select("id", (F.floor(F.col("start") / WORD) + 1).alias("start"), F.floor((F.col("end") - 1) / WORD).alias("end"), *SHOWN).where("start < end")
        over, free = _beside(_stretches(middle), masks)
        masks = masks.unionByName(over)
    before = Window.partitionBy("id", "word").orderBy(*SHOWN).rowsBetween(Window.unboundedPreceding, -1)
    bits = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("mask").over(before), F.lit(0).cast("long"))))
    shown = masks.select("id", "word", "span", "kind", bits.alias("bits")).where("bits <> 0")
    shown = shown.groupBy("id", "word", "span", "kind").agg(F.bit_or("bits").alias("bits"))
    runs = shown.select("id", "word", "span", "kind", F.explode(_runs(F.col("bits"))).alias("run"))
    at = lambda c: F.col("word") * WORD + F.col(f"run.{c}")
    runs = runs.select("id", at("first").alias("start"), at("end").alias("end"), "span", "kind")
    # Only what meets the edge of a word can go on beyond it. Either side asks the same of the window, so its shuffle is one (a plain condition would drop nulls before it on one side alone).
    edge = F.coalesce((F.col("start") % WORD == 0) | (F.col("end") % WORD == 0), F.lit(False))
    open_ = runs.where(edge)
    if free is not None:
        open_ = open_.unionByName(free.select("id", (F.col("start") * WORD).alias("start"), (F.col("end") * WORD).alias("end"), "span", "kind"))
    by = Window.partitionBy("id", "span", "kind").orderBy("start")
    new = F.coalesce(F.lag("end").over(by) != F.col("start"), F.lit(True))
    joined = open_.withColumn("run", F.sum(new.cast("int")).over(by)).groupBy("id", "span", "kind", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(~edge).unionByName(joined.drop("run")).select("id", F.col("start").cast(place).alias("start"), F.col("end").cast(place).alias("end"), "span", "kind")


def by_kind(kind: Column) -> Column:
    """Rank of the known kinds; others are below them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), kind), F.lit(0))


def analysis_spans(facts: DataFrame, left: DataFrame, names: DataFrame, typos: DataFrame) -> DataFrame:
    """(id, span, start, end, kind): what an analysis paints, in its order.

    ``facts`` has (id, start, end, status), the others (id, start, end): what no
    fact took, the product's name as it was found, and misspelt words.
    """
    odd = F.col("status").isin("unrecognized", "invalid", "unit_mismatch")
    parts = [facts.select("id", "start", "end", F.when(odd, "unrecognized").otherwise("characteristic").alias("kind"), F.lit(0).alias("part"))]
    parts += [df.select("id", "start", "end", F.lit(kind).alias("kind"), F.lit(n).alias("part")) for n, (df, kind) in enumerate(((left, "unrecognized"), (names, "name"), (typos, "typo")), 1)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    number = F.row_number().over(Window.partitionBy("id").orderBy("part", "start", "end", "kind"))
    return whole.where("start is not null").select("id", number.alias("span"), "start", "end", "kind")
