"""Numbers of a text as one pattern: a condition before, dimensions or an interval, and units.

A hit is a condition ("от", "не более", "≥"), if any, then a number or several with
crosses between (dimensions), a unit, and after "до" or a hyphen the end of an
interval with its unit. Numbers in words and in model codes are none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenclia.functions.units import SPELLING, is_weak, unit_of

# ---------------------------------------------------------------- fixed values
AT_LEAST = ("от", "не менее", "свыше", "более", "больше", "выше", "не ниже", "минимум", ">", "≥")
AT_MOST = ("до", "не более", "менее", "меньше", "ниже", "не выше", "максимум", "<", "≤")
# Latin letters other than the sign between dimensions, or two hyphens; and anything that belongs to no number.
CODE, FOREIGN = r"[a-wyzA-Z]|-.*-", r"[^\d.,\-–/x×хХ*+%°\"\s]"
# ----------------------------------------------------------------

_SPACE = r"[^\S\n]"
_NUMBER = r"(?>\d+(?:[.,]\d+)?)"
_SAID = "|".join(w.replace(" ", f"{_SPACE}+") for w in sorted((*AT_LEAST, *AT_MOST), key=lambda w: (-len(w), w)))
_CONDITION = rf"(?:(?<![a-zа-я0-9])({_SAID})(?![a-zа-я]){_SPACE}*)?"
_CROSSED = rf"(?:{_SPACE}*[xх*]{_SPACE}*{_NUMBER})"
_UNIT = f"( ?{SPELLING})"
# A number starts where no word and no other number ends, and is not the start of a word.
_FIRST = rf"(?<!\d)(?<![a-wyzа-фц-я])(?<![a-zа-я][xх])({_NUMBER})({_CROSSED}*)(?:{_UNIT}|(?![a-wyzа-фц-я0-9])(?![xх][a-zа-я]))"
_SECOND = rf"(?:(?:{_SPACE}*(?<![a-zа-я])до(?![a-zа-я]){_SPACE}*|{_SPACE}?-{_SPACE}*)({_NUMBER}){_UNIT}?)?"
PATTERN = f"(?iu){_CONDITION}{_FIRST}{_SECOND}"

FOUND = "array<struct<start:int,end:int,kind:string,value:double,low:double,high:double,dims:array<double>,unit:string,weak:boolean,text:string>>"


def value_of(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit(".")).cast("double")


def numbers_of(text: Column) -> Column:
    """(FOUND) of a normalised text: kind 'number', 'dims' or 'interval' (either bound may be missing), in order, by code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    place = "array<struct<hit:string,at:int>>"
    step = lambda s, x: F.struct((s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(x["hit"].alias("hit"), (s["at"] + F.length(x["gap"])).cast("int").alias("at")))).alias("out"))
    placed = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.struct(F.lit(0).alias("at"), F.array().cast(place).alias("out")), step, lambda s: s["out"])
    parts = F.transform(F.filter(placed, lambda h: h["hit"].isNotNull()), _parts)
    return F.transform(F.filter(parts, lambda p: ~_in_code(text, p)), _number).cast(FOUND)


def _parts(h: Column) -> Column:
    names = ("said", "first", "crossed", "unit", "second", "unit2")
    return F.struct(h["hit"].alias("hit"), h["at"].alias("at"), *[F.regexp_extract(h["hit"], PATTERN, k).alias(n) for k, n in enumerate(names, 1)])


def _offset(p: Column) -> Column:
    """Characters of a hit before its first number."""
    return F.when(p["said"] == "", F.lit(0)).otherwise(F.length(F.regexp_extract(p["hit"], rf"(?iu)^({_SAID}){_SPACE}*", 0)))


def _in_code(text: Column, p: Column) -> Column:
    """The first number stands in a model code: its stretch without spaces, or what a unit that ends it leaves, reads as one."""
    at = p["at"] + _offset(p)
    before = F.regexp_extract(F.substring(text, F.lit(1), at), r"\S*$", 0)
    rest = F.substring(text, at + F.length(p["first"]) + 1, F.length(text))
    after, unit = F.regexp_extract(rest, r"^\S*", 0), F.regexp_extract(rest, f"(?iu)^{_UNIT}", 0)
    whole = (unit == "") | (F.length(unit) < F.length(after))
    said = F.when(whole, F.regexp_replace(F.concat(before, p["first"], after), r"^[.,;:()\"']+|[.,;:()\"']+$", "")).otherwise(F.concat(before, p["first"]))
    return said.rlike(CODE) | ((unit == "") & said.rlike(FOREIGN))


def _number(p: Column) -> Column:
    first = value_of(p["first"])
    dims = F.transform(F.regexp_extract_all(F.concat(p["first"], p["crossed"]), F.lit(_NUMBER), F.lit(0)), value_of)
    several, between = p["crossed"] != "", (p["crossed"] == "") & (p["second"] != "")
    said = F.regexp_replace(F.lower(p["said"]), r"\s+", " ")
    least, most = said.isin(*AT_LEAST), said.isin(*AT_MOST)
    spelling = F.when(between & (p["unit2"] != ""), p["unit2"]).otherwise(p["unit"])
    # Dimensions take no condition; an interval's second end counts only where the first is one number.
    length = F.when(several & (p["second"] != ""), F.length(F.regexp_extract(p["hit"], f"(?iu){_CONDITION}{_FIRST}", 0))).otherwise(F.length(p["hit"]))
    skip = F.when(several, _offset(p)).otherwise(F.lit(0))
    return F.struct(
        (p["at"] + skip).alias("start"),
        (p["at"] + length).alias("end"),
        F.when(several, "dims").when(between | (said != ""), "interval").otherwise("number").alias("kind"),
        first.alias("value"),
        F.when(between | (~several & least), first).alias("low"),
        F.when(between, value_of(p["second"])).when(~several & most, first).alias("high"),
        F.when(several, dims).otherwise(F.array().cast("array<double>")).alias("dims"),
        unit_of(spelling).alias("unit"),
        ((spelling != "") & is_weak(spelling)).alias("weak"),
        F.substring(p["hit"], skip + 1, length - skip).alias("text"),
    )
