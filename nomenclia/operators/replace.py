"""The words that named a product, the text with another name in their place, and the spans after it.

An edit removes some characters at a place and adds others. Edits of a text have
an order, and each is about the text that those before it made. A span before an
edit stays, one after it moves with the text, one around it grows or shrinks, and
one that lies, begins or ends inside what was removed is gone: its words are.

Cases: a null text is empty; no matched words and no such name: the new name
alone; matched words that the text does not have (or none): the new name, a comma
and the text; case does not count, of several places the first does; a text
without edits keeps its spans; spans with a missing end are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "at int, removed int, added string"


def matched_text(tokens: Column, evidence: Column) -> Column:
    """The words at the places ``evidence`` of ``tokens`` (structs with text), in their order."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(evidence)), lambda k: F.get(tokens, k)["text"]), " ")


def name_edit(text: Column, matched: Column, name: Column, unknown: Column) -> Column:
    """(EDIT) that puts ``name`` in place of the ``matched`` words; ``unknown`` tells that no product was found."""
    t, m = F.coalesce(text, F.lit("")), F.coalesce(matched, F.lit(""))
    place = F.when(m != "", F.position(F.lower(m), F.lower(t))).otherwise(F.lit(0))
    edit = lambda at, removed, added: F.struct(at.cast("int").alias("at"), removed.cast("int").alias("removed"), added.alias("added"))
    whole = (m == "") & F.coalesce(unknown, F.lit(False))
    return F.when(place > 0, edit(place - 1, F.length(m), name)).when(whole, edit(F.lit(0), F.length(t), name)).otherwise(edit(F.lit(0), F.lit(0), F.concat(name, F.lit(", "))))


def edited(text: Column, edits: Column) -> Column:
    """``text`` after an array of edits in order."""
    step = lambda t, e: F.concat(F.substring(t, F.lit(1), e["at"]), e["added"], F.substring(t, e["at"] + e["removed"] + 1, F.length(t)))
    return F.aggregate(edits, F.coalesce(text, F.lit("")), step)


def carried(start: Column, end: Column, edits: Column) -> Column:
    """(start, end) of a span after an array of edits in order, null if its words are gone."""
    none = F.lit(None).cast("struct<start:int,end:int>")

    def step(s: Column, e: Column) -> Column:
        past, grown = e["at"] + e["removed"], F.length(e["added"]) - e["removed"]
        moved = F.struct((s["start"] + grown).cast("int").alias("start"), (s["end"] + grown).cast("int").alias("end"))
        around = F.struct(s["start"].alias("start"), (s["end"] + grown).cast("int").alias("end"))
        return F.when(s["end"] <= e["at"], s).when(s["start"] >= past, moved).when((s["start"] <= e["at"]) & (s["end"] >= past) & (s["end"] - s["start"] > e["removed"]), around).otherwise(none)

    return F.aggregate(edits, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")), step)


def carry(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """``spans`` (id, start, end and others) after ``edits`` (id, number, at, removed, added); those whose words are gone are not there."""
    listed = edits.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "at", "removed", "added"))), lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["added"].alias("added"))).alias("__edits"))
    empty = F.array().cast("array<struct<at:int,removed:int,added:string>>")
    met = spans.where("start is not null and end is not null").join(listed, "id", "left").withColumn("__to", carried(F.col("start"), F.col("end"), F.coalesce("__edits", empty)))
    return met.where("__to is not null").withColumns({"start": F.col("__to.start"), "end": F.col("__to.end")}).select(*spans.columns)
