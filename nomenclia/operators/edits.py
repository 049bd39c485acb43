"""A user's changes to an analysis, as the fold of a log of actions in any order of arrival.

Actions of a session are numbered. ``set`` gives a characteristic a value,
``remove`` leaves it out, ``select`` picks a position (or none), ``undo`` takes
back the action of the number ``undoes``. Names are compared without case and
outer spaces. Of each name the last action counts: a set one is an override and
no longer left out, a removed one the reverse. The selection is that of the last
``select``, unless an action on a name came after it, which clears it.

Every part of the fold is a maximum by number, which merges in any order and is
combined before the shuffle; what reaches a session's row is one entry a name.

Cases: an undone action leaves the state that the others make, and an action
that arrives after its undo is undone too; an ``undo`` is not undone itself;
actions without a number, or on no name, are dropped; of actions with one number
the largest by kind and content counts; a session whose actions are all undone
has a row of empty lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
SET, REMOVE, SELECT, UNDO = "set", "remove", "select", "undo"
# ----------------------------------------------------------------


def state(actions: DataFrame) -> DataFrame:
    """(session, overrides array<struct<name,value>>, excluded array<string>, selected_code) of ``actions`` (session, number, action, name, value, undoes).

    The lists are in order of their last action; ``value`` is the position's code in a ``select``.
    """
    sound = actions.where("number is not null")
    undone = sound.where(F.col("action") == UNDO).select("session", F.col("undoes").alias("number")).distinct()
    # Undone actions are marked by the table of undos, a small one; what is left of each name is its last action.
    left = sound.where(F.col("action") != UNDO).join(undone.withColumn("gone", F.lit(True)), ["session", "number"], "left")
    live = F.col("gone").isNull()
    key = F.lower(F.trim("name"))
    on_name = F.col("action").isin(SET, REMOVE) & (F.coalesce(key, F.lit("")) != "")
    named = left.where(live & on_name).groupBy("session", key.alias("key")).agg(F.max(F.struct("number", "action", "name", "value")).alias("last"))
    lists = named.groupBy("session").agg(F.array_sort(F.collect_list("last")).alias("names"), F.max("last.number").alias("changed"))
    picked = left.where(live & (F.col("action") == SELECT)).groupBy("session").agg(F.max(F.struct("number", "value")).alias("pick"))
    sessions = sound.select("session").distinct()
    met = sessions.join(lists, "session", "left").join(picked, "session", "left")
    kind = lambda k: F.filter(F.coalesce("names", F.array().cast("array<struct<number:bigint,action:string,name:string,value:string>>")), lambda x: x["action"] == k)
    return met.select(
        "session",
        F.transform(kind(SET), lambda x: F.struct(F.trim(x["name"]).alias("name"), x["value"].alias("value"))).alias("overrides"),
        F.transform(kind(REMOVE), lambda x: F.trim(x["name"])).alias("excluded"),
        F.when(F.col("changed").isNull() | (F.col("pick.number") > F.col("changed")), F.col("pick.value")).alias("selected_code"),
    )
