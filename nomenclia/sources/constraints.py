"""Declared constraints on rows: what keeps them goes on, what breaks any goes to quarantine with the names of those.

Rules are conditions; a row passes one that is true, and a rule that is unknown
for a row (null) counts as broken. Kept and refused rows are written in one pass
over the input, so their counts add up to it whatever happens to the source
meanwhile.

Cases: no rules keep everything; a row that breaks several rules is refused once
and names them all, in the rules' order; an empty table gives two empty ones;
an input column with a quarantine column's name is refused as an error.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROKEN = "broken"

# ---------------------------------------------------------------- fixed values
#: What a value of the catalogue must be: a range, a quality or a number, each with what it says.
VALUE_RULES = {
    "one kind": "int(coalesce(is_range, false)) + int(coalesce(is_quality, false)) + int(concrete_value is not null) <= 1",
    "range has bounds": "not coalesce(is_range, false) or lower is not null or upper is not null",
    "bounds in order": "lower is null or upper is null or lower < upper or (lower = upper and lower_inc and upper_inc)",
    "quality is said": "not coalesce(is_quality, false) or trim(quality_description) <> ''",
}
# ----------------------------------------------------------------


def range_text(lower: Column, upper: Column, lower_inc: Column, upper_inc: Column) -> Column:
    """A range as ``[1,2)``: brackets for ends that belong to it, nothing for open ones; null where it has no inclusion flags at all."""
    left, right = F.when(lower_inc, "[").otherwise("("), F.when(upper_inc, "]").otherwise(")")
    shown = F.concat(left, F.coalesce(lower.cast("string"), F.lit("")), F.lit(","), F.coalesce(upper.cast("string"), F.lit("")), right)
    return F.when(lower_inc.isNotNull() | upper_inc.isNotNull() | lower.isNotNull() | upper.isNotNull(), shown)


@dataclass
class Checked:
    """The two tables of a check."""

    kept: DataFrame
    refused: DataFrame

    def counts(self) -> DataFrame:
        """(rule, n): rows kept (rule null) and, by rule, rows that break it."""
        kept = self.kept.agg(F.lit(None).cast("string").alias("rule"), F.count("*").alias("n"))
        return kept.unionByName(self.refused.select(F.explode(BROKEN).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")))


def broken(rules: dict[str, Column | str]) -> Column:
    """The names of the rules that a row breaks."""
    tests = [F.when(~F.coalesce(F.expr(r) if isinstance(r, str) else r, F.lit(False)), name) for name, r in rules.items()]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def check(rows: DataFrame, rules: dict[str, Column | str], target: str) -> Checked:
    """Write ``rows`` under a new folder of ``target``, split by whether they keep all ``rules``."""
    if BROKEN in rows.columns or "__sound" in rows.columns:
        raise ValueError(f"a column is named {BROKEN!r} or '__sound'")
    path = f"{target}/checked-{uuid.uuid4().hex}"
    judged = rows.withColumn(BROKEN, broken(rules)).withColumn("__sound", F.size(BROKEN) == 0)
    judged.write.partitionBy("__sound").parquet(path)
    # Each side is one folder of the written table, so the other is never read.
    whole = rows.sparkSession.read.schema(judged.schema).parquet(path)
    return Checked(whole.where("__sound").drop(BROKEN, "__sound"), whole.where("not __sound").drop("__sound"))
