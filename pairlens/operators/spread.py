"""Joins of rows with keys whose numbers of rows are known, with hot keys spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so at most HOT keys are, and these are broadcast.
HOT = 200
#: Parts into which the rows of a hot key are spread.
PARTS = 64


def spread_join(rows: DataFrame, keyed: DataFrame, counts: DataFrame, on: list[str], n: str, row: str, shuffled: bool = False) -> DataFrame:
    """``rows JOIN keyed USING (on)`` in which no task gets all rows of a hot key.

    ``counts`` has one row per key with its number ``n`` of rows.  Rows of a hot key are
    spread by a hash of their column ``row``, and what is keyed by it goes to every part;
    all other keys are joined as they are.  Null keys match nothing.  ``shuffled`` asks for a
    shuffle of both sides where the planner could take a large ``keyed`` for a small one.
    """
    total = counts.agg(F.sum(n).alias("_total"))
    hot = counts.join(F.broadcast(total)).filter(F.col(n) * HOT >= F.col("_total")).select(*on).distinct().withColumn("_hot", F.lit(True))  # total is one row
    hot = F.broadcast(hot)  # at most HOT rows
    left = rows.join(hot, on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(row), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(hot, on, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right.hint("merge") if shuffled else right, [*on, "_part"]).drop("_part")
