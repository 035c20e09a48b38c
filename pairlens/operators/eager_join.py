"""Per-key results over skewed joins by eager aggregation.

A join of two inputs followed by a roll-up is computed on compact states: both inputs are
aggregated by join key (and the columns of the later roll-up) before the join, so a key
that holds a third of all rows becomes one state per task by the map-side combine, and at
most one state per (join key, group) after the shuffle.  The join multiplies counts and
scales sums; the roll-up adds them.  No row of a hot key is ever shuffled, and no task
gets a share of rows that grows with the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact_states(df: DataFrame, keys: Sequence[str], groups: Sequence[str], sums: Sequence[str], prefix: str) -> DataFrame:
    """One state per (join key, group): the row count and the sum of each measure."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_n")] + [F.sum(c).alias(f"{prefix}_sum_{c}") for c in sums]
    return df.groupBy(*keys, *groups).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY left_groups, right_groups`` without joining rows.

    Returns the group columns, ``join_rows`` (rows of the join) and for each measure the sum
    over the rows of the join.  Equal to joining first: the count of a pair of states is the
    product of their counts, and a sum on one side counts once for every row of the other.

    Null join keys match nothing, as in SQL; null groups are groups of their own; a sum over
    nulls alone is null; empty inputs give no rows.  Columns not named here are dropped
    first, so clashing names do no harm.  A column may not be a join key and a group at once,
    nor a group on both sides.
    """
    names = [*on, *left_groups, *right_groups]
    if len(set(names)) < len(names):
        raise ValueError(f"join keys and groups must be different columns: {names}")
    l_state = compact_states(left.dropna(subset=list(on)), on, left_groups, left_sums, "l")
    r_state = compact_states(right.dropna(subset=list(on)), on, right_groups, right_sums, "r")
    aggs = [F.sum(F.col("l_n") * F.col("r_n")).alias("join_rows")]
    aggs += [F.sum(F.col(f"l_sum_{c}") * F.col("r_n")).alias(f"sum_{c}") for c in left_sums]
    aggs += [F.sum(F.col(f"r_sum_{c}") * F.col("l_n")).alias(f"sum_{c}") for c in right_sums]
    return l_state.join(r_state, list(on)).groupBy(*left_groups, *right_groups).agg(*aggs)


def heavy_keys(df: DataFrame, fields: Sequence[str], key_of, min_share_of_rows: tuple[int, int] = (2, 100)) -> DataFrame:
    """Cleaned values of ``fields`` that stand in at least the given share of all rows.

    ``key_of`` turns a raw column into its cleaned key (null: missing).  The rows, as
    (field, spelling), are joined with the dictionary of spellings (spelling, key) by
    :func:`eager_join_aggregate`; the rows are counted by spelling before the join.
    Returns ``field_name, key_value, key_rows, all_rows``.  Rows with a missing value count
    among all rows but make no key.  The share is compared in whole numbers, and a key
    exactly at the share is kept.  An empty table gives no rows.
    """
    part, whole = min_share_of_rows
    named = [F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("spelling")) for f in fields]
    values = df.select(F.inline(F.array(*named)))
    spellings = values.select("spelling").dropna().distinct().select("spelling", key_of(F.col("spelling")).alias("key_value")).dropna()
    per_key = eager_join_aggregate(values, spellings, ["spelling"], ["field_name"], ["key_value"])
    totals = values.groupBy("field_name").agg(F.count(F.lit(1)).alias("all_rows"))
    return (
        per_key.join(totals, "field_name")
        .filter(F.col("join_rows") * whole >= F.col("all_rows") * part)
        .select("field_name", "key_value", F.col("join_rows").alias("key_rows"), "all_rows")
    )
