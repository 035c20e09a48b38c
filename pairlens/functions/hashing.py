"""Deterministic order by content: equal in every engine, partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the hash that name a cell; a group has at most 16 ** CELL_DIGITS cells.
CELL_DIGITS = 3


def content_hash(*cols: Column, seed: int = 42) -> Column:
    """md5 of the columns and a seed, as hex text."""
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in cols), F.lit(str(seed))))


def hash_slot(hashed: Column, n: Column, start: int = 1) -> Column:
    """A number from 0 to n - 1 from eight hex digits of a hash."""
    return F.pmod(F.conv(F.substring(hashed, start, 8), 16, 10).cast("bigint"), n)


def hashed_rank(df: DataFrame, groups: list[str], hashed: str, name: str = "rank", size: str = "group_size") -> DataFrame:
    """Adds the place (from 0) of each row in its group by the hash column, and the group's size.

    A group may hold any share of the rows: rows are ranked within cells of the hash, and the
    numbers of rows in earlier cells are added, so no task sorts a whole group.  Hashes must
    be unique within a group, or equal ones get any order.
    """
    cell = df.withColumn("_cell", F.substring(hashed, 1, CELL_DIGITS))
    by = [*groups, "_cell"]
    counts = cell.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    counts = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_cell")) - F.col("_n"), size: F.sum("_n").over(whole)})
    in_cell = Window.partitionBy(*by).orderBy(hashed)
    keyed = cell.join(counts.drop("_n"), by) if not groups else null_safe_join(cell, counts.drop("_n"), by)
    return keyed.withColumn(name, F.col("_before") + F.row_number().over(in_cell) - 1).drop("_cell", "_before")


def sorted_index(df: DataFrame, key: str, prefix: int, name: str = "id") -> DataFrame:
    """Adds the place (from 0) of each distinct, non-null text key in sorted order.

    Keys are ranked within cells that share their first ``prefix`` characters, after the
    number of keys in earlier cells, so no task sorts all keys.  Only the cells' counts are
    summed in one window; choose a prefix that leaves few keys per cell and few cells.
    """
    cell = df.filter(F.col(key).isNotNull()).withColumn("_cell", F.substring(key, 1, prefix))
    counts = cell.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_cell", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_cell")) - F.col("_n")).alias("_before"))
    in_cell = Window.partitionBy("_cell").orderBy(key)
    return cell.join(counts, "_cell").withColumn(name, F.col("_before") + F.row_number().over(in_cell) - 1).drop("_cell", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join in which nulls of the given columns are equal; these columns stand once."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in by]
    return left.join(renamed, on).drop(*(f"_r_{c}" for c in by))
