"""Duplicates hidden by formatting differences.

Two levels of grouping: rows that are byte-identical in the record's fields are collapsed
first, with their counts; only the distinct survivors are canonicalised and grouped again,
on the full canonical text, summing the counts.  Both levels combine map-side, so a record
that fills a third of all rows reaches the shuffle as one state per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions import canonical_text, is_complete
from pairlens.operators.spread import spread_join
from pairlens.plans import WorkTables


def _raw(df: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("row_id"), *(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)))


def _names(fields: Sequence[str]) -> list[str]:
    return [f"f{i}" for i in range(len(fields))]


def survivors(df: DataFrame, fields: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """One row per distinct spelling of the fields: ``f0, f1, ..., n, lo, hi, record``.

    ``n`` rows have the spelling, with ids from ``lo`` to ``hi``; ``record`` is its canonical text.
    """
    names = _names(fields)
    distinct = _raw(df, fields, id_col).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    return distinct.select("*", canonical_text([F.col(n) for n in names]).alias("record"))


def _records(spellings: DataFrame) -> DataFrame:
    return (
        spellings.groupBy("record")
        .agg(
            F.sum(F.when(is_complete(F.col("record")), F.col("n"))).alias("copies"),  # null where incomplete: no filter on the text itself
            F.count(F.lit(1)).alias("spellings"),
            F.min("lo").alias("first_row_id"),
            F.max("hi").alias("last_row_id"),
        )
        .filter("copies > 0")
    )


def collapse_copies(df: DataFrame, fields: Sequence[str], id_col: str = "row_id") -> DataFrame:
    """One row per record: ``record, copies, spellings, first_row_id, last_row_id``.

    A record is the set of rows whose cleaned fields are equal in any order; ``copies`` is
    its number of rows and ``spellings`` the number of byte-different spellings among them.
    Rows with a missing field (null, or nothing left after cleaning) are no records and are
    left out.  A null id counts as a copy but is never first or last.  Repeated ids count
    once for each row.  An empty table gives no rows.  Other columns are ignored, so extra
    columns of any name do no harm.
    """
    return _records(survivors(df, fields, id_col).select("record", "n", "lo", "hi"))


def copies_of_records(df: DataFrame, fields: Sequence[str], tables: WorkTables, id_col: str = "row_id") -> DataFrame:
    """``first_row_id, row_id``: every row of a record but its first, with the first.

    The survivors of the first grouping are written once; those of records with several
    rows get their record's first id, and the raw rows are joined with them on the raw
    fields, so no raw row is canonicalised.  A record of very many spellings and a spelling
    of very many rows are spread over tasks (``spread_join``).  Ids must be unique; rows with
    a null id are left out.
    """
    names = _names(fields)
    spellings = tables.save(survivors(df, fields, id_col), "survivors")
    records = tables.save(_records(spellings).filter("copies > 1").select("record", "spellings", "first_row_id"), "records")
    several = spread_join(spellings.select(*names, "n", "lo", "record"), records.select("record", "first_row_id"), records, ["record"], "spellings", "lo")
    keyed = tables.save(several.select(*names, "n", "first_row_id"), "copies")
    rows = spread_join(_raw(df, fields, id_col), keyed.drop("n"), keyed, names, "n", "row_id")
    return rows.filter(F.col("row_id") > F.col("first_row_id")).select("first_row_id", "row_id")
