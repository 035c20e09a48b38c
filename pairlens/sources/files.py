"""CSV readers with declared types, result sinks, and merging of cached tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declared columns of the delivered CSV files.
CSV_SCHEMAS: dict[str, str] = {
    "combo": "`STITCH 1` string, `STITCH 2` string, `Polypharmacy Side Effect` string, `Side Effect Name` string",
    "mono": "STITCH string, `Individual Side Effect` string",
    "ppi": "`Gene 1` bigint, `Gene 2` bigint",
    "targets": "STITCH string, Gene bigint",
    "smiles": "STITCH string, SMILES string",
}


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A delivered CSV file with its header and declared types; a wrong header or value fails."""
    if name not in CSV_SCHEMAS:
        raise ValueError(f"no schema for {name!r}; choose from {sorted(CSV_SCHEMAS)}")
    return spark.read.schema(CSV_SCHEMAS[name]).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_result(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a result table as Parquet or CSV with a header, replacing an older one."""
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown form {form!r}")
    writer = df.write.mode("overwrite")
    writer.parquet(path) if form == "parquet" else writer.option("header", True).csv(path)


def merge_keep_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name, one row per key: from the earliest frame that has it.

    Columns that a frame lacks are null.  Of several rows of one key in that frame, the
    smallest by all other columns is kept.  Null keys are keys like others.
    """
    merged = None
    for at, df in enumerate(frames):
        marked = df.withColumn("_source", F.lit(at))
        merged = marked if merged is None else merged.unionByName(marked, allowMissingColumns=True)
    rest = [c for c in merged.columns if c not in (*keys, "_source")]
    first = merged.groupBy(*keys).agg(F.min(F.struct("_source", *rest)).alias("_m"))
    return first.select(*keys, *(F.col("_m")[c].alias(c) for c in rest))
