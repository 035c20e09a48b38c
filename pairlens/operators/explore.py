"""Coverage, degree and size statistics of a typed interaction graph.

Triples are ``relation, drug_1, drug_2``.  All results are declarative aggregates: distinct
counts and sums with map-side combine, equi-joins on ids, and no loop over relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoints(triples: DataFrame, keep: list[str]) -> DataFrame:
    """Both endpoints of every triple as ``drug``, with the columns to keep."""
    return triples.select(*keep, F.explode(F.array("drug_1", "drug_2")).alias("drug"))


def flag_members(df: DataFrame, column: str, members: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean: whether the value of ``column`` is among the one-column frame ``members``."""
    known = members.toDF(column).distinct().withColumn(flag, F.lit(True))
    return df.join(known, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def relation_coverage(triples: DataFrame, targets: DataFrame) -> DataFrame:
    """Per relation: drugs, drugs without a target, and pairs of which neither drug has one.

    Percentages are rounded to two digits.  Relations without triples have no row.
    """
    known = targets.select("drug")
    flagged = flag_members(flag_members(triples, "drug_1", known, "h1"), "drug_2", known, "h2")
    ends = F.array(F.struct(F.col("drug_1").alias("drug"), F.col("h1").alias("h")), F.struct(F.col("drug_2").alias("drug"), F.col("h2").alias("h")))
    drugs = flagged.select("relation", F.inline(ends)).distinct()
    per_drug = drugs.groupBy("relation").agg(F.count(F.lit(1)).alias("n_drugs"), F.count_if(~F.col("h")).alias("n_missing"))
    per_pair = flagged.groupBy("relation").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("h1") & ~F.col("h2")).alias("n_both_missing"))
    pct = lambda a, b: F.round(F.col(a) * 100e0 / F.col(b), 2)
    return per_drug.join(per_pair, "relation").select(
        "relation", "n_drugs", "n_missing", pct("n_missing", "n_drugs").alias("pct_missing"), "n_pairs", "n_both_missing", pct("n_both_missing", "n_pairs").alias("pct_both_missing")
    )


def target_regime(h1: Column, h2: Column) -> Column:
    """both_have, one_has or neither_has."""
    return F.when(h1 & h2, "both_have").when(h1 | h2, "one_has").otherwise("neither_has")


def regime_of_pairs(triples: DataFrame, targets: DataFrame) -> DataFrame:
    """The triples with their target regime."""
    both = flag_members(flag_members(triples, "drug_1", targets.select("drug"), "h1"), "drug_2", targets.select("drug"), "h2")
    return both.withColumn("regime", target_regime(F.col("h1"), F.col("h2"))).drop("h1", "h2")


def fixed_bins(value: Column, cuts: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the first cut that the value exceeds; the last name if none."""
    out = None
    for cut, name in zip(cuts, names, strict=False):
        out = F.when(value > cut, name) if out is None else out.when(value > cut, name)
    return out.otherwise(names[-1])


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, exact linear percentiles, maximum.

    The deviation of one row is null; an empty frame gives a count of 0 and nulls.
    """
    c = F.col(column)
    p = F.percentile(c, F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("p")
    row = df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).cast("double").alias("min"), p, F.max(c).cast("double").alias("max"))
    return row.select("n", "mean", "std", "min", *(F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p10", "p25", "p50", "p75", "p90"))), "max")


def degrees(triples: DataFrame) -> DataFrame:
    """``drug, degree``: occurrences over both endpoints; a self pair counts twice."""
    return endpoints(triples, []).groupBy("drug").agg(F.count(F.lit(1)).alias("degree"))


def relations_per_pair(triples: DataFrame) -> DataFrame:
    """``n_relations, n_pairs``: how many pairs have how many relations."""
    per_pair = triples.groupBy("drug_1", "drug_2").agg(F.count_distinct("relation").alias("n_relations"))
    return per_pair.groupBy("n_relations").agg(F.count(F.lit(1)).alias("n_pairs"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """``bin, n``: rows in equal bins of [lo, hi); bin 0 lies below, bin bins + 1 at or above hi."""
    at = F.width_bucket(F.col(column).cast("double"), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    return df.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def key_values(row: DataFrame) -> DataFrame:
    """A one-row frame of numbers as ``metric, value`` rows."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS (metric, value)")
