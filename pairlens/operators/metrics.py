"""Exact ranking and threshold metrics per group, as grouped and windowed aggregates.

Scores are first compacted to one row per (group, score) with its positives and negatives.
Sums down the ranking are taken in two steps: over cells of the score, a group's few, and
then inside each cell; so no task ranks a whole group.  Undefined metrics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.functions.hashing import null_safe_join

#: Cells of the score in a range of one.
CELLS = 1024


def score_levels(scored: DataFrame, by: list[str]) -> DataFrame:
    """``score, tp, fp`` at each distinct score and the cumulated ``ctp, cfp`` from the highest, with ``p, n``."""
    levels = scored.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp")).withColumn("_cell", F.floor(F.col("score") * CELLS))
    cells = levels.groupBy(*by, "_cell").agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    over = group.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.sum(c).over(over) - F.col(c)
    sums = cells.withColumns({"_tp_before": before("_tp"), "_fp_before": before("_fp"), "p": F.sum("_tp").over(group), "n": F.sum("_fp").over(group)}).drop("_tp", "_fp")
    down = Window.partitionBy(*by, "_cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumns({"ctp": F.sum("tp").over(down), "cfp": F.sum("fp").over(down)})
    return null_safe_join(ranked, sums, [*by, "_cell"]).withColumns({"ctp": F.col("ctp") + F.col("_tp_before"), "cfp": F.col("cfp") + F.col("_fp_before")}).drop("_cell", "_tp_before", "_fp_before")


def ranking_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """``n_pos, n_neg, auroc, ap``: tie-aware area under the ROC curve, and step-wise average precision.

    Rounded to 4 digits; both are null where a group has one class only.
    """
    levels = score_levels(scored, by)
    auc = F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2e0)) / F.nullif(F.max("p") * F.max("n"), F.lit(0))
    ap = F.sum(F.col("tp") * F.col("ctp").cast("double") / (F.col("ctp") + F.col("cfp"))) / F.nullif(F.max("p"), F.lit(0))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return levels.groupBy(*by).agg(F.max("p").alias("n_pos"), F.max("n").alias("n_neg"), F.when(both, F.round(auc, 4)).alias("auroc"), F.when(both, F.round(ap, 4)).alias("ap"))


def threshold_metrics(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """``f1, precision, recall`` of predicting 1 at or above the threshold; a division by zero gives 0."""
    said = F.col("score") >= threshold
    tp, fp, fn = (F.count_if(c) for c in (said & (F.col("label") == 1), said & (F.col("label") == 0), ~said & (F.col("label") == 1)))
    safe = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    both = F.count_distinct("label") == 2
    return scored.groupBy(*by).agg(F.when(both, safe(2 * tp, 2 * tp + fp + fn)).alias("f1"), F.when(both, safe(tp, tp + fp)).alias("precision"), F.when(both, safe(tp, tp + fn)).alias("recall"))


def curve_points(scored: DataFrame, by: list[str]) -> DataFrame:
    """``score, fpr, tpr, precision, recall`` at each distinct score of groups with both classes."""
    s = score_levels(scored, by).filter("p > 0 AND n > 0")
    return s.select(*by, "score", F.round(F.col("cfp") / F.col("n"), 6).alias("fpr"), F.round(F.col("ctp") / F.col("p"), 6).alias("tpr"), F.round(F.col("ctp") / (F.col("ctp") + F.col("cfp")), 6).alias("precision"))


def best_f1(scored: DataFrame, by: list[str]) -> DataFrame:
    """``threshold, f1``: the score with the largest F1, of equal ones the lowest."""
    s = score_levels(scored, by).filter("p > 0")
    f1 = F.round(2e0 * F.col("ctp") / (F.col("ctp") + F.col("cfp") + F.col("p")), 6)
    best = s.select(*by, "score", f1.alias("f1")).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("threshold"), F.col("b.f1").alias("f1"))


def class_ratio(labelled: DataFrame, by: list[str]) -> DataFrame:
    """``ratio``: negatives for each positive, taking at least one positive."""
    pos = F.count_if(F.col("label") == 1)
    return labelled.groupBy(*by).agg(pos.alias("n_pos"), F.round(F.count_if(F.col("label") == 0) / F.greatest(pos, F.lit(1)), 6).alias("ratio"))


def quartile_strata(meta: DataFrame, size: str, missing: str) -> DataFrame:
    """Adds ``size_bin`` and ``missing_bin`` by the quartiles of both columns, with strict comparisons."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cuts = meta.agg(q(size).alias("_s"), q(missing).alias("_m"))
    name = lambda c, cut: F.when(F.col(c) > F.col(cut)[2], "high").when(F.col(c) > F.col(cut)[1], "medium").when(F.col(c) > F.col(cut)[0], "low").otherwise("very_low")
    return meta.join(F.broadcast(cuts)).withColumns({"size_bin": name(size, "_s"), "missing_bin": name(missing, "_m")}).drop("_s", "_m")  # cuts is one row


def _mean(column: str) -> Column:
    """Mean rounded to 4 digits; means that lie between two of them do not hang on the last bit."""
    return F.round(F.avg(column) + 1e-9, 4)


def mean_and_std(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column, and the rows; the deviation of one row is null."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [_mean(c).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std")]
    return results.groupBy(*by).agg(*aggs)


def mean_by(results: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*(_mean(c).alias(c) for c in columns))


def pivot_mean(results: DataFrame, by: list[str], column: str, values: list[str], measure: str) -> DataFrame:
    """Mean of the measure per group, one column for each of the given values."""
    return results.groupBy(*by).agg(*(F.avg(F.when(F.col(column) == v, F.col(measure))).alias(v) for v in values))
