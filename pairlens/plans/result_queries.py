"""Queries on metrics, and on results as a study would collect them.

Scores come from the data: in each strategy, a drug's smoothed share of positives among its
train rows.  ``drug_1`` scores a pair by its first drug, ``drug_2`` by its second, ``both``
by their mean.  Unseen drugs get one half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import explore, metrics
from pairlens.plans.explore_queries import MIN_PAIRS
from pairlens.plans.sql import ENDS, frequent, with_views
from pairlens.sources import graph_views as g

MODES = ("drug_1", "drug_2", "both")
STRATEGIES = ("random_pair", "stratified_pair", "drug_cold_start")
MEASURES = ("auroc", "ap", "f1", "precision", "recall")
TEST_FOLDS = ("val", "test")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``strategy, relation, regime, mode, label, score`` of the evaluation rows."""
    r = g.split_records(spark, sf_dir)
    train = r.filter("fold = 'train'").select("strategy", "label", F.explode(F.array("drug_1", "drug_2")).alias("drug"))
    rate = train.groupBy("strategy", "drug").agg(((F.sum("label") + 1e0) / (F.count(F.lit(1)) + 2)).alias("rate"))
    rows = explore.regime_of_pairs(r.filter(F.col("fold").isin(*TEST_FOLDS)), g.targets(spark, sf_dir))
    a = rate.select("strategy", F.col("drug").alias("drug_1"), F.col("rate").alias("r1"))
    b = rate.select("strategy", F.col("drug").alias("drug_2"), F.col("rate").alias("r2"))
    half = F.lit(0.5)
    s = rows.join(a, ["strategy", "drug_1"], "left").join(b, ["strategy", "drug_2"], "left").withColumns({"r1": F.coalesce("r1", half), "r2": F.coalesce("r2", half)})
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.round(c, 6).alias("score")) for m, c in zip(MODES, (F.col("r1"), F.col("r2"), (F.col("r1") + F.col("r2")) / 2), strict=True)))
    return s.select("strategy", "relation", "regime", "label", F.inline(modes))


def _results(spark, sf_dir):
    """Metrics per strategy, mode and relation with both classes."""
    s, by = _scored(spark, sf_dir), ["strategy", "mode", "relation"]
    return metrics.ranking_metrics(s, by).join(metrics.threshold_metrics(s, by), by).filter("auroc IS NOT NULL")


def _meta(spark, sf_dir):
    c = explore.relation_coverage(g.frequent_triples(spark, sf_dir, MIN_PAIRS), g.targets(spark, sf_dir))
    return metrics.quartile_strata(c.select("relation", "n_pairs", "pct_missing"), "n_pairs", "pct_missing")


def metrics_by_group(spark, sf_dir):
    return metrics.ranking_metrics(_scored(spark, sf_dir), ["strategy", "mode"])


def threshold_metrics(spark, sf_dir):
    return metrics.threshold_metrics(_scored(spark, sf_dir), ["strategy", "mode"])


def regime_metrics(spark, sf_dir):
    """Metrics per target regime of groups with at least ten rows."""
    s, by = _scored(spark, sf_dir), ["strategy", "mode", "regime"]
    return metrics.ranking_metrics(s, by).filter("n_pos + n_neg >= 10 AND auroc IS NOT NULL")


def roc_pr_points(spark, sf_dir):
    return metrics.curve_points(_scored(spark, sf_dir), ["strategy", "mode"])


def best_f1_threshold(spark, sf_dir):
    return metrics.best_f1(_scored(spark, sf_dir), ["strategy", "mode"])


def class_ratio(spark, sf_dir):
    return metrics.class_ratio(g.split_records(spark, sf_dir).filter("fold = 'train'"), ["strategy", "relation"])


def adaptive_sizes(spark, sf_dir):
    """Model sizes that follow the training data: rank, leaves and smallest leaf."""
    r = g.split_records(spark, sf_dir).filter("fold = 'train'")
    drugs = r.select("strategy", "relation", F.explode(F.array("drug_1", "drug_2")).alias("drug")).groupBy("strategy", "relation").agg(F.count_distinct("drug").alias("n_drugs"))
    n = r.groupBy("strategy", "relation").agg(F.count(F.lit(1)).alias("n_train")).join(drugs, ["strategy", "relation"])
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    rank = F.least(F.lit(128), F.greatest(F.lit(1), F.floor(F.col("n_drugs") / 10)), F.greatest(F.lit(1), F.col("n_drugs") - 1))
    return n.select("strategy", "relation", "n_train", "n_drugs", rank.alias("rank"), clip(F.floor(F.col("n_train") / 50), 7, 63).alias("num_leaves"), clip(F.floor(F.col("n_train") / 30), 5, 20).alias("min_child"))


def quartile_strata(spark, sf_dir):
    return _meta(spark, sf_dir)


def results_table(spark, sf_dir):
    return _results(spark, sf_dir)


def results_summary(spark, sf_dir):
    return metrics.mean_and_std(_results(spark, sf_dir), ["strategy", "mode"], list(MEASURES))


def by_stratum(spark, sf_dir):
    joined = _results(spark, sf_dir).join(_meta(spark, sf_dir), "relation")
    return metrics.mean_by(joined, ["mode", "size_bin", "missing_bin"], ["auroc", "ap"])


def results_with_meta(spark, sf_dir):
    """Every result with its relation's size and missing bins; results of rare relations stay, with nulls."""
    meta = _meta(spark, sf_dir).withColumnRenamed("relation", "meta_relation")
    joined = _results(spark, sf_dir).join(meta, F.col("relation") == F.col("meta_relation"), "left").drop("meta_relation")
    return joined.select("relation", "strategy", "mode", "auroc", "ap", "n_pairs", "pct_missing", "size_bin", "missing_bin")


#: Readable names of modes; others keep their own.
MODE_NAMES = {"drug_1": "first drug", "drug_2": "second drug"}


def protocol_table(spark, sf_dir):
    """Mean AUROC of every mode by strategy, and how much the random split flatters it; sorted by name."""
    p = metrics.pivot_mean(_results(spark, sf_dir), ["mode"], "strategy", list(STRATEGIES), "auroc")
    names = F.create_map(*(F.lit(x) for pair in MODE_NAMES.items() for x in pair))
    means = [F.round(F.col(c) + 1e-9, 4).alias(c) for c in STRATEGIES]
    return p.select(F.coalesce(names[F.col("mode")], F.col("mode")).alias("name"), *means, F.round(F.col("random_pair") - F.col("drug_cold_start") + 1e-9, 4).alias("inflation")).orderBy("name")


def strong_slices(spark, sf_dir):
    """Results of one slice: cold start, both drugs, at least 0.5 AUROC and two positives; best first, then by relation."""
    wanted = (F.col("strategy") == "drug_cold_start") & (F.col("mode") == "both") & (F.col("auroc") >= 0.5) & (F.col("n_pos") >= 2)
    return _results(spark, sf_dir).filter(wanted).select("relation", "auroc", "ap").orderBy(F.desc("auroc"), "relation")


def known_endpoints(spark, sf_dir):
    """Validation and test rows of which both drugs stand in the train fold of their strategy."""
    r = g.split_records(spark, sf_dir)
    seen = r.filter("fold = 'train'").select("strategy", F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    held = r.filter("fold <> 'train'")
    for c in ("drug_1", "drug_2"):
        held = held.join(seen.withColumnRenamed("drug", c), ["strategy", c], "left_semi")
    return held.select("row_id", "strategy", "fold")


def ablation_table(spark, sf_dir):
    return metrics.mean_by(_results(spark, sf_dir), ["mode", "strategy"], list(MEASURES))


def leaderboard_top10(spark, sf_dir):
    """The ten best configurations by mean AUROC."""
    means = metrics.mean_by(_results(spark, sf_dir), ["strategy", "mode"], ["auroc", "ap"])
    return means.orderBy(F.desc("auroc"), F.desc("ap"), "strategy", "mode").limit(10)


def pivot_delta(spark, sf_dir):
    """Mean gain of scoring by both drugs over the first, per strategy, over relations."""
    p = metrics.pivot_mean(_results(spark, sf_dir), ["strategy", "relation"], "mode", list(MODES), "ap")
    return p.withColumn("delta", F.col("both") - F.col("drug_1")).groupBy("strategy").agg(F.count("delta").alias("n_relations"), F.round(F.avg("delta") + 1e-9, 4).alias("mean_delta"), F.round(F.max("delta"), 4).alias("max_delta"), F.round(F.min("delta"), 4).alias("min_delta"))


def pivot_inflation(spark, sf_dir):
    """How much the random split flatters against the cold start, per mode and relation."""
    p = metrics.pivot_mean(_results(spark, sf_dir), ["mode", "relation"], "strategy", list(STRATEGIES), "auroc")
    return p.select("mode", "relation", *STRATEGIES, F.round(F.col("random_pair") - F.col("drug_cold_start"), 4).alias("inflation")).filter("inflation IS NOT NULL")


def heatmap_strata(spark, sf_dir):
    """Size bins by missing bins; all cells of both domains stand in the result."""
    order = ["high", "medium", "low", "very_low"]
    joined = _results(spark, sf_dir).join(_meta(spark, sf_dir), "relation")
    p = metrics.pivot_mean(joined, ["size_bin"], "missing_bin", order, "auroc")
    domain = spark.createDataFrame([(b,) for b in order], "size_bin string")
    return domain.join(p, "size_bin", "left").select("size_bin", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in order))


def representative_table(spark, sf_dir):
    """Results of the five largest relations, with their names."""
    top = g.frequent_triples(spark, sf_dir, MIN_PAIRS).groupBy("relation").agg(F.count(F.lit(1)).alias("n_pairs")).orderBy(F.desc("n_pairs"), "relation").limit(5)
    named = top.join(g.relation_names(spark, sf_dir), "relation", "left")
    return _results(spark, sf_dir).join(named, "relation").select("relation", "relation_name", "n_pairs", "strategy", "mode", "auroc", "ap").orderBy(F.desc("n_pairs"), "relation", "strategy", "mode")


def queries() -> dict:
    fs = (metrics_by_group, threshold_metrics, regime_metrics, roc_pr_points, best_f1_threshold, class_ratio, adaptive_sizes, quartile_strata, results_table, results_summary, results_with_meta, protocol_table, strong_slices, known_endpoints, by_stratum, ablation_table, leaderboard_top10, pivot_delta, pivot_inflation, heatmap_strata, representative_table)
    return {f.__name__: f for f in fs}


_SCORED = """tr AS (SELECT strategy, label, drug_1 AS drug FROM recs WHERE fold = 'train' UNION ALL SELECT strategy, label, drug_2 FROM recs WHERE fold = 'train'),
    rt AS (SELECT strategy, drug, (sum(label) + 1e0) / (count(*) + 2) AS rate FROM tr GROUP BY strategy, drug), hd AS (SELECT DISTINCT drug FROM tgt),
    ev AS (SELECT r.strategy, r.relation, r.label, coalesce(a.rate, 0.5e0) AS r1, coalesce(b.rate, 0.5e0) AS r2,
           CASE WHEN x.drug IS NOT NULL AND y.drug IS NOT NULL THEN 'both_have' WHEN x.drug IS NOT NULL OR y.drug IS NOT NULL THEN 'one_has' ELSE 'neither_has' END AS regime
           FROM recs r LEFT JOIN rt a ON a.strategy = r.strategy AND a.drug = r.drug_1 LEFT JOIN rt b ON b.strategy = r.strategy AND b.drug = r.drug_2
           LEFT JOIN hd x ON x.drug = r.drug_1 LEFT JOIN hd y ON y.drug = r.drug_2 WHERE r.fold IN ('val', 'test')),
    sc AS (SELECT strategy, relation, regime, label, 'drug_1' AS mode, round(r1, 6) AS score FROM ev UNION ALL SELECT strategy, relation, regime, label, 'drug_2', round(r2, 6) FROM ev
           UNION ALL SELECT strategy, relation, regime, label, 'both', round((r1 + r2) / 2, 6) FROM ev)"""


def _levels(by: str, name: str = "lv") -> str:
    return f"""{name} AS (SELECT *, sum(tp) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp, sum(fp) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp,
        sum(tp) OVER (PARTITION BY {by}) AS p, sum(fp) OVER (PARTITION BY {by}) AS n FROM (SELECT {by}, score, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM sc GROUP BY {by}, score))"""


def _rank(by: str) -> str:
    return f"""SELECT {by}, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(fp * (ctp - tp / 2e0)) / nullif(max(p) * max(n), 0), 4) END AS auroc,
        CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(tp * CAST(ctp AS DOUBLE) / (ctp + cfp)) / nullif(max(p), 0), 4) END AS ap FROM lv GROUP BY {by}"""


def _threshold(by: str) -> str:
    tp, fp, fn = (f"count(*) FILTER ({c})" for c in ("score >= 0.5e0 AND label = 1", "score >= 0.5e0 AND label = 0", "score < 0.5e0 AND label = 1"))
    safe = lambda a, b: f"CASE WHEN count(DISTINCT label) = 2 THEN round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0e0), 4) END"
    return f"SELECT {by}, {safe(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS f1, {safe(tp, f'({tp} + {fp})')} AS precision, {safe(tp, f'({tp} + {fn})')} AS recall FROM sc GROUP BY {by}"


_BY = "strategy, mode, relation"
_RES = f"{_SCORED}, {_levels(_BY)}, rk AS ({_rank(_BY)}), th AS ({_threshold(_BY)}), res AS (SELECT * FROM rk JOIN th USING ({_BY}) WHERE auroc IS NOT NULL)"


def _strata_sql() -> str:
    name = lambda c: f"CASE WHEN {c} > (SELECT quantile_cont({c}, 0.75) FROM mt) THEN 'high' WHEN {c} > (SELECT quantile_cont({c}, 0.5) FROM mt) THEN 'medium' WHEN {c} > (SELECT quantile_cont({c}, 0.25) FROM mt) THEN 'low' ELSE 'very_low' END"
    return f"""{frequent(MIN_PAIRS)}, {ENDS}, dd AS (SELECT DISTINCT relation, drug FROM ends),
        mt AS (SELECT relation, n_pairs, pct_missing FROM (SELECT relation, round(count(*) FILTER (drug NOT IN (SELECT drug FROM tgt)) * 100e0 / count(*), 2) AS pct_missing FROM dd GROUP BY relation)
               JOIN (SELECT relation, count(*) AS n_pairs FROM freq GROUP BY relation) USING (relation)),
        st AS (SELECT *, {name("n_pairs")} AS size_bin, {name("pct_missing")} AS missing_bin FROM mt)"""


def oracle_sql() -> dict[str, str]:
    v, sm = "recs tgt", "strategy, mode"
    means = ", ".join(f"round(avg({m}) + 1e-9, 4) AS {m}" for m in MEASURES)
    pivot = lambda col, values, m: ", ".join(f"avg({m}) FILTER ({col} = '{x}') AS {x}" for x in values)
    order = ("high", "medium", "low", "very_low")
    both = f"{_RES}, {_strata_sql()}, js AS (SELECT * FROM res JOIN st USING (relation))"
    return {
        "metrics_by_group": with_views(v, f"{_SCORED}, {_levels(sm)} {_rank(sm)}"),
        "threshold_metrics": with_views(v, f"{_SCORED} {_threshold(sm)}"),
        "regime_metrics": with_views(v, f"{_SCORED}, {_levels(sm + ', regime')}, rk AS ({_rank(sm + ', regime')}) SELECT * FROM rk WHERE n_pos + n_neg >= 10 AND auroc IS NOT NULL"),
        "roc_pr_points": with_views(v, f"{_SCORED}, {_levels(sm)} SELECT strategy, mode, score, round(cfp / CAST(n AS DOUBLE), 6) AS fpr, round(ctp / CAST(p AS DOUBLE), 6) AS tpr, round(ctp / CAST(ctp + cfp AS DOUBLE), 6) AS precision FROM lv WHERE p > 0 AND n > 0"),
        "best_f1_threshold": with_views(v, f"{_SCORED}, {_levels(sm)}, f AS (SELECT strategy, mode, score, round(2e0 * ctp / (ctp + cfp + p), 6) AS f1 FROM lv WHERE p > 0) SELECT strategy, mode, score AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY strategy, mode ORDER BY f1 DESC, score) AS k FROM f) WHERE k = 1"),
        "class_ratio": with_views("recs", "SELECT strategy, relation, count(*) FILTER (label = 1) AS n_pos, round(count(*) FILTER (label = 0) / CAST(greatest(count(*) FILTER (label = 1), 1) AS DOUBLE), 6) AS ratio FROM recs WHERE fold = 'train' GROUP BY strategy, relation"),
        "adaptive_sizes": with_views(
            "recs",
            """d AS (SELECT strategy, relation, drug_1 AS drug FROM recs WHERE fold = 'train' UNION SELECT strategy, relation, drug_2 FROM recs WHERE fold = 'train'),
            n AS (SELECT strategy, relation, count(*) AS n_train FROM recs WHERE fold = 'train' GROUP BY 1, 2), m AS (SELECT strategy, relation, count(*) AS n_drugs FROM d GROUP BY 1, 2)
            SELECT strategy, relation, n_train, n_drugs, least(128, greatest(1, n_drugs // 10), greatest(1, n_drugs - 1)) AS rank, greatest(7, least(63, n_train // 50)) AS num_leaves, greatest(5, least(20, n_train // 30)) AS min_child FROM n JOIN m USING (strategy, relation)""",
        ),
        "quartile_strata": with_views("triples tgt", f"{_strata_sql()} SELECT * FROM st"),
        "results_table": with_views(v, f"{_RES} SELECT * FROM res"),
        "results_summary": with_views(v, f"{_RES} SELECT strategy, mode, count(*) AS n_rows, {', '.join(f'round(avg({m}) + 1e-9, 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_std' for m in MEASURES)} FROM res GROUP BY 1, 2"),
        "results_with_meta": with_views("recs tgt triples", f"{_RES}, {_strata_sql()} SELECT relation, strategy, mode, auroc, ap, n_pairs, pct_missing, size_bin, missing_bin FROM res LEFT JOIN st USING (relation)"),
        "protocol_table": with_views(v, f"""{_RES}, p AS (SELECT mode, {pivot('strategy', STRATEGIES, 'auroc')} FROM res GROUP BY 1) SELECT CASE mode {' '.join(f"WHEN '{m}' THEN '{n}'" for m, n in MODE_NAMES.items())} ELSE mode END AS name,
            {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in STRATEGIES)}, round(random_pair - drug_cold_start + 1e-9, 4) AS inflation FROM p"""),
        "strong_slices": with_views(v, f"{_RES} SELECT relation, auroc, ap FROM res WHERE strategy = 'drug_cold_start' AND mode = 'both' AND auroc >= 0.5 AND n_pos >= 2"),
        "known_endpoints": with_views("recs", """s AS (SELECT strategy, drug_1 AS drug FROM recs WHERE fold = 'train' UNION SELECT strategy, drug_2 FROM recs WHERE fold = 'train')
            SELECT row_id, strategy, fold FROM recs r WHERE fold <> 'train' AND EXISTS (SELECT 1 FROM s WHERE s.strategy = r.strategy AND s.drug = drug_1) AND EXISTS (SELECT 1 FROM s WHERE s.strategy = r.strategy AND s.drug = drug_2)"""),
        "by_stratum": with_views("recs tgt triples", f"{both} SELECT mode, size_bin, missing_bin, round(avg(auroc) + 1e-9, 4) AS auroc, round(avg(ap) + 1e-9, 4) AS ap FROM js GROUP BY 1, 2, 3"),
        "ablation_table": with_views(v, f"{_RES} SELECT mode, strategy, {means} FROM res GROUP BY 1, 2"),
        "leaderboard_top10": with_views(v, f"{_RES} SELECT strategy, mode, round(avg(auroc) + 1e-9, 4) AS auroc, round(avg(ap) + 1e-9, 4) AS ap FROM res GROUP BY 1, 2 ORDER BY auroc DESC, ap DESC, strategy, mode LIMIT 10"),
        "pivot_delta": with_views(v, f"{_RES}, p AS (SELECT strategy, relation, {pivot('mode', MODES, 'ap')} FROM res GROUP BY 1, 2) SELECT strategy, count(both - drug_1) AS n_relations, round(avg(both - drug_1) + 1e-9, 4) AS mean_delta, round(max(both - drug_1), 4) AS max_delta, round(min(both - drug_1), 4) AS min_delta FROM (SELECT strategy, drug_1, \"both\" AS both FROM p) GROUP BY strategy".replace("AS both,", 'AS "both",').replace("(both - drug_1)", '("both" - drug_1)').replace('"both" AS both', '"both"')),
        "pivot_inflation": with_views(v, f"{_RES}, p AS (SELECT mode, relation, {pivot('strategy', STRATEGIES, 'auroc')} FROM res GROUP BY 1, 2) SELECT *, round(random_pair - drug_cold_start, 4) AS inflation FROM p WHERE random_pair - drug_cold_start IS NOT NULL"),
        "heatmap_strata": with_views("recs tgt triples", f"{both}, p AS (SELECT size_bin, {pivot('missing_bin', order, 'auroc')} FROM js GROUP BY 1) SELECT b AS size_bin, {', '.join(f'round({o} + 1e-9, 4) AS {o}' for o in order)} FROM (VALUES ('high'), ('medium'), ('low'), ('very_low')) AS z(b) LEFT JOIN p ON size_bin = b"),
        "representative_table": with_views(
            "recs tgt triples",
            f"""{_RES}, {frequent(MIN_PAIRS)}, top AS (SELECT relation, count(*) AS n_pairs FROM freq GROUP BY relation ORDER BY n_pairs DESC, relation LIMIT 5),
            nm AS (SELECT relation, min(name) AS relation_name FROM (SELECT regexp_replace(upper("Polypharmacy Side Effect"), '[^A-Z0-9]', '', 'g') AS relation, lower(trim("Side Effect Name")) AS name FROM combo) GROUP BY relation)
            SELECT relation, relation_name, n_pairs, strategy, mode, auroc, ap FROM res JOIN top USING (relation) LEFT JOIN nm USING (relation)""",
        ),
    }
