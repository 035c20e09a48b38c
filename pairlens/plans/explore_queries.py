"""Exploration queries: frequency, coverage, degrees, bins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import explore
from pairlens.plans.sql import ENDS, frequent, with_views
from pairlens.sources import graph_views as g
from pairlens.sources.tables import table

#: Relations with fewer triples are left out.
MIN_PAIRS = 50
SIZE_CUTS, SIZE_NAMES = (400.0, 150.0, 75.0), ("high", "medium", "low", "very_low")
MISSING_CUTS, MISSING_NAMES = (55.0, 41.0), ("high_missing", "medium_missing", "low_missing")


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.frequent_triples(spark, sf_dir, MIN_PAIRS)


def relation_coverage(spark, sf_dir):
    return explore.relation_coverage(_freq(spark, sf_dir), g.targets(spark, sf_dir))


def frequent_relations(spark, sf_dir):
    return _freq(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("n_pairs"))


def relations_by_size(spark, sf_dir):
    """Coverage of the relations, smallest first."""
    return relation_coverage(spark, sf_dir).select("relation", "n_pairs", "pct_missing", "pct_both_missing").orderBy("n_pairs", "relation")


def relation_names(spark, sf_dir):
    counts = frequent_relations(spark, sf_dir)
    return counts.join(g.relation_names(spark, sf_dir), "relation", "left").select("relation", F.coalesce("relation_name", "relation").alias("relation_name"), "n_pairs")


def dataset_summary(spark, sf_dir):
    t, tg, mo, net = _freq(spark, sf_dir), g.targets(spark, sf_dir), g.mono(spark, sf_dir), g.ppi(spark, sf_dir)
    drugs = explore.flag_members(explore.endpoints(t, []).distinct(), "drug", tg.select("drug"), "has_target")
    genes = net.select(F.explode(F.array("gene_1", "gene_2")).alias("gene"))
    one = lambda df, **cols: df.agg(*(c.alias(n) for n, c in cols.items()))
    parts = [
        one(t, n_triples=F.count(F.lit(1)), n_relations=F.count_distinct("relation"), n_pairs=F.count_distinct("drug_1", "drug_2")),
        one(drugs, n_drugs=F.count(F.lit(1)), n_drugs_with_target=F.count_if("has_target")),
        one(tg, n_target_rows=F.count(F.lit(1)), n_target_genes=F.count_distinct("gene")),
        one(mo, n_mono_rows=F.count(F.lit(1)), n_mono_effects=F.count_distinct("mono_se"), n_mono_drugs=F.count_distinct("drug")),
        one(net, n_edges=F.count(F.lit(1)), n_self_edges=F.count_if(F.col("gene_1") == F.col("gene_2"))),
        one(genes, n_genes=F.count_distinct("gene")),
    ]
    rows = [explore.key_values(p) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def relation_describe(spark, sf_dir):
    return explore.describe(frequent_relations(spark, sf_dir), "n_pairs")


def degree_stats(spark, sf_dir):
    d = explore.degrees(_freq(spark, sf_dir))
    return d.agg(F.count(F.lit(1)).alias("n_drugs"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.median("degree").alias("median_degree"), F.max("degree").alias("max_degree"))


def relations_per_pair(spark, sf_dir):
    return explore.relations_per_pair(g.triples(spark, sf_dir))


def size_bins(spark, sf_dir):
    return frequent_relations(spark, sf_dir).groupBy(explore.fixed_bins(F.col("n_pairs"), SIZE_CUTS, SIZE_NAMES).alias("size_bin")).agg(F.count(F.lit(1)).alias("n_relations"), F.sum("n_pairs").alias("n_pairs"))


def missing_bins(spark, sf_dir):
    c = relation_coverage(spark, sf_dir)
    return c.groupBy(explore.fixed_bins(F.col("pct_missing"), MISSING_CUTS, MISSING_NAMES).alias("missing_bin")).agg(F.count(F.lit(1)).alias("n_relations"), F.round(F.avg("pct_missing"), 4).alias("mean_pct_missing"))


def target_regime_counts(spark, sf_dir):
    return explore.regime_of_pairs(_freq(spark, sf_dir), g.targets(spark, sf_dir)).groupBy("relation", "regime").agg(F.count(F.lit(1)).alias("n_pairs"))


def endpoint_setops(spark, sf_dir):
    """Sizes of the union, intersection and differences of the drug sets."""
    drugs = explore.endpoints(g.triples(spark, sf_dir), []).distinct().withColumn("in_triples", F.lit(1))
    with_target = g.targets(spark, sf_dir).select("drug").distinct().withColumn("in_targets", F.lit(1))
    both = drugs.join(with_target, "drug", "full_outer")
    a, b = F.col("in_triples").isNotNull(), F.col("in_targets").isNotNull()
    return explore.key_values(both.agg(F.count(F.lit(1)).alias("union"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_triples"), F.count_if(~a & b).alias("only_targets")))


def hist_pairs(spark, sf_dir):
    return explore.histogram(frequent_relations(spark, sf_dir), "n_pairs", 0, 1200, 60)


def hist_log_degree(spark, sf_dir):
    d = explore.degrees(_freq(spark, sf_dir)).withColumn("log_degree", F.log10("degree"))
    return explore.histogram(d, "log_degree", 0, 5, 40)


def smiles_coverage(spark, sf_dir):
    drugs = explore.endpoints(_freq(spark, sf_dir), []).distinct()
    flagged = explore.flag_members(explore.flag_members(drugs, "drug", g.smiles(spark, sf_dir).select("drug"), "s"), "drug", g.targets(spark, sf_dir).select("drug"), "t")
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 2)
    return flagged.agg(F.count(F.lit(1)).alias("n_drugs"), F.count_if("s").alias("n_smiles"), share(F.col("s")).alias("pct_smiles"), F.count_if("t").alias("n_target"), share(F.col("t")).alias("pct_target"))


def drug_numbers(spark, sf_dir):
    """The number in each drug id (without CID and the form digit); 0 where there is none."""
    s = table(spark, sf_dir, "smiles").select("STITCH").dropna().distinct()
    return s.select(F.col("STITCH").alias("stitch"), F.coalesce(F.nullif(F.regexp_extract(F.replace("STITCH", F.lit("CID"), F.lit("")), "^.([0-9]{1,18})$", 1), F.lit("")).cast("bigint"), F.lit(0)).alias("number"))


def queries() -> dict:
    fs = (relation_coverage, frequent_relations, relations_by_size, relation_names, dataset_summary, relation_describe, degree_stats, relations_per_pair, size_bins, missing_bins, target_regime_counts, endpoint_setops, hist_pairs, hist_log_degree, smiles_coverage, drug_numbers)
    return {f.__name__: f for f in fs}


_COVERAGE = f"""{ENDS},
    d AS (SELECT DISTINCT relation, drug FROM ends),
    pd AS (SELECT relation, count(*) AS n_drugs, count(*) FILTER (drug NOT IN (SELECT drug FROM tgt)) AS n_missing FROM d GROUP BY relation),
    pp AS (SELECT relation, count(*) AS n_pairs, count(*) FILTER (drug_1 NOT IN (SELECT drug FROM tgt) AND drug_2 NOT IN (SELECT drug FROM tgt)) AS n_both_missing FROM freq GROUP BY relation),
    cov AS (SELECT relation, n_drugs, n_missing, round(n_missing * 100e0 / n_drugs, 2) AS pct_missing, n_pairs, n_both_missing, round(n_both_missing * 100e0 / n_pairs, 2) AS pct_both_missing FROM pd JOIN pp USING (relation))"""


def oracle_sql() -> dict[str, str]:
    f = frequent(MIN_PAIRS)
    rel = f"{f}, r AS (SELECT relation, count(*) AS n_pairs FROM freq GROUP BY relation)"
    deg = f"{f}, {ENDS}, g AS (SELECT drug, count(*) AS degree FROM ends GROUP BY drug)"
    bins = lambda v, cuts, names: "CASE " + " ".join(f"WHEN {v} > {c} THEN '{n}'" for c, n in zip(cuts, names, strict=False)) + f" ELSE '{names[-1]}' END"
    bucket = lambda x, hi, n: f"CAST(CASE WHEN {x} < 0 THEN 0 WHEN {x} >= {hi} THEN {n + 1} ELSE floor({x} * {n} / {hi}e0) + 1 END AS BIGINT)"
    summary = """
        SELECT 'n_triples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM freq UNION ALL SELECT 'n_relations', count(DISTINCT relation) FROM freq
        UNION ALL SELECT 'n_pairs', count(DISTINCT drug_1 || drug_2) FROM freq UNION ALL SELECT 'n_drugs', count(DISTINCT drug) FROM ends
        UNION ALL SELECT 'n_drugs_with_target', count(DISTINCT drug) FROM ends WHERE drug IN (SELECT drug FROM tgt)
        UNION ALL SELECT 'n_target_rows', count(*) FROM tgt UNION ALL SELECT 'n_target_genes', count(DISTINCT gene) FROM tgt
        UNION ALL SELECT 'n_mono_rows', count(*) FROM mon UNION ALL SELECT 'n_mono_effects', count(DISTINCT mono_se) FROM mon UNION ALL SELECT 'n_mono_drugs', count(DISTINCT drug) FROM mon
        UNION ALL SELECT 'n_edges', count(*) FROM net UNION ALL SELECT 'n_self_edges', count(*) FROM net WHERE gene_1 = gene_2
        UNION ALL SELECT 'n_genes', count(DISTINCT x) FROM (SELECT gene_1 AS x FROM net UNION ALL SELECT gene_2 FROM net)"""
    return {
        "relation_coverage": with_views("triples tgt", f"{f}, {_COVERAGE} SELECT * FROM cov"),
        "relations_by_size": with_views("triples tgt", f"{f}, {_COVERAGE} SELECT relation, n_pairs, pct_missing, pct_both_missing FROM cov"),
        "frequent_relations": with_views("triples", f"{rel} SELECT * FROM r"),
        "relation_names": with_views(
            "triples",
            f"""{rel}, n AS (SELECT relation, min(name) AS name FROM (SELECT regexp_replace(upper("Polypharmacy Side Effect"), '[^A-Z0-9]', '', 'g') AS relation, lower(trim("Side Effect Name")) AS name FROM combo) GROUP BY relation)
            SELECT r.relation, coalesce(name, r.relation) AS relation_name, n_pairs FROM r LEFT JOIN n USING (relation)""",
        ),
        "dataset_summary": with_views("triples tgt mon net", f"{f}, {ENDS} {summary}"),
        "relation_describe": with_views(
            "triples",
            f"""{rel} SELECT count(*) AS n, round(avg(n_pairs), 6) AS mean, round(stddev_samp(n_pairs), 6) AS std, CAST(min(n_pairs) AS DOUBLE) AS min,
            {", ".join(f"round(quantile_cont(n_pairs, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")))}, CAST(max(n_pairs) AS DOUBLE) AS max FROM r""",
        ),
        "degree_stats": with_views("triples", f"{deg} SELECT count(*) AS n_drugs, round(avg(degree), 6) AS mean_degree, median(degree) AS median_degree, max(degree) AS max_degree FROM g"),
        "relations_per_pair": with_views("triples", "SELECT n_relations, count(*) AS n_pairs FROM (SELECT count(DISTINCT relation) AS n_relations FROM triples GROUP BY drug_1, drug_2) GROUP BY n_relations"),
        "size_bins": with_views("triples", f"{rel} SELECT {bins('n_pairs', SIZE_CUTS, SIZE_NAMES)} AS size_bin, count(*) AS n_relations, CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM r GROUP BY 1"),
        "missing_bins": with_views("triples tgt", f"{f}, {_COVERAGE} SELECT {bins('pct_missing', MISSING_CUTS, MISSING_NAMES)} AS missing_bin, count(*) AS n_relations, round(avg(pct_missing), 4) AS mean_pct_missing FROM cov GROUP BY 1"),
        "target_regime_counts": with_views(
            "triples tgt",
            f"""{f}, h AS (SELECT DISTINCT drug FROM tgt)
            SELECT relation, CASE WHEN a.drug IS NOT NULL AND b.drug IS NOT NULL THEN 'both_have' WHEN a.drug IS NOT NULL OR b.drug IS NOT NULL THEN 'one_has' ELSE 'neither_has' END AS regime, count(*) AS n_pairs
            FROM freq LEFT JOIN h a ON a.drug = drug_1 LEFT JOIN h b ON b.drug = drug_2 GROUP BY 1, 2""",
        ),
        "endpoint_setops": with_views(
            "triples tgt",
            """x AS (SELECT drug_1 AS drug FROM triples UNION SELECT drug_2 FROM triples), y AS (SELECT DISTINCT drug FROM tgt)
            SELECT 'union' AS metric, CAST(count(*) AS DOUBLE) AS value FROM (FROM x UNION FROM y) UNION ALL SELECT 'both', count(*) FROM (FROM x INTERSECT FROM y)
            UNION ALL SELECT 'only_triples', count(*) FROM (FROM x EXCEPT FROM y) UNION ALL SELECT 'only_targets', count(*) FROM (FROM y EXCEPT FROM x)""",
        ),
        "hist_pairs": with_views("triples", f"{rel} SELECT {bucket('n_pairs', 1200, 60)} AS bin, count(*) AS n FROM r GROUP BY 1"),
        "hist_log_degree": with_views("triples", f"{deg} SELECT {bucket('log10(degree)', 5, 40)} AS bin, count(*) AS n FROM g GROUP BY 1"),
        "smiles_coverage": with_views(
            "triples tgt smi",
            f"""{f}, {ENDS}, d AS (SELECT DISTINCT drug FROM ends), y AS (SELECT drug IN (SELECT drug FROM smi) AS s, drug IN (SELECT drug FROM tgt) AS t FROM d)
            SELECT count(*) AS n_drugs, count(*) FILTER (s) AS n_smiles, round(avg(CAST(s AS INT)) * 100, 2) AS pct_smiles, count(*) FILTER (t) AS n_target, round(avg(CAST(t AS INT)) * 100, 2) AS pct_target FROM y""",
        ),
        "drug_numbers": "SELECT DISTINCT STITCH AS stitch, coalesce(CAST(nullif(regexp_extract(replace(STITCH, 'CID', ''), '^.([0-9]{1,18})$', 1), '') AS BIGINT), 0) AS number FROM smiles WHERE STITCH IS NOT NULL",
    }
