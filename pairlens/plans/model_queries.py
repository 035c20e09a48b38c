"""Queries that fit embeddings and classifiers; checked by rows and by invariants in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import explore, graph, group_models, metrics, models, pairops, reduce, sampling, splitting
from pairlens.plans.explore_queries import MIN_PAIRS
from pairlens.plans.worktables import WorkTables, cached
from pairlens.sources import graph_views as g

DIM = 16
#: Blocks of a drug's features by the method of vectors that fills them, and the width of each.
BLOCKS = {"profile": "graph_svd", "embedding": "pca", "fingerprint": "node2vec"}
WIDTH = 64
MEASURES = ["auroc", "ap", "f1", "precision", "recall"]


def _profiled(spark, sf_dir, tables):
    net = g.ppi(spark, sf_dir)
    return tables.save(graph.target_profiles(g.targets(spark, sf_dir), net), "profiles")


def svd_embedding(spark, sf_dir):
    """Truncated SVD of the two-hop propagated target profiles."""
    net = g.ppi(spark, sf_dir)
    return reduce.filled_svd(graph.target_profiles(g.targets(spark, sf_dir), net), net, 2, DIM, WorkTables(spark, "svd"))


def svd_train_only(spark, sf_dir):
    """The same, fitted on the drugs of the cold-start train fold."""
    train = g.split_records(spark, sf_dir).filter("strategy = 'drug_cold_start' AND fold = 'train'").select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    return reduce.svd_embedding(_profiled(spark, sf_dir, WorkTables(spark, "svd")), "drug", "gene", "x", DIM, train)


def diffused_svd(spark, sf_dir):
    net = g.ppi(spark, sf_dir)
    return reduce.filled_svd(graph.target_profiles(g.targets(spark, sf_dir), net), net, 2, DIM, WorkTables(spark, "svd"), 0.85, 0.15)


def rwr_converged(spark, sf_dir):
    """The random walk with restart until no value changes by 1e-4, at most 30 rounds."""
    net = g.ppi(spark, sf_dir)
    x = graph.settled_sums(graph.target_profiles(g.targets(spark, sf_dir), net), graph.symmetric_normalised(net), 0.85, 0.15, 30, WorkTables(spark, "walk"), 1e-4)
    return x.select("drug", "n_genes", F.round("total", 2).alias("total"))


def pca_embedding(spark, sf_dir):
    return reduce.pca_embedding(g.drug_vectors(spark, sf_dir, "graph_svd"), "drug", "vector", DIM)


def kernel_embedding(spark, sf_dir):
    """Components under a Gaussian kernel, by landmarks."""
    return reduce.kernel_components(g.drug_vectors(spark, sf_dir, "graph_svd"), "drug", "vector", DIM, WorkTables(spark, "kernel"))


def nonnegative_factors(spark, sf_dir):
    """Factors of the single-drug effects."""
    m = g.mono(spark, sf_dir).withColumn("x", F.lit(1.0))
    return reduce.nonnegative_factors(m, "drug", "mono_se", "x", DIM)


def walk_embedding(spark, sf_dir):
    """Mean walk vector of each drug's targets."""
    tables = WorkTables(spark, "walks")
    net = g.ppi(spark, sf_dir)
    genes = tables.save(reduce.walk_embedding(graph.symmetric_edges(net), tables), "genes")
    return reduce.mean_vectors(graph.target_profiles(g.targets(spark, sf_dir), net), genes)


def ridge_coldstart(spark, sf_dir):
    """node2vec vectors of drugs that have none, predicted from their graph_svd vectors."""
    features = g.drug_vectors(spark, sf_dir, "graph_svd").select("drug", F.col("vector").alias("features"))
    known = g.drug_vectors(spark, sf_dir, "node2vec")
    return reduce.ridge_map(features, known, "drug").select("drug", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"), "is_known")


def _split_inputs(sf_dir):
    return [f"{sf_dir}/split_rows.parquet", f"{sf_dir}/embedding_result.parquet"]


def _sharded(spark, sf_dir):
    return group_models.with_shards(g.split_records(spark, sf_dir), ["strategy", "relation"], "row_id")


def _fits(spark, sf_dir):
    """Scores of every model, fitted for each strategy, method of vectors and relation on all its rows; kept in a session."""

    def build():
        features = pairops.pair_features(_sharded(spark, sf_dir), g.method_vectors(spark, sf_dir), "hadamard_absdiff")
        return group_models.group_scores(features, ["strategy", "method", "relation"], ["fold"], list(group_models.MODELS))

    return cached(spark, "fits", _split_inputs(sf_dir), build)


def _fold_metrics(spark, sf_dir, model):
    return metrics.ranking_metrics(_fits(spark, sf_dir).filter(F.col("model") == model), ["strategy", "method", "relation", "fold"])


def gbt_metrics(spark, sf_dir):
    """Boosted trees of each strategy, method and relation, stopped early: metrics by fold."""
    return _fold_metrics(spark, sf_dir, "gbt_stopped")


def mlp_metrics(spark, sf_dir):
    """Perceptrons of three hidden layers of each strategy, method and relation: metrics by fold."""
    return _fold_metrics(spark, sf_dir, "mlp")


def experiment_results(spark, sf_dir):
    """Test metrics of every model, strategy, method and relation with both classes in its test rows."""
    scored, by = _fits(spark, sf_dir).filter("fold = 'test'"), ["model", "strategy", "method", "relation"]
    return metrics.ranking_metrics(scored, by).join(metrics.threshold_metrics(scored, by), by).filter("auroc IS NOT NULL")


def experiment_summary(spark, sf_dir):
    """Mean and deviation over relations; by model, then strategy, best first."""
    means = metrics.mean_and_std(experiment_results(spark, sf_dir), ["model", "strategy", "method"], MEASURES)
    return means.orderBy("model", "strategy", F.desc("auroc_mean"), "method")


def reduction_ablation(spark, sf_dir):
    """Mean test metrics of early-stopped trees by method of the vectors and strategy, best first."""
    fitted = experiment_results(spark, sf_dir).filter("model = 'gbt_stopped'")
    return metrics.mean_and_std(fitted, ["method", "strategy"], ["auroc", "ap"]).orderBy("strategy", F.desc("auroc_mean"), "method")


def model_protocols(spark, sf_dir):
    """Mean AUROC of every model and method under each strategy, and how much the random split flatters it."""
    p = metrics.pivot_mean(experiment_results(spark, sf_dir), ["model", "method"], "strategy", list(splitting.STRATEGIES), "auroc")
    means = [F.round(c, 4).alias(c) for c in splitting.STRATEGIES]
    return p.select("model", "method", *means, F.round(F.col("random_pair") - F.col("drug_cold_start"), 4).alias("inflation")).orderBy("model", "method")


def _pooled(spark, sf_dir, score):
    """Metrics per strategy, relation and fold of one model per strategy over all relations and the vectors of all methods."""
    vectors = pairops.feature_store(g.method_vectors(spark, sf_dir), BLOCKS, WIDTH).select("drug", pairops.feature_mode(*BLOCKS, mode="all").alias("vector"))
    features = WorkTables(spark, "model").save(pairops.pair_features(g.split_records(spark, sf_dir), vectors, "hadamard_absdiff"), "features", dictionary=False)
    parts = [score(features.filter(F.col("strategy") == s), ["strategy", "relation", "fold"], category="relation") for s in splitting.STRATEGIES]
    return metrics.ranking_metrics(_union(parts), ["strategy", "relation", "fold"])


def gbt_multitask(spark, sf_dir):
    """Boosted trees with the relation as a category."""
    return _pooled(spark, sf_dir, models.gbt_scores)


def mlp_multitask(spark, sf_dir):
    """A perceptron with an input for each relation."""
    return _pooled(spark, sf_dir, models.mlp_scores)


def _means(scored, by):
    """Mean metrics over the relations with both classes in the test fold."""
    per = metrics.ranking_metrics(scored.filter("fold = 'test'"), [*by, "relation"]).filter("auroc IS NOT NULL")
    return metrics.mean_and_std(per, by, ["auroc", "ap"])


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def operator_ablation(spark, sf_dir):
    """Mean test metrics of early-stopped trees per relation, for each pair operator, strategy and method."""
    rows, vectors = WorkTables(spark, "ablation").save(_sharded(spark, sf_dir), "rows"), g.method_vectors(spark, sf_dir)
    features = _union([pairops.pair_features(rows, vectors, o).withColumn("operator", F.lit(o)) for o in pairops.OPERATORS])
    by = ["operator", "strategy", "method"]
    return _means(group_models.group_scores(features, [*by, "relation"], ["fold"], ["gbt_stopped"]), by)


def _feature_scores(spark, sf_dir):
    """Scores by feature mode, strategy and target regime; drugs without a block have zeros there."""

    def build():
        store = pairops.feature_store(g.method_vectors(spark, sf_dir), BLOCKS, WIDTH)
        modes = F.array(*(F.struct(F.lit(m).alias("method"), pairops.feature_mode(*BLOCKS, mode=m).alias("vector")) for m in pairops.FEATURE_MODES))
        rows = explore.regime_of_pairs(_sharded(spark, sf_dir), g.targets(spark, sf_dir))
        features = pairops.pair_features(rows, store.select("drug", F.inline(modes)), "hadamard_absdiff").withColumnRenamed("method", "feature_mode")
        return group_models.group_scores(features, ["feature_mode", "strategy", "relation"], ["fold", "regime"], ["gbt_stopped"])

    return cached(spark, "feature-scores", [*_split_inputs(sf_dir), f"{sf_dir}/targets.parquet"], build)


def feature_ablation(spark, sf_dir):
    """Mean test metrics by feature mode, strategy and target regime of early-stopped trees per relation."""
    return _means(_feature_scores(spark, sf_dir), ["feature_mode", "strategy", "regime"])


def feature_delta(spark, sf_dir):
    """Mean gain in AP of both blocks over the embedding alone, per strategy and regime, over relations."""
    per = metrics.ranking_metrics(_feature_scores(spark, sf_dir).filter("fold = 'test'"), ["feature_mode", "strategy", "regime", "relation"])
    p = metrics.pivot_mean(per, ["strategy", "regime", "relation"], "feature_mode", list(pairops.FEATURE_MODES), "ap")
    delta = F.col("`target+fp`") - F.col("target_only")
    return p.groupBy("strategy", "regime").agg(F.count(delta).alias("n_relations"), F.round(F.avg(delta), 4).alias("delta_ap_fp")).orderBy("strategy", "regime")


def negative_ablation(spark, sf_dir):
    """Mean cold-start metrics of the same positives against each kind of negatives, by method of the vectors."""
    t = g.frequent_triples(spark, sf_dir, MIN_PAIRS)
    tables, parts = WorkTables(spark, "ablation"), []
    for kind in sampling.STRATEGIES:
        own = WorkTables(spark, "negatives")
        negatives = tables.save(sampling.sample_negatives(t, kind, tables=own), kind)
        own.clear()
        tables.free()
        parts.append(t.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0))).withColumn("negatives", F.lit(kind)))
    rows = splitting.cold_start_in_place(_union(parts), ["negatives", "relation"], t, tables)  # negatives are made of the drugs of t
    rows = rows.withColumn("place", F.xxhash64("drug_1", "drug_2", "label"))
    rows = rows.withColumn("shard", group_models.shard_of("place", F.col("group_size")))
    scored = group_models.pair_scores(rows, g.method_vectors(spark, sf_dir), ["negatives", "relation"], ["fold"], ["gbt_stopped"])
    return _means(tables.save(scored.filter("fold = 'test'"), "scored"), ["negatives", "method"])


def queries() -> dict:
    fs = (svd_embedding, svd_train_only, diffused_svd, rwr_converged, pca_embedding, kernel_embedding, nonnegative_factors, walk_embedding, ridge_coldstart, gbt_metrics, mlp_metrics, gbt_multitask, mlp_multitask)
    fs += (experiment_results, experiment_summary, reduction_ablation, model_protocols, operator_ablation, feature_ablation, feature_delta, negative_ablation)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {}
