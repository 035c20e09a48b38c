"""Queries on the gene network."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import graph
from pairlens.plans.sql import with_views
from pairlens.plans.worktables import WorkTables
from pairlens.sources import graph_views as g

MIN_SIMILARITY = 0.3


def _per_drug(sums):
    """Rounded summary of each drug's profile."""
    return sums.select("drug", "n_genes", F.round("total", 4).alias("total"), F.round("largest", 6).alias("largest"))


def graph_degree_norm(spark, sf_dir):
    w = graph.row_normalised(g.ppi(spark, sf_dir))
    return w.groupBy(F.col("src").alias("gene")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("w"), 6).alias("row_sum"), F.round(F.max("w"), 6).alias("weight"))


def sym_norm_adjacency(spark, sf_dir):
    return graph.symmetric_normalised(g.ppi(spark, sf_dir)).select("src", "dst", F.round("w", 8).alias("w"))


def target_profiles(spark, sf_dir):
    """Targets per drug inside the network; has_target counts targets outside it too."""
    t, net = g.targets(spark, sf_dir), g.ppi(spark, sf_dir)
    inside = graph.target_profiles(t, net).groupBy("drug").agg(F.count(F.lit(1)).alias("n_inside"))
    return t.groupBy("drug").agg(F.count(F.lit(1)).alias("n_targets")).join(inside, "drug", "left").select("drug", "n_targets", F.coalesce("n_inside", F.lit(0)).alias("n_inside"))


def propagate_k2(spark, sf_dir):
    net = g.ppi(spark, sf_dir)
    return _per_drug(graph.propagate(graph.target_profiles(g.targets(spark, sf_dir), net), net, 2, WorkTables(spark, "propagate"), summed=True))


def diffuse_restart(spark, sf_dir):
    net = g.ppi(spark, sf_dir)
    x = graph.target_profiles(g.targets(spark, sf_dir), net)
    return _per_drug(graph.diffuse(x, graph.row_normalised(net), 0.85, 0.15, 2, WorkTables(spark, "diffuse"), summed=True))


def rwr_fixed_iters(spark, sf_dir):
    """Two rounds of the random walk with restart on the symmetric-normalised network."""
    net = g.ppi(spark, sf_dir)
    x = graph.target_profiles(g.targets(spark, sf_dir), net)
    return _per_drug(graph.diffuse(x, graph.symmetric_normalised(net), 0.85, 0.15, 2, WorkTables(spark, "walk"), summed=True))


def mono_incidence(spark, sf_dir):
    """Single-drug effects of the drugs that stand in a triple."""
    t = g.triples(spark, sf_dir)
    drugs = t.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    return g.mono(spark, sf_dir).join(drugs, "drug", "left_semi").groupBy("drug").agg(F.count(F.lit(1)).alias("n_effects"))


def jaccard_pairs(spark, sf_dir):
    return graph.jaccard(g.mono(spark, sf_dir), "drug", "mono_se", MIN_SIMILARITY).select("id_1", "id_2", "shared", F.round("similarity", 6).alias("similarity"))


def tanimoto_edges(spark, sf_dir):
    """Similarity edges between drugs by the targets they share."""
    similar = graph.jaccard(g.targets(spark, sf_dir), "drug", "gene", MIN_SIMILARITY)
    return graph.similarity_edges(similar).select("src", "dst", F.round("weight", 8).alias("weight"))


def block_max_normalise(spark, sf_dir):
    degree = graph.symmetric_edges(g.ppi(spark, sf_dir)).groupBy(F.col("src").alias("gene")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return graph.max_normalise(degree, "x").select("gene", F.round("x", 8).alias("x"))


def embedding_mean_agg(spark, sf_dir):
    """Mean network degree over each drug's targets."""
    net = g.ppi(spark, sf_dir)
    degree = graph.symmetric_edges(net).groupBy(F.col("src").alias("gene")).agg(F.count(F.lit(1)).alias("value"))
    return graph.gene_means(graph.target_profiles(g.targets(spark, sf_dir), net), degree).select("drug", F.round("mean_value", 6).alias("mean_degree"))


def matrix_density(spark, sf_dir):
    """Filled share of the drug by gene incidence."""
    net = g.ppi(spark, sf_dir)
    x = graph.target_profiles(g.targets(spark, sf_dir), net)
    genes = net.select(F.explode(F.array("gene_1", "gene_2")).alias("gene")).agg(F.count_distinct("gene").alias("n_genes"))
    cells = x.agg(F.count(F.lit(1)).alias("n_filled"), F.count_distinct("drug").alias("n_drugs")).join(F.broadcast(genes))  # one row each
    return cells.select("n_drugs", "n_genes", "n_filled", F.round(F.col("n_filled") / (F.col("n_drugs") * F.col("n_genes")), 8).alias("density"))


def queries() -> dict:
    fs = (graph_degree_norm, sym_norm_adjacency, target_profiles, propagate_k2, diffuse_restart, rwr_fixed_iters, mono_incidence, jaccard_pairs, tanimoto_edges, block_max_normalise, embedding_mean_agg, matrix_density)
    return {f.__name__: f for f in fs}


_SYM = "e AS (SELECT gene_1 AS src, gene_2 AS dst FROM net UNION SELECT gene_2, gene_1 FROM net), dg AS (SELECT src, count(*) AS deg FROM e GROUP BY src)"
_ROW = f"{_SYM}, w AS (SELECT e.src, e.dst, 1e0 / deg AS w FROM e JOIN dg USING (src))"
_NORM = """m AS (SELECT gene_1 AS src, gene_2 AS dst FROM net UNION ALL SELECT gene_2, gene_1 FROM net),
    a AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT DISTINCT src, src FROM m) GROUP BY src, dst), ad AS (SELECT src, sum(n) AS deg FROM a GROUP BY src),
    w AS (SELECT a.src, a.dst, n / sqrt(CAST(p.deg AS DOUBLE) * q.deg) AS w FROM a JOIN ad p ON p.src = a.src JOIN ad q ON q.src = a.dst)"""
_X = "x0 AS (SELECT drug, gene, 1e0 AS x FROM tgt WHERE gene IN (SELECT gene_1 FROM net UNION SELECT gene_2 FROM net))"


def _hop(of: str, name: str) -> str:
    return f"{name} AS (SELECT drug, w.src AS gene, sum(x * w) AS x FROM {of} JOIN w ON w.dst = {of}.gene GROUP BY drug, w.src)"


def _step(of: str, name: str) -> str:
    return f"{_hop(of, name + 'h')}, {name} AS (SELECT drug, gene, sum(x) AS x FROM (SELECT drug, gene, x * 0.85e0 AS x FROM {name}h UNION ALL SELECT drug, gene, x * 0.15e0 FROM x0) GROUP BY drug, gene)"


def _sum(of: str) -> str:
    return f"SELECT drug, count(*) AS n_genes, round(sum(x), 4) AS total, round(max(x), 6) AS largest FROM {of} GROUP BY drug"


def _jaccard(view: str, item: str) -> str:
    return f"""n AS (SELECT drug, count(*) AS n FROM {view} GROUP BY drug), sh AS (SELECT a.drug AS id_1, b.drug AS id_2, count(*) AS shared FROM {view} a JOIN {view} b ON a.{item} = b.{item} AND a.drug < b.drug GROUP BY 1, 2),
        sim AS (SELECT id_1, id_2, shared, shared / CAST(p.n + q.n - shared AS DOUBLE) AS similarity FROM sh JOIN n p ON p.drug = id_1 JOIN n q ON q.drug = id_2 WHERE shared / CAST(p.n + q.n - shared AS DOUBLE) >= {MIN_SIMILARITY}e0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "graph_degree_norm": with_views("net", f"{_ROW} SELECT src AS gene, count(*) AS degree, round(sum(w), 6) AS row_sum, round(max(w), 6) AS weight FROM w GROUP BY src"),
        "sym_norm_adjacency": with_views("net", f"{_NORM} SELECT src, dst, round(w, 8) AS w FROM w"),
        "target_profiles": with_views("tgt net", f"{_X} SELECT drug, count(*) AS n_targets, count(*) FILTER (gene IN (SELECT gene_1 FROM net UNION SELECT gene_2 FROM net)) AS n_inside FROM tgt GROUP BY drug"),
        "propagate_k2": with_views("tgt net", f"{_ROW}, {_X}, {_hop('x0', 'x1')}, {_hop('x1', 'x2')} {_sum('x2')}"),
        "diffuse_restart": with_views("tgt net", f"{_ROW}, {_X}, {_step('x0', 'x1')}, {_step('x1', 'x2')} {_sum('x2')}"),
        "rwr_fixed_iters": with_views("tgt net", f"{_NORM}, {_X}, {_step('x0', 'x1')}, {_step('x1', 'x2')} {_sum('x2')}"),
        "mono_incidence": with_views("triples mon", "d AS (SELECT drug_1 AS drug FROM triples UNION SELECT drug_2 FROM triples) SELECT drug, count(*) AS n_effects FROM mon WHERE drug IN (SELECT drug FROM d) GROUP BY drug"),
        "jaccard_pairs": with_views("mon", f"{_jaccard('mon', 'mono_se')} SELECT id_1, id_2, shared, round(similarity, 6) AS similarity FROM sim"),
        "tanimoto_edges": with_views(
            "tgt",
            f"""{_jaccard('tgt', 'gene')}, b AS (SELECT id_1 AS src, id_2 AS dst, similarity FROM sim UNION ALL SELECT id_2, id_1, similarity FROM sim), dd AS (SELECT src, count(*) AS deg FROM b GROUP BY src)
            SELECT b.src, b.dst, round(similarity / (p.deg * q.deg), 8) AS weight FROM b JOIN dd p ON p.src = b.src JOIN dd q ON q.src = b.dst""",
        ),
        "block_max_normalise": with_views("net", f"{_SYM} SELECT src AS gene, round(deg / CAST((SELECT max(deg) FROM dg) AS DOUBLE), 8) AS x FROM dg"),
        "embedding_mean_agg": with_views("tgt net", f"{_SYM}, {_X} SELECT drug, round(avg(deg), 6) AS mean_degree FROM x0 JOIN dg ON dg.src = gene GROUP BY drug"),
        "matrix_density": with_views(
            "tgt net",
            f"""{_X}, gg AS (SELECT gene_1 AS gene FROM net UNION SELECT gene_2 FROM net)
            SELECT count(DISTINCT drug) AS n_drugs, (SELECT count(*) FROM gg) AS n_genes, count(*) AS n_filled, round(count(*) / CAST(count(DISTINCT drug) * (SELECT count(*) FROM gg) AS DOUBLE), 8) AS density FROM x0""",
        ),
    }
