"""Queries on edges, entity indexes, vector methods and message passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions.hashing import sorted_index
from pairlens.operators import graph, pairops, splitting
from pairlens.plans import result_queries
from pairlens.plans.explore_queries import MIN_PAIRS
from pairlens.plans.sql import frequent, with_views
from pairlens.sources import graph_views as g
from pairlens.sources.tables import table

METHOD = "graph_svd"
#: Edges that one round of training on the graph takes.
MAX_EDGES = 50_000
#: Leading characters of a drug id that name a cell of the sorted order.
ID_PREFIX = 7


def _freq(spark, sf_dir):
    return g.frequent_triples(spark, sf_dir, MIN_PAIRS)


def edge_split(spark, sf_dir):
    """All triples as one set: 90 % train, of these the last tenth validation, the rest test."""
    return splitting.random_edges(_freq(spark, sf_dir))


def edge_subsample(spark, sf_dir):
    """The edges of one training round: the first ``MAX_EDGES`` in hashed order."""
    return splitting.first_edges(_freq(spark, sf_dir), MAX_EDGES)


def triple_index(spark, sf_dir):
    """Triples by dense ids of their drugs and relations, both in sorted order from 0."""
    t = _freq(spark, sf_dir)
    drugs = sorted_index(t.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct(), "drug", ID_PREFIX, "id")
    relations = sorted_index(t.select("relation").distinct(), "relation", 3, "relation_id")
    heads, tails = (drugs.select(F.col("drug").alias(f"drug_{i}"), F.col("id").alias(n)) for i, n in ((1, "head_id"), (2, "tail_id")))
    return t.join(heads, "drug_1").join(tails, "drug_2").join(relations, "relation").select("relation_id", "head_id", "tail_id")


def triple_index_full(spark, sf_dir):
    """The triples by dense ids and, after the last relation, each single-drug effect of a known drug as a self loop of a relation of its own."""
    t = _freq(spark, sf_dir)
    drugs = sorted_index(t.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct(), "drug", ID_PREFIX, "id")
    loops = g.mono(spark, sf_dir).join(drugs, "drug")
    effects = sorted_index(loops.select("mono_se").distinct(), "mono_se", 3, "effect_id")
    n_relations = t.agg(F.count_distinct("relation").alias("n_relations"))
    own = loops.join(effects, "mono_se").join(F.broadcast(n_relations))  # one row
    own = own.select((F.col("effect_id") + F.col("n_relations")).alias("relation_id"), F.col("id").alias("head_id"), F.col("id").alias("tail_id"))
    return triple_index(spark, sf_dir).unionByName(own)


def pair_effect_stats(spark, sf_dir):
    """Side effects per drug pair: number of pairs, mean, largest and smallest."""
    per = g.triples(spark, sf_dir).groupBy("drug_1", "drug_2").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum("n") / F.count(F.lit(1))).alias("mean_effects"), F.max("n").alias("max_effects"), F.min("n").alias("min_effects"))


def relations_by_size(spark, sf_dir):
    """Triples of every frequent relation, smallest first, then by name."""
    return _freq(spark, sf_dir).groupBy("relation").agg(F.count(F.lit(1)).alias("n_pairs")).orderBy("n_pairs", "relation")


def pair_probabilities(spark, sf_dir):
    """The logistic function of each labelled row's vector product, cut to [-30, 30], by method."""
    rows = g.split_records(spark, sf_dir).select("row_id", "drug_1", "drug_2")
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), pairops.dot(F.col("a"), F.col("b"))))
    return pairops.with_vectors(rows, g.method_vectors(spark, sf_dir)).select("row_id", "method", F.round(1 / (1 + F.exp(-x)), 6).alias("probability"))


def vector_report(spark, sf_dir):
    """Per method: vectors, empty and all-zero ones, dimensions, drugs with targets, fit time."""
    e = table(spark, sf_dir, "embedding_result").select("method", "embeddings", "has_target", "fit_time_s")
    zero = ~F.exists("embeddings", lambda x: x != 0)
    n = F.count(F.lit(1))
    pct = lambda c: F.round(F.count_if(c) * 100e0 / n, 2)
    return e.groupBy("method").agg(
        n.alias("n_vectors"),
        F.count_if(F.col("embeddings").isNull()).alias("n_null"),
        F.count_if(zero).alias("n_zero"),
        pct(zero).alias("pct_zero"),
        F.max(F.size("embeddings").cast("bigint")).alias("dims"),
        F.count_if("has_target").alias("n_has_target"),
        pct(F.col("has_target")).alias("pct_has_target"),
        F.round(F.max("fit_time_s"), 4).alias("max_fit_time_s"),
    )


def unit_vectors(spark, sf_dir):
    """Norms before and after scaling each drug's vector to unit length; zero vectors stay zero."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    v = g.method_vectors(spark, sf_dir).withColumn("norm", norm("vector"))
    unit = v.withColumn("unit", F.transform("vector", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)))
    return unit.select("method", "drug", F.round("norm", 6).alias("norm"), F.round(norm("unit"), 6).alias("unit_norm"), (F.round(F.array_max("unit"), 6) + 0.0).alias("largest"))


def relation_messages(spark, sf_dir):
    """One round of message passing over the triples.

    A drug's new vector is its own plus, for each relation, the mean vector of its
    neighbours, with negative values set to zero.
    """
    h = graph.relation_message_round(_freq(spark, sf_dir), g.drug_vectors(spark, sf_dir, METHOD), 64)
    active = F.size(F.filter("vector", lambda x: x > 1e-9)).cast("bigint")
    return h.select("drug", "n_relations", active.alias("n_active"), F.round(F.array_max("vector"), 4).alias("largest"))


def inflation_summary(spark, sf_dir):
    """Mean, largest and smallest inflation of the random split against the cold start, per mode."""
    p = result_queries.pivot_inflation(spark, sf_dir)
    mean = lambda c: (F.sum(F.col(c).cast("decimal(18,6)")).cast("double") / F.count(c)).alias(f"mean_{c}")
    return p.groupBy("mode").agg(F.count(F.lit(1)).alias("n_relations"), mean("inflation"), F.max("inflation").alias("max_inflation"), F.min("inflation").alias("min_inflation"))


def queries() -> dict:
    fs = (edge_split, edge_subsample, triple_index, triple_index_full, pair_effect_stats, relations_by_size, pair_probabilities, vector_report, unit_vectors, relation_messages, inflation_summary)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    freq = frequent(MIN_PAIRS)
    ranked = f"{freq}, r AS (SELECT relation, drug_1, drug_2, row_number() OVER (ORDER BY md5(concat_ws('|', relation, drug_1, drug_2, '42'))) - 1 AS k, count(*) OVER () AS n FROM freq)"
    v = f"v AS (SELECT drug, vector FROM vecs WHERE method = '{METHOD}')"
    norm = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))".format
    unit = "CASE WHEN norm > 0 THEN list_transform(vector, lambda x: x / norm) ELSE vector END"
    zero = "len(list_filter(embeddings, lambda x: x <> 0)) = 0"
    return {
        "edge_split": with_views(
            "triples",
            f"""{ranked}, c AS (SELECT *, floor(n * 0.9e0) AS n_train, floor(floor(n * 0.9e0) * 0.1e0) AS n_val FROM r)
            SELECT relation, drug_1, drug_2, CASE WHEN k < n_train - n_val THEN 'train' WHEN k < n_train THEN 'val' ELSE 'test' END AS fold FROM c""",
        ),
        "edge_subsample": with_views("triples", f"{ranked} SELECT relation, drug_1, drug_2 FROM r WHERE k < {MAX_EDGES}"),
        "triple_index": with_views(
            "triples",
            f"""{freq}, d AS (SELECT drug, row_number() OVER (ORDER BY drug) - 1 AS id FROM (SELECT drug_1 AS drug FROM freq UNION SELECT drug_2 FROM freq)),
            s AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM freq))
            SELECT s.id AS relation_id, a.id AS head_id, b.id AS tail_id FROM freq f JOIN d a ON a.drug = f.drug_1 JOIN d b ON b.drug = f.drug_2 JOIN s ON s.relation = f.relation""",
        ),
        "triple_index_full": with_views(
            "triples mon",
            f"""{freq}, d AS (SELECT drug, row_number() OVER (ORDER BY drug) - 1 AS id FROM (SELECT drug_1 AS drug FROM freq UNION SELECT drug_2 FROM freq)),
            s AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM freq)),
            l AS (SELECT mono_se, id FROM mon JOIN d USING (drug)), m AS (SELECT mono_se, row_number() OVER (ORDER BY mono_se) - 1 AS effect_id FROM (SELECT DISTINCT mono_se FROM l))
            SELECT s.id AS relation_id, a.id AS head_id, b.id AS tail_id FROM freq f JOIN d a ON a.drug = f.drug_1 JOIN d b ON b.drug = f.drug_2 JOIN s ON s.relation = f.relation
            UNION ALL SELECT effect_id + (SELECT count(*) FROM s), id, id FROM l JOIN m USING (mono_se)""",
        ),
        "pair_effect_stats": with_views("triples", "p AS (SELECT count(*) AS n FROM triples GROUP BY drug_1, drug_2) SELECT count(*) AS n_pairs, CAST(sum(n) AS DOUBLE) / count(*) AS mean_effects, max(n) AS max_effects, min(n) AS min_effects FROM p"),
        "relations_by_size": with_views("triples", f"{freq} SELECT relation, count(*) AS n_pairs FROM freq GROUP BY relation ORDER BY n_pairs, relation"),
        "pair_probabilities": with_views(
            "recs vecs",
            """s AS (SELECT row_id, x.method, list_sum(list_transform(list_zip(x.vector, y.vector), lambda p: p[1] * p[2])) AS z FROM recs JOIN vecs x ON x.drug = drug_1 JOIN vecs y ON y.drug = drug_2 AND y.method = x.method)
            SELECT row_id, method, round(1 / (1 + exp(-greatest(-30e0, least(30e0, z)))), 6) AS probability FROM s""",
        ),
        "vector_report": f"""SELECT method, count(*) AS n_vectors, count(*) FILTER (embeddings IS NULL) AS n_null, count(*) FILTER ({zero}) AS n_zero,
            round(count(*) FILTER ({zero}) * 100e0 / count(*), 2) AS pct_zero, max(len(embeddings)) AS dims, count(*) FILTER (has_target) AS n_has_target,
            round(count(*) FILTER (has_target) * 100e0 / count(*), 2) AS pct_has_target, round(max(fit_time_s), 4) AS max_fit_time_s FROM embedding_result GROUP BY method""",
        "unit_vectors": with_views(
            "vecs",
            f"""n AS (SELECT method, drug, vector, {norm('vector')} AS norm FROM vecs), u AS (SELECT method, drug, norm, {unit} AS unit FROM n)
            SELECT method, drug, round(norm, 6) AS norm, round({norm('unit')}, 6) AS unit_norm, round(list_max(unit), 6) + 0e0 AS largest FROM u""",
        ),
        "relation_messages": with_views(
            "triples vecs",
            f"""{freq}, {v}, e AS (SELECT relation, drug_1 AS drug, drug_2 AS other FROM freq UNION SELECT relation, drug_2, drug_1 FROM freq),
            m AS (SELECT e.drug, e.relation, i, avg(v.vector[i]) AS x FROM e JOIN v ON v.drug = e.other, range(1, 65) AS r(i) GROUP BY e.drug, e.relation, i),
            s AS (SELECT drug, i, count(*) AS n, sum(x) AS x FROM m GROUP BY drug, i),
            h AS (SELECT s.drug, s.n, greatest(s.x + coalesce(v.vector[s.i], 0e0), 0e0) AS x FROM s LEFT JOIN v USING (drug))
            SELECT drug, max(n) AS n_relations, count(*) FILTER (x > 1e-9) AS n_active, round(max(x), 4) AS largest FROM h GROUP BY drug""",
        ),
        "inflation_summary": f"""SELECT mode, count(*) AS n_relations, CAST(sum(CAST(inflation AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean_inflation,
            max(inflation) AS max_inflation, min(inflation) AS min_inflation FROM ({result_queries.oracle_sql()['pivot_inflation']}) GROUP BY mode""",
    }
