"""Queries of problem 6: most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.neighbors import nearest_vectors
from pairlens.plans import WorkTables
from pairlens.sources import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_vectors(table(spark, sf_dir, "embedding_result"), WorkTables(spark, "neighbors"))
    return near.select(F.least("vec_id", "other_id").alias("vec_id_1"), F.greatest("vec_id", "other_id").alias("vec_id_2")).distinct()


def p6_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of every vector, with rank and cosine."""
    near = nearest_vectors(table(spark, sf_dir, "embedding_result"), WorkTables(spark, "neighbors"))
    return near.select("vec_id", "rank", "other_id", F.round("cosine", 6).alias("cosine"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_neighbors)}


def oracle_sql() -> dict[str, str]:
    """Brute force; at the scales where SQL can do it, the index misses nothing."""
    ranked = """
            WITH v AS (SELECT vec_id, method, CAST(embeddings AS DOUBLE[]) AS e FROM embedding_result WHERE embeddings IS NOT NULL),
            u AS (SELECT vec_id, method, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
            c AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_inner_product(a.e, b.e) / (a.n * b.n), 10) AS cosine FROM u a JOIN u b ON a.method = b.method AND a.vec_id <> b.vec_id),
            s AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) AS k FROM c)"""
    return {
        "p6_found": f"{ranked} SELECT DISTINCT least(i, j) AS vec_id_1, greatest(i, j) AS vec_id_2 FROM s WHERE k <= 5",
        "p6_neighbors": f"{ranked} SELECT i AS vec_id, CAST(k AS INTEGER) AS rank, j AS other_id, round(cosine, 6) AS cosine FROM s WHERE k <= 5",
    }
