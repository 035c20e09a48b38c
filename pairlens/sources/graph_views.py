"""Cleaned relations of the typed interaction graph, each read lazily from its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import canonical_text, clean_value, drug_id, is_complete, side_effect_code
from pairlens.plans.worktables import cached
from pairlens.sources.tables import table

FIELDS = ("STITCH 1", "STITCH 2", "Polypharmacy Side Effect")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relation, drug_1, drug_2``: distinct reported triples, drug_1 <= drug_2.

    Cleaned once in a session and kept by the fingerprint of the table's files.
    """

    def build() -> DataFrame:
        text = table(spark, sf_dir, "combo").select(canonical_text([F.col(f"`{f}`") for f in FIELDS]).alias("record")).distinct()
        parts = text.filter(is_complete(F.col("record"))).select(F.split("record", r"\|").alias("p"))
        return parts.select(F.col("p")[0].alias("relation"), F.col("p")[1].alias("drug_1"), F.col("p")[2].alias("drug_2"))

    return cached(spark, "triples", [f"{sf_dir}/combo.parquet"], build)


def frequent_triples(spark: SparkSession, sf_dir: str, min_pairs: int) -> DataFrame:
    """Triples of the relations that have at least ``min_pairs`` triples."""
    t = triples(spark, sf_dir)
    keep = t.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pairs).select("relation")
    return t.join(keep, "relation", "left_semi")


def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relation, relation_name``: the smallest of the names reported for a relation, in lower case without outer blanks."""
    combo = table(spark, sf_dir, "combo").select(side_effect_code(F.col("`Polypharmacy Side Effect`")).alias("relation"), F.lower(F.trim("`Side Effect Name`")).alias("name"))
    return combo.dropna(subset=["relation"]).groupBy("relation").agg(F.min("name").alias("relation_name"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``drug, gene``: distinct, without nulls."""
    return table(spark, sf_dir, "targets").select(drug_id(F.col("STITCH")).alias("drug"), F.col("Gene").alias("gene")).dropna().distinct()


def mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``drug, mono_se``: distinct, without nulls."""
    return table(spark, sf_dir, "mono").select(drug_id(F.col("STITCH")).alias("drug"), clean_value(F.col("`Individual Side Effect`")).alias("mono_se")).dropna().distinct()


def ppi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene_1, gene_2``: the rows as delivered, without nulls; repeats and self edges stay."""
    return table(spark, sf_dir, "ppi").select(F.col("`Gene 1`").alias("gene_1"), F.col("`Gene 2`").alias("gene_2")).dropna()


def smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``drug, smiles``: the smallest non-empty string of each drug."""
    s = table(spark, sf_dir, "smiles").select(drug_id(F.col("STITCH")).alias("drug"), F.nullif(F.trim("SMILES"), F.lit("")).alias("smiles"))
    return s.dropna().groupBy("drug").agg(F.min("smiles").alias("smiles"))


def drug_vectors(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """``drug, vector``: the vector with the smallest id of each drug, for one method."""
    e = table(spark, sf_dir, "embedding_result").filter(F.col("method") == method).select("vec_id", drug_id(F.col("STITCH")).alias("drug"), F.col("embeddings").cast("array<double>").alias("vector"))
    return e.dropna().groupBy("drug").agg(F.min_by("vector", "vec_id").alias("vector"))


def method_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``method, drug, vector``: the same for every method."""
    e = table(spark, sf_dir, "embedding_result").select("method", "vec_id", drug_id(F.col("STITCH")).alias("drug"), F.col("embeddings").cast("array<double>").alias("vector"))
    return e.dropna().groupBy("method", "drug").agg(F.min_by("vector", "vec_id").alias("vector"))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of split_rows with cleaned ids; rows without a drug id, code or label are left out."""
    r = table(spark, sf_dir, "split_rows").select(
        "row_id", drug_id(F.col("drug_1")).alias("drug_1"), drug_id(F.col("drug_2")).alias("drug_2"), side_effect_code(F.col("side_effect")).alias("relation"), "label", "fold", "strategy", "source"
    )
    return r.dropna(subset=["drug_1", "drug_2", "relation", "label", "fold", "strategy"])
