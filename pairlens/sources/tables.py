"""Readers of the project's Parquet tables, with a fail-fast check of the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns every table must have; further columns are allowed and ignored.
COLUMNS: dict[str, tuple[str, ...]] = {
    "combo": ("row_id", "STITCH 1", "STITCH 2", "Polypharmacy Side Effect", "Side Effect Name", "source", "reported_at", "loaded_at"),
    "mono": ("STITCH", "Individual Side Effect"),
    "ppi": ("Gene 1", "Gene 2"),
    "targets": ("STITCH", "Gene"),
    "smiles": ("STITCH", "SMILES"),
    "split_rows": ("row_id", "drug_1", "drug_2", "side_effect", "label", "fold", "strategy", "source"),
    "split_pool": ("row_id", "drug_1", "drug_2", "side_effect", "label", "source"),
    "embedding_result": ("vec_id", "STITCH", "method", "embeddings", "has_target", "fit_time_s"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "eval_items": ("item_id", "text", "task", "lang", "item_set"),
    "source_weights": ("source", "target_share", "max_repeats"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; raise if a declared column is missing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    missing = [c for c in COLUMNS.get(name, ()) if c not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks the columns {missing}")
    return df
