"""Queries of problem 2: records of the evaluation folds that stand among the train records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.near_records import distinct_records, members, near_texts
from pairlens.operators.spread import spread_join
from pairlens.plans import WorkTables
from pairlens.sources import table

FIELDS = ("drug_1", "drug_2", "side_effect")


def _records(spark: SparkSession, sf_dir: str, tables: WorkTables):
    rows = table(spark, sf_dir, "split_rows").filter(F.col("fold").isin("train", "val", "test"))
    side = F.col("fold") == "train"
    return rows, side, tables.save(distinct_records(rows, "row_id", FIELDS, "strategy", side), "records")


def _parts(spark: SparkSession, sf_dir: str):
    tables = WorkTables(spark, "overlap")
    rows, side, records = _records(spark, sf_dir, tables)
    return rows, side, records, tables.save(near_texts(records), "pairs")


def p2_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps in compact form: one row per pair of different or equal records, by their smallest row ids.

    ``p2_members`` has the rows of every record; together they hold what ``p2_found`` expands.
    """
    _, _, _, pairs = _parts(spark, sf_dir)
    return pairs.select(F.col("scope").alias("strategy"), "eval_id", "train_id", F.col("edits").cast("bigint").alias("edits"), F.round("coverage", 6).alias("coverage"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every row, by the record's smallest row id on the same side of its strategy."""
    tables = WorkTables(spark, "overlap")
    rows, side, records = _records(spark, sf_dir, tables)
    return members(rows, records, "row_id", FIELDS, "strategy", side).select("row_id", "text_id", "is_train")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of ``p2_near_texts`` expanded to their rows; records with very many rows are spread over tasks."""
    rows, side, records, pairs = _parts(spark, sf_dir)
    member = members(rows, records, "row_id", FIELDS, "strategy", side)
    held = member.filter("NOT is_train").select(F.col("text_id").alias("eval_id"), F.col("row_id").alias("r1"))
    train = member.filter("is_train").select(F.col("text_id").alias("train_id"), F.col("row_id").alias("r2"))
    counts = lambda side, name: records.filter(side).select(F.col("text_id").alias(name), "copies")
    with_held = spread_join(held, pairs.select("eval_id", "train_id"), counts("NOT is_train", "eval_id"), ["eval_id"], "copies", "r1", shuffled=True)
    joined = spread_join(train, with_held, counts("is_train", "train_id"), ["train_id"], "copies", "r2", shuffled=True)
    return joined.select(F.least("r1", "r2").alias("row_id_1"), F.greatest("r1", "r2").alias("row_id_2"))


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy, fold and source: evaluation rows, and how many stand in train exactly or nearly."""
    rows, side, records, pairs = _parts(spark, sf_dir)
    best = pairs.groupBy(F.col("eval_id").alias("text_id")).agg(F.min("edits").alias("edits"), F.max("coverage").alias("coverage"))
    held = members(rows.filter(~side), records, "row_id", FIELDS, "strategy", side, ("fold", "source")).join(best.hint("merge"), "text_id", "left")
    exact, near = F.count_if(F.col("edits") == 0), F.count_if(F.col("edits") == 1)
    return held.groupBy(F.col("scope").alias("strategy"), F.col("k_fold").alias("fold"), F.col("k_source").alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), exact.alias("n_exact"), near.alias("n_near"), F.round(F.avg(F.coalesce("coverage", F.lit(0.0))), 6).alias("mean_coverage")
    )


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_near_texts, p2_members, p2_overlap_report)}


_CLEAN = "nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '')"
_PAIRS = f"""
    r AS (SELECT row_id, fold, strategy, source, {_CLEAN.format("drug_1")} AS x, {_CLEAN.format("drug_2")} AS y, {_CLEAN.format("side_effect")} AS s FROM split_rows),
    c AS (SELECT * FROM r WHERE x IS NOT NULL AND y IS NOT NULL AND s IS NOT NULL AND strategy IS NOT NULL),
    p AS (SELECT e.row_id AS e_id, t.row_id AS t_id,
                 levenshtein(e.s, t.s) + least(levenshtein(e.x, t.x) + levenshtein(e.y, t.y), levenshtein(e.x, t.y) + levenshtein(e.y, t.x)) AS edits,
                 length(e.x) + length(e.y) + length(e.s) AS size
          FROM c e JOIN c t ON e.strategy = t.strategy AND t.fold = 'train' AND e.fold IN ('val', 'test')
           AND (e.s = t.s OR e.x IN (t.x, t.y) OR e.y IN (t.x, t.y)))"""


_TEXTS = f"""
    q AS (SELECT row_id, strategy, fold = 'train' AS is_train, least(x, y) AS x, greatest(x, y) AS y, s FROM
          (SELECT row_id, fold, strategy, {_CLEAN.format("drug_1")} AS x, {_CLEAN.format("drug_2")} AS y, {_CLEAN.format("side_effect")} AS s FROM split_rows)
          WHERE x IS NOT NULL AND y IS NOT NULL AND s IS NOT NULL AND strategy IS NOT NULL AND fold IN ('train', 'val', 'test')),
    u AS (SELECT *, min(row_id) OVER (PARTITION BY strategy, is_train, x, y, s) AS text_id FROM q),
    k AS (SELECT * FROM u WHERE row_id = text_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_members": f"WITH {_TEXTS} SELECT row_id, text_id, is_train FROM u",
        "p2_near_texts": f"""WITH {_TEXTS},
            n AS (SELECT e.strategy, e.text_id AS eval_id, t.text_id AS train_id, length(e.x) + length(e.y) + length(e.s) AS size,
                         levenshtein(e.s, t.s) + least(levenshtein(e.x, t.x) + levenshtein(e.y, t.y), levenshtein(e.x, t.y) + levenshtein(e.y, t.x)) AS edits
                  FROM k e JOIN k t ON e.strategy = t.strategy AND t.is_train AND NOT e.is_train AND (e.s = t.s OR e.x IN (t.x, t.y) OR e.y IN (t.x, t.y)))
            SELECT strategy, eval_id, train_id, edits, round((size - edits) / CAST(size AS DOUBLE), 6) AS coverage FROM n WHERE edits <= 1""",
        "p2_found": f"WITH {_PAIRS} SELECT least(e_id, t_id) AS row_id_1, greatest(e_id, t_id) AS row_id_2 FROM p WHERE edits <= 1",
        "p2_overlap_report": f"""WITH {_PAIRS},
            b AS (SELECT e_id, min(edits) AS edits, max((size - edits) / CAST(size AS DOUBLE)) AS coverage FROM p WHERE edits <= 1 GROUP BY e_id)
            SELECT strategy, fold, source, count(*) AS n_rows, count(*) FILTER (edits = 0) AS n_exact, count(*) FILTER (edits = 1) AS n_near,
                   round(avg(coalesce(coverage, 0e0)), 6) AS mean_coverage
            FROM c LEFT JOIN b ON e_id = row_id WHERE fold IN ('val', 'test') GROUP BY strategy, fold, source""",
    }
