"""Queries of problems 1, 4 and 5, over interaction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import canonical_text, drug_id, is_complete
from pairlens.llm import cooccurrence, copies, entity_splits
from pairlens.plans import WorkTables
from pairlens.sources import table

FIELDS = ("STITCH 1", "STITCH 2", "Polypharmacy Side Effect")
SHARES = {"train": 0.70, "val": 0.10, "test": 0.20}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies_of_records(table(spark, sf_dir, "combo"), FIELDS, WorkTables(spark, "copies"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapse_copies(table(spark, sf_dir, "combo"), FIELDS)


def _gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved Gram counts of side effects over drug pairs.

    In the canonical text the side-effect code comes first (digits sort before letters).
    """
    text = table(spark, sf_dir, "combo").select(canonical_text([F.col(f"`{f}`") for f in FIELDS]).alias("record"))
    entry = text.select(F.when(is_complete(F.col("record")), F.split("record", r"\|", 2)).alias("r"))
    baskets = entry.select(F.col("r")[1].alias("pair"), F.col("r")[0].alias("side_effect"))
    return WorkTables(spark, "gram").save(cooccurrence.gram_counts(baskets, "pair", "side_effect"), "gram")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.lift(_gram(spark, sf_dir))
    often = (F.col("n_both") * 100 >= F.col("n_baskets")) & (F.col("n_both") * F.col("n_baskets") >= 3 * F.col("n_1") * F.col("n_2"))
    return pairs.filter(often).select(F.col("item_1").alias("se_1"), F.col("item_2").alias("se_2"))


def p4_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.lift(_gram(spark, sf_dir))
    return pairs.select(F.col("item_1").alias("se_1"), F.col("item_2").alias("se_2"), "n_both", "n_1", "n_2", F.round("lift", 6).alias("lift"))


def _groups(spark: SparkSession, sf_dir: str, tables: WorkTables) -> DataFrame:
    pool = table(spark, sf_dir, "split_pool").select("row_id", drug_id(F.col("drug_1")).alias("drug_1"), drug_id(F.col("drug_2")).alias("drug_2"))
    return entity_splits.entity_groups(pool, "row_id", ["drug_1", "drug_2"], tables)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_splits.rows_but_first(_groups(spark, sf_dir, WorkTables(spark, "groups")))


def p5_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every record."""
    tables = WorkTables(spark, "splits")
    groups = tables.save(_groups(spark, sf_dir, tables), "rows")
    assigned = entity_splits.assign_splits(groups, SHARES, tables)
    return groups.join(assigned.select("group_id", "fold"), "group_id").select("row_id", "group_id", "fold")


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = WorkTables(spark, "splits")
    return entity_splits.split_report(entity_splits.assign_splits(_groups(spark, sf_dir, tables), SHARES, tables), SHARES)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_records, p4_found, p4_lift, p5_found, p5_assignment, p5_split_report)}


def oracle_sql() -> dict[str, str]:
    s1, s2, se = (f"nullif(regexp_replace(upper(\"{c}\"), '[^A-Z0-9]', '', 'g'), '')" for c in FIELDS)
    d1, d2 = (f"CASE WHEN regexp_matches({x}, '^CID[0-9]{{9}}$') THEN {x} END" for x in ("regexp_replace(upper(drug_1), '[^A-Z0-9]', '', 'g')", "regexp_replace(upper(drug_2), '[^A-Z0-9]', '', 'g')"))
    rows = f"""c AS (SELECT row_id, list_sort([a, b, s]) AS k, "STITCH 1" || chr(1) || "STITCH 2" || chr(1) || "Polypharmacy Side Effect" AS raw
                     FROM (SELECT *, {s1} AS a, {s2} AS b, {se} AS s FROM combo) WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL)"""
    pairs = """r AS (SELECT DISTINCT k[1] AS se, k[2] || '|' || k[3] AS pair FROM c),
               n AS (SELECT se, count(*) AS n FROM r GROUP BY se),
               t AS (SELECT count(DISTINCT pair) AS n_all FROM r),
               b AS (SELECT x.se AS se_1, y.se AS se_2, count(*) AS n_both FROM r x JOIN r y ON x.pair = y.pair AND x.se < y.se GROUP BY 1, 2)"""
    return {
        "p1_found": f"""WITH {rows}, m AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS first_row_id FROM c)
                        SELECT first_row_id, row_id FROM m WHERE row_id > first_row_id""",
        "p1_records": f"""WITH {rows} SELECT array_to_string(k, '|') AS record, count(*) AS copies, count(DISTINCT raw) AS spellings,
                          min(row_id) AS first_row_id, max(row_id) AS last_row_id FROM c GROUP BY k""",
        "p4_found": f"""WITH {rows}, {pairs} SELECT se_1, se_2 FROM b JOIN n p ON p.se = se_1 JOIN n q ON q.se = se_2, t
                        WHERE n_both * 100 >= n_all AND n_both * n_all >= 3 * p.n * q.n""",
        "p4_lift": f"""WITH {rows}, {pairs} SELECT se_1, se_2, n_both, p.n AS n_1, q.n AS n_2,
                       round(n_both * n_all / (CAST(p.n AS DOUBLE) * q.n), 6) AS lift
                       FROM b JOIN n p ON p.se = se_1 JOIN n q ON q.se = se_2, t""",
        "p5_found": f"""WITH RECURSIVE d AS (SELECT row_id, {d1} AS x, {d2} AS y FROM split_pool),
                        e AS (SELECT DISTINCT coalesce(x, y) AS a, coalesce(y, x) AS b FROM d WHERE coalesce(x, y) IS NOT NULL),
                        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
                        reach AS (SELECT DISTINCT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM reach r JOIN s ON r.other = s.a),
                        g AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
                        m AS (SELECT row_id, min(row_id) OVER (PARTITION BY root) AS first_row_id FROM d JOIN g ON g.node = coalesce(x, y))
                        SELECT first_row_id, row_id FROM m WHERE row_id > first_row_id""",
    }
