"""Queries of problem 3: per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import clean_value
from pairlens.operators.eager_join import eager_join_aggregate, heavy_keys
from pairlens.sources import table

FIELDS = ("STITCH 1", "Polypharmacy Side Effect")

_CLEAN = "nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '')"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "combo"), FIELDS, clean_value).select("field_name", "key_value")


def p3_key_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per side effect: pairs of a report and a mono side effect of its first drug."""
    combo = table(spark, sf_dir, "combo").select(clean_value(F.col("`STITCH 1`")).alias("drug"), clean_value(F.col("`Polypharmacy Side Effect`")).alias("side_effect"))
    mono = table(spark, sf_dir, "mono").select(clean_value(F.col("STITCH")).alias("drug"), F.col("`Individual Side Effect`").isNotNull().cast("long").alias("named"))
    out = eager_join_aggregate(combo.dropna(), mono, ["drug"], ["side_effect"], right_sums=["named"])
    return out.select("side_effect", F.col("join_rows").alias("n_links"), F.col("sum_named").alias("n_named_links"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_key_links": p3_key_links}


def oracle_sql() -> dict[str, str]:
    s1, se, drug = (_CLEAN.format(c) for c in ('"STITCH 1"', '"Polypharmacy Side Effect"', '"STITCH"'))
    return {
        "p3_found": f"""
            WITH v AS (SELECT 'STITCH 1' AS field_name, {s1} AS key_value FROM combo
                       UNION ALL SELECT 'Polypharmacy Side Effect', {se} FROM combo)
            SELECT field_name, key_value FROM v WHERE key_value IS NOT NULL
            GROUP BY field_name, key_value HAVING count(*) * 50 >= (SELECT count(*) FROM combo)""",
        "p3_key_links": f"""
            SELECT c.side_effect, count(*) AS n_links, CAST(sum(m.named) AS BIGINT) AS n_named_links
            FROM (SELECT {s1} AS drug, {se} AS side_effect FROM combo) c
            JOIN (SELECT {drug} AS drug, CASE WHEN "Individual Side Effect" IS NULL THEN 0 ELSE 1 END AS named FROM mono) m
              ON c.drug = m.drug
            WHERE c.side_effect IS NOT NULL GROUP BY c.side_effect""",
    }
