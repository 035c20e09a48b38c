"""Queries of problems 7, 8 and 9, over document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import leakage, mixing, pii
from pairlens.plans import WorkTables
from pairlens.sources import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), WorkTables(spark, "leaks")).select("doc_id", "item_id")


def p7_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leakage.leak_report(leakage.find_leaks(table(spark, sf_dir, "documents"), items, WorkTables(spark, "leaks")), items)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), WorkTables(spark, "mix"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), WorkTables(spark, "mix"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"), WorkTables(spark, "personal")).select("doc_id", "kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with typed placeholders."""
    documents = table(spark, sf_dir, "documents")
    tables = WorkTables(spark, "personal")
    return pii.redact(documents, tables.save(pii.find_personal(documents, tables), "accepted"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_found, p7_leak_report, p8_mix, p8_shares, p9_found, p9_redacted)}


_RUNS = r"""
    i AS (SELECT item_id, list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS v FROM eval_items),
    d AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS v FROM documents),
    ig AS (SELECT item_id, g AS q, array_to_string(v[g:g + 12], ' ') AS gram FROM i, unnest(range(1, len(v) - 11)) AS t(g)),
    dg AS (SELECT doc_id, g AS p, array_to_string(v[g:g + 12], ' ') AS gram FROM d, unnest(range(1, len(v) - 11)) AS t(g)),
    m AS (SELECT doc_id, item_id, p, q FROM dg JOIN ig USING (gram))"""
_REPORT = """
    s AS (SELECT doc_id, item_id, p, p - q AS shift, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM m),
    l AS (SELECT doc_id, item_id, count(*) + 12 AS n FROM s GROUP BY doc_id, item_id, shift, island),
    x AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n) AS longest_run FROM l GROUP BY item_id)
    SELECT item_id, item_set, coalesce(n_docs, 0) AS n_docs, coalesce(longest_run, 0) AS longest_run, round(coalesce(longest_run, 0) / CAST(nullif(len(v), 0) AS DOUBLE), 4) AS share_of_item
    FROM (SELECT item_id, item_set FROM eval_items) JOIN i USING (item_id) LEFT JOIN x USING (item_id)"""


def oracle_sql() -> dict[str, str]:
    return {"p7_found": f"WITH {_RUNS} SELECT DISTINCT doc_id, item_id FROM m", "p7_leak_report": f"WITH {_RUNS}, {_REPORT}"}
