"""SQL of the cleaned relations, for the checks in DuckDB."""

from __future__ import annotations


def clean(column: str) -> str:
    return f"nullif(regexp_replace(upper({column}), '[^A-Z0-9]', '', 'g'), '')"


def drug(column: str) -> str:
    return f"CASE WHEN regexp_matches({clean(column)}, '^CID[0-9]{{9}}$') THEN {clean(column)} END"


def code(column: str) -> str:
    return f"CASE WHEN regexp_matches({clean(column)}, '^C[0-9]{{7}}$') THEN {clean(column)} END"


VIEWS: dict[str, str] = {
    "triples": f"""SELECT DISTINCT k[1] AS relation, k[2] AS drug_1, k[3] AS drug_2 FROM (
        SELECT list_sort([a, b, s]) AS k FROM (SELECT {clean('"STITCH 1"')} AS a, {clean('"STITCH 2"')} AS b, {clean('"Polypharmacy Side Effect"')} AS s FROM combo)
        WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL)""",
    "tgt": f"SELECT DISTINCT drug, gene FROM (SELECT {drug('STITCH')} AS drug, Gene AS gene FROM targets) WHERE drug IS NOT NULL AND gene IS NOT NULL",
    "mon": f"SELECT DISTINCT drug, mono_se FROM (SELECT {drug('STITCH')} AS drug, {clean('\"Individual Side Effect\"')} AS mono_se FROM mono) WHERE drug IS NOT NULL AND mono_se IS NOT NULL",
    "net": 'SELECT "Gene 1" AS gene_1, "Gene 2" AS gene_2 FROM ppi WHERE "Gene 1" IS NOT NULL AND "Gene 2" IS NOT NULL',
    "smi": f"SELECT drug, min(s) AS smiles FROM (SELECT {drug('STITCH')} AS drug, nullif(trim(SMILES), '') AS s FROM smiles) WHERE drug IS NOT NULL AND s IS NOT NULL GROUP BY drug",
    "recs": f"""SELECT * FROM (SELECT row_id, {drug('drug_1')} AS drug_1, {drug('drug_2')} AS drug_2, {code('side_effect')} AS relation, label, fold, strategy, source FROM split_rows)
        WHERE drug_1 IS NOT NULL AND drug_2 IS NOT NULL AND relation IS NOT NULL AND label IS NOT NULL AND fold IS NOT NULL AND strategy IS NOT NULL""",
    "vecs": f"""SELECT method, drug, arg_min(vector, vec_id) AS vector FROM (
        SELECT method, vec_id, {drug('STITCH')} AS drug, CAST(embeddings AS DOUBLE[]) AS vector FROM embedding_result) WHERE drug IS NOT NULL AND vector IS NOT NULL GROUP BY method, drug""",
}


def with_views(names: str, rest: str) -> str:
    """``WITH`` the named views (separated by blanks), then further tables or the query."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    joined = f"{views}, {rest}" if not rest.lstrip().upper().startswith("SELECT") else f"{views} {rest}"
    return f"WITH {joined}"


def frequent(min_pairs: int) -> str:
    return f"freq AS (SELECT t.* FROM triples t WHERE relation IN (SELECT relation FROM triples GROUP BY relation HAVING count(*) >= {min_pairs}))"


ENDS = "ends AS (SELECT relation, drug_1 AS drug FROM freq UNION ALL SELECT relation, drug_2 FROM freq)"
