"""Queries on negatives, splits, pair features and pair scores."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import pairops, sampling, splitting
from pairlens.plans.explore_queries import MIN_PAIRS
from pairlens.plans.sql import frequent, with_views
from pairlens.plans.worktables import WorkTables
from pairlens.sources import graph_views as g

N_WEAK = 98
#: Negatives for each positive pair, by the ending of the query's name (``_full``: an older name of the first).
RATIOS = {"": 1.0, "_full": 1.0, "_half": 0.5, "_double": 2.0}
#: Queries that also go by an older name with ``_all``.
WHOLE = ("heldout_drugs", "split_sizes", "compare_operators", *(f"split_{s}" for s in splitting.STRATEGIES), *(f"pair_{n}" for n in pairops.OPERATORS), *(f"score_{k}" for k in ("distmult", "simple", "trivec", "bilinear")))
#: Vectors of 64 dimensions that make up a drug's features in each mode.
MODE_BLOCKS = {"target_only": 1, "fp_only": 1, "target+fp": 2, "all": 3}


def _freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.frequent_triples(spark, sf_dir, MIN_PAIRS)


def _labelled(spark, sf_dir):
    """Distinct labelled pairs of all rows; of conflicting labels the larger."""
    r = g.split_records(spark, sf_dir)
    lo, hi = F.least("drug_1", "drug_2").alias("drug_1"), F.greatest("drug_1", "drug_2").alias("drug_2")
    return r.select("relation", lo, hi, "label").groupBy("relation", "drug_1", "drug_2").agg(F.max("label").alias("label"))


def _negatives(spark, sf_dir, strategy, ratio=1.0):
    """``ratio`` negatives for each positive pair of every relation."""
    return sampling.sample_negatives(_freq(spark, sf_dir), strategy, ratio=ratio)


def negative_known_pct(spark, sf_dir):
    t = _freq(spark, sf_dir)
    parts = [sampling.known_share(sampling.sample_negatives(t, s), t).withColumn("strategy", F.lit(s)) for s in ("random", "structured")]
    return parts[0].unionByName(parts[1])


def random_tail_corruption(spark, sf_dir):
    return sampling.corrupted_tails(_freq(spark, sf_dir))


def heldout_drugs(spark, sf_dir):
    return splitting.heldout_drugs(_labelled(spark, sf_dir))


def _split(spark, sf_dir, strategy):
    return splitting.split(_labelled(spark, sf_dir), strategy).select("relation", "drug_1", "drug_2", "label", "fold")


def split_sizes(spark, sf_dir):
    """Sizes of all three strategies."""
    parts = [splitting.split_sizes(_split(spark, sf_dir, s), []).withColumn("strategy", F.lit(s)) for s in splitting.STRATEGIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_overlap(spark, sf_dir):
    """Test drugs seen in training, for the given folds of each strategy."""
    return splitting.drug_overlap(g.split_records(spark, sf_dir), ["strategy"])


def given_split_sizes(spark, sf_dir):
    return splitting.split_sizes(g.split_records(spark, sf_dir), ["strategy", "source"])


def training_drugs(spark, sf_dir):
    return splitting.training_drugs(g.split_records(spark, sf_dir), ["strategy"])


def weak_node_split(spark, sf_dir):
    return splitting.weak_node(_freq(spark, sf_dir), N_WEAK).select("relation", "drug_1", "drug_2", "fold")


def triple_index_selfloops(spark, sf_dir):
    """Triples and, as self loops of a relation of their own, the single-drug effects of known drugs."""
    t = _freq(spark, sf_dir)
    drugs = t.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    loops = g.mono(spark, sf_dir).join(drugs, "drug", "left_semi").select(F.concat(F.lit("mono:"), "mono_se").alias("relation"), F.col("drug").alias("head"), F.col("drug").alias("tail"))
    return t.select("relation", F.col("drug_1").alias("head"), F.col("drug_2").alias("tail")).unionByName(loops).groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("head") == F.col("tail")).alias("n_loops"))


def _pair_summary(spark, sf_dir, name):
    """Width, rounded sum and extremes of each pair's features, by method of the vectors."""
    pairs = _labelled(spark, sf_dir).select("relation", "drug_1", "drug_2")
    f = pairops.pair_features(pairs, g.method_vectors(spark, sf_dir), name)
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return f.select("method", "relation", "drug_1", "drug_2", F.size("features").cast("bigint").alias("width"), (F.round(total, 4) + 0.0).alias("total"), (F.round(F.array_max("features"), 6) + 0.0).alias("largest"), (F.round(F.element_at("features", -1), 6) + 0.0).alias("last"))


def compare_operators(spark, sf_dir):
    """Mean width and total of every operator over all pairs that have vectors, by method of these.

    Totals have four digits and are summed as decimals, so the mean depends on no order of rows.
    """
    out = None
    for name in pairops.OPERATORS:
        row = _pair_summary(spark, sf_dir, name).groupBy("method").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("width").alias("width"), (F.sum(F.col("total").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("mean_total")).withColumn("operator", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def preprocessing_grid(spark, sf_dir):
    """Every choice of negatives, split, feature mode and operator, with its rows per fold and its width.

    Both kinds of negatives go through each split in one pass, as relations of their own.
    """
    t = _freq(spark, sf_dir)
    parts = []
    for kind in ("random", "structured"):
        both = t.withColumn("label", F.lit(1)).unionByName(sampling.sample_negatives(t, kind).withColumn("label", F.lit(0)))
        parts.append(both.withColumn("relation", F.concat(F.lit(f"{kind}:"), "relation")))
    labelled = WorkTables(spark, "grid").save(parts[0].unionByName(parts[1]).select("relation", "drug_1", "drug_2", "label"), "labelled")
    sizes = None
    for strategy in splitting.STRATEGIES:
        folded = splitting.split(labelled, strategy).withColumn("negatives", F.substring_index("relation", ":", 1))
        row = folded.groupBy("negatives").agg(*(F.count_if(F.col("fold") == f).alias(f"n_{f}") for f in ("train", "val", "test"))).withColumn("strategy", F.lit(strategy))
        sizes = row if sizes is None else sizes.unionByName(row)
    choices = [F.struct(F.lit(m).alias("mode"), F.lit(o).alias("operator"), F.lit(w).cast("bigint").alias("width")) for m, o, w in _choices()]
    return sizes.select("*", F.inline(F.array(*choices)))


def _choices() -> list[tuple[str, str, int]]:
    """Feature mode, operator and the width of the pair's features."""
    return [(m, o, 64 * blocks * times) for m, blocks in MODE_BLOCKS.items() for o, (_, times) in pairops.OPERATORS.items()]


def _scores(spark, sf_dir, kind):
    """Triple scores with the vectors of each method as entity table.

    A relation's vector is the mean vector of its training drugs.
    """
    pairs = _labelled(spark, sf_dir).select("relation", "drug_1", "drug_2")
    base = pairops.with_vectors(pairs, g.method_vectors(spark, sf_dir))
    by = ["method", "relation"]
    ends = base.select(*by, "a").unionByName(base.select(*by, F.col("b").alias("a")))
    per_dim = ends.select(*by, F.posexplode("a").alias("i", "x")).groupBy(*by, "i").agg(F.round(F.avg("x"), 6).alias("x"))
    relation = per_dim.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("w"))  # one entry per dimension
    j = base.join(relation, by)
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    a2, b2, w2 = F.reverse(a), F.reverse(b), F.reverse(w)
    score = {
        "distmult": pairops.dot(a, w, b),
        "simple": (pairops.dot(a, w, b2) + pairops.dot(a2, w2, b)) / 2,
        "trivec": pairops.dot(a, w, b2) + pairops.dot(a2, w2, b2) + pairops.dot(a2, w, b),
        "bilinear": pairops.dot(pairops.hadamard(a, w), pairops.hadamard(b, w2)),
    }[kind]
    return j.select(*by, "drug_1", "drug_2", (F.round(score, 6) + 0.0).alias("score"))


def feature_modes(spark, sf_dir):
    """Width of each drug's features per mode; drugs without a vector get zeros."""
    drugs = _freq(spark, sf_dir).select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    wide = drugs
    for method, col in (("graph_svd", "profile"), ("pca", "embedding"), ("node2vec", "fingerprint")):
        wide = wide.join(g.drug_vectors(spark, sf_dir, method).withColumnRenamed("vector", col), "drug", "left")
    zeros = F.array_repeat(F.lit(0.0), 64)
    blocks = [F.coalesce(c, zeros) for c in ("profile", "embedding", "fingerprint")]
    out = None
    for mode in pairops.FEATURE_MODES:
        f = wide.select("drug", pairops.feature_mode(*blocks, mode).alias("f"))
        nz = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + F.abs(x))
        row = f.agg(F.count(F.lit(1)).alias("n_drugs"), F.max(F.size("f")).cast("bigint").alias("width"), F.count_if(nz == 0).alias("n_zero"), F.round(F.avg(nz), 4).alias("mean_abs")).withColumn("mode", F.lit(mode))
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict:
    fs = (negative_known_pct, random_tail_corruption, heldout_drugs, split_sizes, split_overlap, given_split_sizes, training_drugs, weak_node_split, triple_index_selfloops, compare_operators, feature_modes, preprocessing_grid)
    out = {f.__name__: f for f in fs}
    out |= {f"negatives_{s}{name}": partial(_negatives, strategy=s, ratio=r) for s in sampling.STRATEGIES for name, r in RATIOS.items()}
    out["negative_known_pct_full"] = negative_known_pct
    out |= {f"split_{s}": partial(_split, strategy=s) for s in splitting.STRATEGIES}
    out |= {f"pair_{n}": partial(_pair_summary, name=n) for n in pairops.OPERATORS}
    out |= {f"score_{k}": partial(_scores, kind=k) for k in ("distmult", "simple", "trivec", "bilinear")}
    return out | {f"{n}_all": out[n] for n in WHOLE}


# --- the same in SQL ------------------------------------------------------------------------


def _h(*cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ", '42'))"


def _slot(h: str, n: str, start: int = 1) -> str:
    return f"(CAST(('0x' || substr({h}, {start}, 8)) AS BIGINT) % {n})"


_FREQ = frequent(MIN_PAIRS)
_DRUGS = f"d AS (SELECT drug, row_number() OVER (ORDER BY {_h('drug')}) - 1 AS place FROM (SELECT drug_1 AS drug FROM freq UNION SELECT drug_2 FROM freq)), nd AS (SELECT count(*) AS n FROM d)"


def _first_sql(name: str, pairs: str, wanted: str, taken: str) -> str:
    """Table ``name``: of the ``pairs`` (slot, drug_1, drug_2) that are not taken, the first n_neg of each relation's order."""
    return f"""{name}_q AS (SELECT min(q) AS q FROM (SELECT n, unnest(range(greatest(n, 2), greatest(n, 2) + 2000)) AS q FROM (SELECT count(*) AS n FROM {pairs})) WHERE len(list_filter(range(2, CAST(floor(sqrt(q)) AS BIGINT) + 1), lambda d: q % d = 0)) = 0),
    {name}_w AS (SELECT relation, n_neg, 1 + {_slot(_h('relation'), 'least(q - 1, 2147483648)')} AS factor, {_slot(_h('relation'), 'q', 9)} AS shift, q FROM {wanted}, {name}_q),
    {name} AS (SELECT relation, drug_1, drug_2 FROM (SELECT w.relation, p.drug_1, p.drug_2, n_neg, row_number() OVER (PARTITION BY w.relation ORDER BY (p.slot * factor + shift) % q) AS r FROM {name}_w w, {pairs} p
        WHERE NOT EXISTS (SELECT 1 FROM {taken} x WHERE x.relation = w.relation AND x.drug_1 = p.drug_1 AND x.drug_2 = p.drug_2)) WHERE r <= n_neg)"""


def _any(ratio: float) -> str:
    return f"""{_FREQ}, {_DRUGS}, want AS (SELECT relation, greatest(1, CAST(floor(count(*) * {ratio}e0) AS BIGINT)) AS n_neg FROM freq GROUP BY relation),
    anypair AS (SELECT a.place * (a.place - 1) // 2 + b.place AS slot, least(a.drug, b.drug) AS drug_1, greatest(a.drug, b.drug) AS drug_2 FROM d a JOIN d b ON b.place < a.place)"""


def _random_sql(ratio: float = 1.0) -> str:
    return f"{_any(ratio)}, {_first_sql('neg', 'anypair', 'want', 'freq')}"


def _structured_sql(ratio: float = 1.0) -> str:
    return f"""{_any(ratio)}, pool AS (SELECT drug_1, drug_2, row_number() OVER (ORDER BY {_h('drug_1', 'drug_2')}) - 1 AS slot FROM (SELECT DISTINCT drug_1, drug_2 FROM freq WHERE drug_1 < drug_2)),
    {_first_sql('kn', 'pool', 'want', 'freq')}, short AS (SELECT relation, want.n_neg - coalesce(n, 0) AS n_neg FROM want LEFT JOIN (SELECT relation, count(*) AS n FROM kn GROUP BY relation) USING (relation) WHERE want.n_neg > coalesce(n, 0)),
    used AS (SELECT * FROM freq UNION ALL SELECT * FROM kn), {_first_sql('extra', 'anypair', 'short', 'used')}, neg AS (SELECT * FROM kn UNION ALL SELECT * FROM extra)"""


_NEGATIVES = {"random": _random_sql, "structured": _structured_sql}
_LAB = "lab AS (SELECT relation, least(drug_1, drug_2) AS drug_1, greatest(drug_1, drug_2) AS drug_2, max(label) AS label FROM recs GROUP BY 1, 2, 3)"
_HELD = f"""held AS (SELECT drug FROM (SELECT drug, row_number() OVER (ORDER BY {_h('drug')}) - 1 AS k, count(*) OVER () AS n FROM (SELECT drug_1 AS drug FROM lab UNION SELECT drug_2 FROM lab)) WHERE k < greatest(1, floor(n * 0.2e0)))"""


def _ranked(groups: str, source: str = "lab") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {_h('relation', 'drug_1', 'drug_2', 'label')}) - 1 AS k, count(*) OVER (PARTITION BY {groups}) AS n FROM {source}"


_SPLITS = {
    "random_pair": f"s_random_pair AS (SELECT relation, drug_1, drug_2, label, CASE WHEN k < floor(n * 0.7e0) THEN 'train' WHEN k < floor(n * 0.7e0) + floor(n * 0.1e0) THEN 'val' ELSE 'test' END AS fold FROM ({_ranked('relation')}))",
    "stratified_pair": f"""s_stratified_pair AS (SELECT relation, drug_1, drug_2, label, CASE WHEN n < 3 OR k < n - held THEN 'train' WHEN k < n - ceil(held * (0.2e0 / (0.1e0 + 0.2e0))) THEN 'val' ELSE 'test' END AS fold
        FROM (SELECT *, ceil(n * (0.1e0 + 0.2e0)) AS held FROM ({_ranked('relation, label')})))""",
    "drug_cold_start": f"""{_HELD}, fl AS (SELECT *, drug_1 IN (SELECT drug FROM held) OR drug_2 IN (SELECT drug FROM held) AS is_test FROM lab),
        s_drug_cold_start AS (SELECT relation, drug_1, drug_2, label, CASE WHEN is_test THEN 'test' WHEN k < floor(n * 0.7e0 / (0.7e0 + 0.1e0)) THEN 'train' ELSE 'val' END AS fold FROM ({_ranked('relation, is_test', 'fl')}))""",
}
_SIZES = ", ".join(f"count(*) FILTER (fold = '{f}' AND label = {v}) AS {f}_{'pos' if v else 'neg'}" for f in ("train", "val", "test") for v in (1, 0))
_ELEM = {
    "hadamard": "list_transform(z, lambda p: p[1] * p[2])",
    "absdiff": "list_transform(z, lambda p: abs(p[1] - p[2]))",
    "sum": "list_transform(z, lambda p: p[1] + p[2])",
}
_ELEM["hadamard_absdiff"] = f"list_concat({_ELEM['hadamard']}, {_ELEM['absdiff']})"
_ELEM["concat_sym"] = "list_concat(list_transform(z, lambda p: (p[1] + p[2]) / 2), list_transform(z, lambda p: (p[1] + p[2]) / 2))"
_ELEM["concat"] = "list_concat(a, b)"
_VEC = "ab AS (SELECT x.method, relation, drug_1, drug_2, x.vector AS a, y.vector AS b, list_zip(x.vector, y.vector) AS z FROM lab JOIN vecs x ON x.drug = drug_1 JOIN vecs y ON y.drug = drug_2 AND y.method = x.method)"


def _summary(name: str) -> str:
    return f"SELECT method, relation, drug_1, drug_2, len(f) AS width, round(list_sum(f), 4) + 0e0 AS total, round(list_max(f), 6) + 0e0 AS largest, round(f[-1], 6) + 0e0 AS last FROM (SELECT *, {_ELEM[name]} AS f FROM ab)"


def _dot3(a: str, w: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {w}, {b}), lambda p: p[1] * p[2] * p[3]))"


def oracle_sql() -> dict[str, str]:
    rev = "list_reverse({})".format
    scores = {
        "distmult": _dot3("a", "w", "b"),
        "simple": f"({_dot3('a', 'w', rev('b'))} + {_dot3(rev('a'), rev('w'), 'b')}) / 2",
        "trivec": f"{_dot3('a', 'w', rev('b'))} + {_dot3(rev('a'), rev('w'), rev('b'))} + {_dot3(rev('a'), 'w', 'b')}",
        "bilinear": f"list_sum(list_transform(list_zip(a, w, b, {rev('w')}), lambda p: p[1] * p[2] * (p[3] * p[4])))",
    }
    relation = """e AS (SELECT method, relation, a AS x FROM ab UNION ALL SELECT method, relation, b FROM ab),
        pd AS (SELECT method, relation, i, round(avg(x[i]), 6) AS x FROM e, range(1, 65) AS r(i) GROUP BY ALL), rw AS (SELECT method, relation, list(x ORDER BY i) AS w FROM pd GROUP BY ALL)"""
    out = {
        "random_tail_corruption": with_views("triples", f"{_FREQ}, {_DRUGS} SELECT relation, drug_1, drug_2, d.drug AS tail FROM freq, nd JOIN d ON place = {_slot(_h('relation', 'drug_1', 'drug_2'), 'n')}"),
        "heldout_drugs": with_views("recs", f"{_LAB}, {_HELD} SELECT drug FROM held"),
        "split_sizes": with_views("recs", f"{_LAB}, {', '.join(_SPLITS.values())} " + " UNION ALL ".join(f"SELECT {_SIZES}, '{s}' AS strategy FROM s_{s}" for s in _SPLITS)),
        "given_split_sizes": with_views("recs", f"SELECT strategy, source, {_SIZES} FROM recs GROUP BY strategy, source"),
        "split_overlap": with_views(
            "recs",
            """e AS (SELECT strategy, fold, drug_1 AS drug FROM recs UNION SELECT strategy, fold, drug_2 FROM recs),
            p AS (SELECT strategy, drug, bool_or(fold = 'test') AS a, bool_or(fold = 'train') AS b FROM e WHERE fold IN ('train', 'test') GROUP BY 1, 2)
            SELECT strategy, count(*) FILTER (a) AS n_test_drugs, coalesce(round(count(*) FILTER (a AND b) * 100e0 / nullif(count(*) FILTER (a), 0), 1), 0e0) AS pct_in_train FROM p GROUP BY strategy""",
        ),
        "training_drugs": with_views("recs", "SELECT strategy, drug_1 AS drug FROM recs WHERE fold = 'train' UNION SELECT strategy, drug_2 FROM recs WHERE fold = 'train'"),
        "weak_node_split": with_views(
            "triples",
            f"""{_FREQ}, w AS (SELECT drug FROM (SELECT drug, count(*) AS n FROM (SELECT drug_1 AS drug FROM freq UNION ALL SELECT drug_2 FROM freq) GROUP BY drug) ORDER BY n, drug LIMIT {N_WEAK}),
            x AS (SELECT *, drug_1 IN (SELECT drug FROM w) OR drug_2 IN (SELECT drug FROM w) AS weak FROM freq),
            y AS (SELECT *, row_number() OVER (PARTITION BY weak ORDER BY {_h('relation', 'drug_1', 'drug_2')}) - 1 AS k, count(*) OVER (PARTITION BY weak) AS n FROM x)
            SELECT relation, drug_1, drug_2, CASE WHEN NOT weak THEN 'train' WHEN k < floor(n / 2e0) THEN 'val' ELSE 'test' END AS fold FROM y""",
        ),
        "triple_index_selfloops": with_views(
            "triples mon",
            f"""{_FREQ}, u AS (SELECT relation, drug_1 AS head, drug_2 AS tail FROM freq UNION ALL SELECT 'mono:' || mono_se, drug, drug FROM mon WHERE drug IN (SELECT drug_1 FROM freq UNION SELECT drug_2 FROM freq))
            SELECT relation, count(*) AS n_edges, count(*) FILTER (head = tail) AS n_loops FROM u GROUP BY relation""",
        ),
        "compare_operators": with_views("recs vecs", f"{_LAB}, {_VEC} " + " UNION ALL ".join(f"SELECT method, count(*) AS n_pairs, max(width) AS width, CAST(sum(CAST(total AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS mean_total, '{n}' AS operator FROM ({_summary(n)}) GROUP BY method" for n in pairops.OPERATORS)),
        "feature_modes": with_views(
            "triples vecs",
            f"""{_FREQ}, d AS (SELECT drug_1 AS drug FROM freq UNION SELECT drug_2 FROM freq), zero AS (SELECT list_transform(range(64), lambda i: 0e0) AS o),
            w AS (SELECT d.drug, {", ".join(f"coalesce({m}.vector, o) AS {c}" for m, c in (("graph_svd", "p"), ("pca", "e"), ("node2vec", "f")))} FROM d
                  {" ".join(f"LEFT JOIN (SELECT drug, vector FROM vecs WHERE method = '{m}') {m} ON {m}.drug = d.drug" for m in ("graph_svd", "pca", "node2vec"))}, zero),
            m AS (SELECT 'target_only' AS mode, e AS f FROM w UNION ALL SELECT 'fp_only', f FROM w UNION ALL SELECT 'target+fp', list_concat(e, f) FROM w UNION ALL SELECT 'all', list_concat(list_concat(p, e), f) FROM w),
            s AS (SELECT mode, len(f) AS n, list_sum(list_transform(f, lambda x: abs(x))) AS nz FROM m)
            SELECT mode, count(*) AS n_drugs, max(n) AS width, count(*) FILTER (nz = 0) AS n_zero, round(avg(nz), 4) AS mean_abs FROM s GROUP BY mode""",
        ),
    }
    known = "SELECT count(*) AS n_negatives, round(count(q.drug_1) * 100e0 / count(*), 2) AS pct_known, '{}' AS strategy FROM neg LEFT JOIN (SELECT DISTINCT drug_1, drug_2 FROM freq) q ON q.drug_1 = neg.drug_1 AND q.drug_2 = neg.drug_2"
    out |= {f"negatives_{k}{name}": with_views("triples", f"{sql(r)} SELECT * FROM neg") for k, sql in _NEGATIVES.items() for name, r in RATIOS.items()}
    out["negative_known_pct"] = out["negative_known_pct_full"] = " UNION ALL ".join(f"SELECT * FROM ({with_views('triples', sql() + ' ' + known.format(k))})" for k, sql in _NEGATIVES.items())
    kinds = tuple((k, sql()) for k, sql in _NEGATIVES.items())
    labelled = " UNION ALL ".join(f"SELECT '{k}:' || relation AS relation, drug_1, drug_2, 1 AS label FROM freq UNION ALL SELECT '{k}:' || relation, drug_1, drug_2, 0 FROM neg_{k}" for k, _ in kinds)
    drawn = ", ".join(f"neg_{k} AS ({with_views('triples', sql)} SELECT relation, drug_1, drug_2 FROM neg)" for k, sql in kinds)
    counts = " UNION ALL ".join(f"SELECT split_part(relation, ':', 1) AS negatives, '{s}' AS strategy, {', '.join(f'count(*) FILTER (fold = {chr(39)}{f}{chr(39)}) AS n_{f}' for f in ('train', 'val', 'test'))} FROM s_{s} GROUP BY 1" for s in _SPLITS)
    choices = ", ".join(f"('{m}', '{o}', CAST({w} AS BIGINT))" for m, o, w in _choices())
    out["preprocessing_grid"] = with_views(
        "triples", f"{_FREQ}, {drawn}, lab AS ({labelled}), {', '.join(_SPLITS.values())}, z AS ({counts}) SELECT z.*, mode, operator, width FROM z, (VALUES {choices}) AS c(mode, operator, width)"
    )
    out |= {f"split_{s}": with_views("recs", f"{_LAB}, {_SPLITS[s]} SELECT * FROM s_{s}") for s in _SPLITS}
    out |= {f"pair_{n}": with_views("recs vecs", f"{_LAB}, {_VEC} {_summary(n)}") for n in pairops.OPERATORS}
    out |= {f"score_{k}": with_views("recs vecs", f"{_LAB}, {_VEC}, {relation} SELECT method, relation, drug_1, drug_2, round({sql}, 6) + 0e0 AS score FROM ab JOIN rw USING (method, relation)") for k, sql in scores.items()}
    return out | {f"{n}_all": out[n] for n in WHOLE}
