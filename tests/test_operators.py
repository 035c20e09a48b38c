"""Invariants and hand-worked cases of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import canonical_text, clean_value, is_complete
from pairlens.functions.hashing import hashed_rank
from pairlens.operators import explore, graph, metrics, models, pairops, reduce, sampling, splitting
from pairlens.plans import WorkTables, model_queries, pair_queries

COMBO = [("r1", "A", "B"), ("r1", "A", "C"), ("r2", "B", "C"), ("r2", "A", "B"), ("r3", "D", "E"), ("r1", "A", "A")]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(COMBO, "relation string, drug_1 string, drug_2 string")


@pytest.fixture(scope="module")
def many(spark):
    rows = [(f"r{r}", f"d{min(i, j):03}", f"d{max(i, j):03}", (i + j + r) % 2) for r in range(3) for i in range(40) for j in (i + 1, i + 3 + r)]
    return spark.createDataFrame(rows, "relation string, drug_1 string, drug_2 string, label int")


def test_cleaning(spark):
    df = spark.createDataFrame([(" cid-1 ", "B_2", "c3"), (None, "b", "c"), ("--", "b", "c"), ("ß", "é1", "")], "a string, b string, c string")
    assert [r[0] for r in df.select(clean_value(F.col("a"))).collect()] == ["CID1", None, None, "SS"]
    text = canonical_text([F.col(c) for c in "abc"])
    got = [(r[0], r[1]) for r in df.select(text.alias("t")).select("t", is_complete(F.col("t"))).collect()]
    assert got == [("B2|C3|CID1", True), ("|B|C", False), ("|B|C", False), ("|1|SS", False)]


def test_hashed_rank_is_a_ranking_with_null_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    for key, part in df.toPandas().groupby("g", dropna=False):
        got = [r for r in hashed_rank(df, ["g"], "h").collect() if (r["g"] is None and math.isnan(key)) or r["g"] == key]
        assert sorted((r["h"], r["rank"]) for r in got) == [(h, i) for i, h in enumerate(sorted(part["h"]))]
        assert {r["group_size"] for r in got} == {len(part)}


def test_coverage_and_degree(spark, triples):
    targets = spark.createDataFrame([("A", 1), ("A", 2), ("C", 99)], "drug string, gene bigint")
    got = {r["relation"]: (r["n_drugs"], r["n_missing"], r["n_pairs"], r["n_both_missing"]) for r in explore.relation_coverage(triples, targets).collect()}
    assert got == {"r1": (3, 1, 3, 0), "r2": (3, 1, 2, 0), "r3": (2, 2, 1, 1)}
    degree = {r["drug"]: r["degree"] for r in explore.degrees(triples).collect()}
    assert degree == {"A": 5, "B": 3, "C": 2, "D": 1, "E": 1}


@pytest.mark.parametrize("ratio", [0.5, 2.0])
@pytest.mark.parametrize("strategy", ["random", "structured"])
def test_negatives_have_their_number(spark, many, strategy, ratio):
    hot = [("hot", f"d{i:03}", f"d{j:03}") for i in range(30) for j in range(i + 1, 30) if (i * j) % 5]
    t = many.select("relation", "drug_1", "drug_2").distinct().unionByName(spark.createDataFrame([*hot, ("self", "d001", "d001")], "relation string, drug_1 string, drug_2 string"))
    pos = {tuple(r) for r in t.collect()}
    neg = [tuple(r) for r in sampling.sample_negatives(t, strategy, ratio=ratio).collect()]
    drugs = {d for p in pos for d in p[1:]}
    assert len(set(neg)) == len(neg) and not pos & set(neg) and all(a < b and {a, b} <= drugs for _, a, b in neg)
    known = {p[1:] for p in pos if p[1] != p[2]}
    for relation in {p[0] for p in pos}:
        own = {p[1:] for p in pos if p[0] == relation}
        wanted = max(1, int(len(own) * ratio))
        apart = len([p for p in own if p[0] != p[1]])
        assert sum(r[0] == relation for r in neg) == min(wanted, len(drugs) * (len(drugs) - 1) // 2 - apart)
        if strategy == "structured":
            assert sum(r[0] == relation and r[1:] in known for r in neg) == min(wanted, len(known - own))
    assert sorted(neg) == sorted(tuple(r) for r in sampling.sample_negatives(t.repartition(7), strategy, ratio=ratio).collect())


@pytest.mark.parametrize("strategy", ["random", "structured"])
def test_negatives_are_not_broadcast(spark, many, strategy, monkeypatch):
    """Blocks of places look small to the planner, the pairs that come out of them are many."""
    frames = []
    save = WorkTables.save
    monkeypatch.setattr(WorkTables, "save", lambda self, df, name="t", **kw: frames.append((name, df)) or save(self, df, name, **kw))
    neg = sampling.sample_negatives(many.select("relation", "drug_1", "drug_2").distinct(), strategy)
    for df in [neg] if strategy == "random" else [df for name, df in frames if name == "known"]:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        above = plan.split("Generate explode(slice(")[0]
        assert "Generate explode(slice(" in plan and "BroadcastHashJoin" not in above and "SortMergeJoin" in above


@pytest.mark.parametrize("strategy", ["random", "structured"])
def test_negatives_of_full_and_empty_tables(spark, strategy):
    full = spark.createDataFrame([("all", "A", "B"), ("all", "A", "C"), ("all", "B", "C")], "relation string, drug_1 string, drug_2 string")
    assert sampling.sample_negatives(full, strategy).count() == 0
    assert sampling.sample_negatives(full.limit(0), strategy).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_negatives(full, "other")


@pytest.mark.parametrize("strategy", sorted(splitting.STRATEGIES))
def test_folds_partition_the_rows(many, strategy):
    folded = splitting.split(many, strategy)
    assert sorted(map(tuple, folded.select(*many.columns).collect())) == sorted(map(tuple, many.collect()))
    assert {r["fold"] for r in folded.collect()} == {"train", "val", "test"}
    if strategy == "drug_cold_start":
        held = {r["drug"] for r in splitting.heldout_drugs(many).collect()}
        for r in folded.collect():
            assert (r["fold"] == "test") == bool({r["drug_1"], r["drug_2"]} & held)
    if strategy == "random_pair":
        n = {(r["relation"], r["fold"]): r["count"] for r in folded.groupBy("relation", "fold").count().collect()}
        assert all(n[f"r{i}", "train"] == 56 and n[f"r{i}", "val"] == 8 for i in range(3))


@pytest.mark.parametrize("n,train,held_test", [(1, 1, 0), (2, 2, 0), (3, 2, 1), (10, 6, 3), (24, 16, 6)])
def test_stratified_sizes(spark, n, train, held_test):
    df = spark.createDataFrame([("r", f"a{i}", f"b{i}", 1) for i in range(n)], "relation string, drug_1 string, drug_2 string, label int")
    got = [r["fold"] for r in splitting.stratified_pair(df).collect()]
    assert got.count("train") == train and got.count("test") == held_test


def test_weak_nodes_never_train(triples):
    weak = {r["drug"] for r in splitting.weak_nodes(triples, 2).collect()}
    assert weak == {"D", "E"}
    assert all((r["fold"] == "train") != bool({r["drug_1"], r["drug_2"]} & weak) for r in splitting.weak_node(triples, 2).collect())


def test_pair_operators(spark):
    df = spark.createDataFrame([([1.0, -2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    want = {"hadamard": [3, -8], "absdiff": [2, 6], "hadamard_absdiff": [3, -8, 2, 6], "concat_sym": [2, 1, 2, 1], "sum": [4, 2], "concat": [1, -2, 3, 4]}
    for name, (build, width) in pairops.OPERATORS.items():
        ab = df.select(build(F.col("a"), F.col("b"))).first()[0]
        ba = df.select(build(F.col("b"), F.col("a"))).first()[0]
        assert ab == want[name] and len(ab) == 2 * width == pairops.output_dim(name, 2)
        assert (ab == ba) == (name != "concat")
    with pytest.raises(ValueError):
        pairops.output_dim("other", 2)
    with pytest.raises(ValueError):
        pairops.feature_mode(F.col("a"), F.col("a"), F.col("a"), "other")


def test_labelled_pairs_of_every_row_and_method(spark, tmp_path):
    rows = [(i, f"CID{i:09}", f"CID{i + 1:09}", "C0000001", i % 2, "train", s, "positive") for i, s in enumerate(["random_pair", "stratified_pair", "drug_cold_start"] * 4, 1)]
    spark.createDataFrame(rows, "row_id bigint, drug_1 string, drug_2 string, side_effect string, label int, fold string, strategy string, source string").write.parquet(f"{tmp_path}/split_rows.parquet")
    vectors = [(10 * i + k, f"CID{i:09}", m, [float(i)] * 64, True, 0.0) for i in range(1, 14) for k, m in enumerate(["graph_svd", "pca"]) if m == "pca" or i < 4]
    spark.createDataFrame(vectors, "vec_id bigint, STITCH string, method string, embeddings array<double>, has_target boolean, fit_time_s double").write.parquet(f"{tmp_path}/embedding_result.parquet")
    q = pair_queries.queries()
    assert q["split_random_pair_all"](spark, str(tmp_path)).count() == 12
    assert {(r["method"], r["n_pairs"]) for r in q["compare_operators_all"](spark, str(tmp_path)).collect()} == {("graph_svd", 2), ("pca", 12)}
    for name in ("pair_hadamard_all", "score_distmult_all"):
        assert q[name](spark, str(tmp_path)).count() == 14


def test_metrics_on_ties_and_one_class(spark):
    rows = [("g", y, s) for y, s in zip([1, 0, 1, 0, 1], [0.9, 0.8, 0.8, 0.3, 0.3], strict=True)] + [("one", 1, 0.4), ("one", 1, 0.2)] + [("tie", y, 0.5) for y in (0, 1, 1, 0)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r["g"]: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    assert got["g"]["auroc"] == round((2 + 1.5 + 0.5) / 6, 4) and got["tie"]["auroc"] == 0.5
    assert got["g"]["ap"] == round(1 / 3 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5, 4)
    assert got["one"]["auroc"] is None and got["one"]["ap"] is None
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert {r["g"]: r["auroc"] for r in metrics.ranking_metrics(flipped, ["g"]).collect()}["g"] == pytest.approx(1 - got["g"]["auroc"], abs=1e-4)
    t = {r["g"]: (r["f1"], r["precision"], r["recall"]) for r in metrics.threshold_metrics(df, ["g"]).collect()}
    assert t["g"] == (0.6667, 0.6667, 0.6667) and t["one"] == (None, None, None)
    assert {r["g"]: r["threshold"] for r in metrics.best_f1(df, ["g"]).collect()}["tie"] == 0.5


def test_cold_start_in_place_has_the_folds_of_cold_start(spark):
    t = spark.createDataFrame([(f"C{i % 4 % 3}", f"d{i % 37:02}", f"e{i % 61:02}", k) for i in range(600) for k in (0, 1)] + [("few", "d01", "e01", 1)], "relation string, drug_1 string, drug_2 string, label int")
    got = splitting.cold_start_in_place(t.withColumn("kind", F.lit("k")), ["kind", "relation"], t, WorkTables(spark, "test"))
    want = splitting.split(t, "drug_cold_start")
    columns = ["relation", "drug_1", "drug_2", "label", "fold"]
    folds = sorted(tuple(r) for r in want.select(columns).collect())
    assert sorted(tuple(r) for r in got.select(columns).collect()) == folds and {f[-1] for f in folds} == {"train", "val", "test"}
    sizes = {r["relation"]: r["count"] for r in t.groupBy("relation").count().collect()}
    assert {(r["relation"], r["group_size"]) for r in got.collect()} == set(sizes.items())
    assert splitting.cold_start_in_place(t.limit(0), ["relation"], t.limit(0), WorkTables(spark, "test")).count() == 0


def test_quartiles_and_std(spark):
    meta = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), ("c", 3, 3.0), ("d", 10, 10.0)], "relation string, n int, m double")
    assert {r["relation"]: r["size_bin"] for r in metrics.quartile_strata(meta, "n", "m").collect()} == {"a": "very_low", "b": "low", "c": "medium", "d": "high"}
    assert metrics.mean_and_std(meta.filter("relation = 'a'"), ["relation"], ["m"]).first()["m_std"] is None


PPI = [(1, 2), (2, 3), (2, 1), (4, 4)]


def test_graph(spark):
    ppi = spark.createDataFrame(PPI, "gene_1 bigint, gene_2 bigint")
    w = {(r["src"], r["dst"]): r["w"] for r in graph.row_normalised(ppi).collect()}
    assert w == {(1, 2): 1.0, (2, 1): 0.5, (2, 3): 0.5, (3, 2): 1.0, (4, 4): 1.0}
    s = {(r["src"], r["dst"]): r["w"] for r in graph.symmetric_normalised(ppi).collect()}
    assert s[4, 4] == pytest.approx(1.0) and s[1, 2] == pytest.approx(2 / math.sqrt(3 * 4)) and s[2, 1] == s[1, 2]
    targets = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("C", 99)], "drug string, gene bigint")
    x = graph.target_profiles(targets, ppi)
    assert {r["drug"] for r in x.collect()} == {"A", "B"}
    tables = WorkTables(spark, "test")
    h = {(r["drug"], r["gene"]): r["x"] for r in graph.propagate(x, ppi, 1, tables).collect()}
    assert h == {("A", 1): 1.0, ("A", 2): 0.5, ("A", 3): 1.0, ("B", 1): 1.0, ("B", 3): 1.0}
    ones = spark.createDataFrame([("A", i, 1.0) for i in (1, 2, 3, 4)], "drug string, gene bigint, x double")
    assert all(r["x"] == pytest.approx(1.0) for r in graph.propagate(ones, ppi, 3, tables).collect())
    settled = graph.diffuse(x, graph.row_normalised(ppi), 0.5, 0.5, 60, tables, 1e-6)
    again = graph.diffuse(x, graph.row_normalised(ppi), 0.5, 0.5, 80, tables)
    a, b = ({(r["drug"], r["gene"]): r["x"] for r in d.collect()} for d in (settled, again))
    assert a == {k: pytest.approx(v, abs=1e-4) for k, v in b.items()}


def test_profiles_are_filled_inside_tasks(spark, monkeypatch):
    """No shuffle or saved table holds filled profiles; joins of a network that is too large give the same."""
    import random

    rng = random.Random(5)
    ppi = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(150)], "gene_1 bigint, gene_2 bigint")
    targets = spark.createDataFrame([(f"d{i:02}", rng.randrange(70)) for i in range(90) for _ in range(2)], "drug string, gene bigint").distinct()
    x, tables, saved = graph.target_profiles(targets, ppi), WorkTables(spark, "test"), []
    save = WorkTables.save
    monkeypatch.setattr(WorkTables, "save", lambda self, df, name="t", **kw: saved.append(name) or save(self, df, name, **kw))
    runs = [
        lambda **kw: graph.propagate(x, ppi, 2, tables, **kw),
        lambda **kw: graph.diffuse(x, graph.symmetric_normalised(ppi), 0.85, 0.15, 2, tables, **kw),
        lambda **kw: graph.diffuse(x, graph.symmetric_normalised(ppi), 0.85, 0.15, 30, tables, 1e-3, **kw),
    ]
    monkeypatch.setattr(graph, "EDGES", 64)
    local = [{(r["drug"], r["gene"]): r["x"] for r in run().collect()} for run in runs]
    sums = [{r["drug"]: (r["n_genes"], r["total"], r["largest"]) for r in run(summed=True).collect()} for run in runs]
    assert set(saved) == {"start", "weights", "rounds"}  # rounds: sums
    monkeypatch.setattr(graph, "MAX_EDGES", 0)
    for run, values, summary in zip(runs, local, sums, strict=True):
        joined = {(r["drug"], r["gene"]): r["x"] for r in run().collect()}
        assert values == {k: pytest.approx(v) for k, v in joined.items()} and len(values) > 1000
        of = {d: [v for (e, _), v in joined.items() if e == d] for d, _ in joined}
        assert summary == {d: (len(v), pytest.approx(sum(v)), pytest.approx(max(v))) for d, v in of.items()}


@pytest.mark.parametrize("tolerance,rounds,first,witnesses", [(1e-3, 30, 15, 64), (1e-4, 30, 4, 1), (1e-9, 6, 15, 64), (0.5, 30, 15, 1), (5.0, 30, 15, 1)])
def test_settled_sums_are_those_of_the_filled_profiles(spark, monkeypatch, tolerance, rounds, first, witnesses):
    import random

    rng = random.Random(7)
    ppi = spark.createDataFrame([(rng.randrange(80), rng.randrange(80)) for _ in range(110)], "gene_1 bigint, gene_2 bigint")
    x = graph.target_profiles(spark.createDataFrame([(f"d{i:02}", rng.randrange(90)) for i in range(90) for _ in range(1 + i % 6)], "drug string, gene bigint").distinct(), ppi)
    weights, tables = graph.symmetric_normalised(ppi), WorkTables(spark, "test")
    for name, value in (("FIRST_ROUNDS", first), ("WITNESSES", witnesses), ("WORDS", 1), ("EDGES", 64)):
        monkeypatch.setattr(graph, name, value)
    of = lambda df: {r["drug"]: (r["n_genes"], pytest.approx(r["total"], abs=1e-9)) for r in df.collect()}
    want = of(graph.diffuse(x, weights, 0.85, 0.15, rounds, tables, tolerance, summed=True))
    assert of(graph.settled_sums(x, weights, 0.85, 0.15, rounds, tables, tolerance)) == want and len(want) > 70
    assert graph.settled_sums(x.filter("gene < 0"), weights, 0.85, 0.15, rounds, tables, tolerance).count() == 0


def test_converged_walk_never_fills_all_drugs(spark, data_dir, monkeypatch):
    def never(*_):
        raise AssertionError("all drugs are filled in every round")

    monkeypatch.setattr(graph, "_round_sums", never)
    assert model_queries.queries()["rwr_converged"](spark, data_dir).count()


def test_jaccard_and_edges(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9), ("b", 3)], "drug string, gene int")
    similar = graph.jaccard(sets, "drug", "gene")
    assert [tuple(r) for r in similar.collect()] == [("a", "b", 1, pytest.approx(1 / 3))]
    assert sorted(tuple(r) for r in graph.similarity_edges(similar).collect()) == [("a", "b", pytest.approx(1 / 3)), ("b", "a", pytest.approx(1 / 3))]


@pytest.mark.parametrize("t", [0.3, 0.5, 1.0])
def test_jaccard_against_brute_force(spark, t):
    import random

    rng = random.Random(2)
    sets = {f"d{i:02}": {int(rng.paretovariate(0.7)) % 25 for _ in range(rng.randint(1, 9))} for i in range(60)}
    df = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s] * 2 + [("d01", None), (None, 1)], "drug string, gene int")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r["id_1"], r["id_2"]): r["similarity"] for r in graph.jaccard(df, "drug", "gene", t).collect()}
    assert got == {p: pytest.approx(v) for p, v in want.items() if v >= t}


@pytest.mark.parametrize("held", [4_000_000, 20])
def test_jaccard_keeps_candidates_inside_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "MAX_HELD", held, raising=False)
    monkeypatch.setattr(graph, "STEP", 16, raising=False)
    sets = {f"d{i:02}": {0, 100 + i % 7, 200 + i, 300 + i % 3} for i in range(40)} | {"x": {0}, "y": {0, 100}}
    df = spark.createDataFrame([(d, x) for d, s in sets.items() for x in s], "drug string, gene int")
    similar = graph.jaccard(df, "drug", "gene", 0.4)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r["id_1"], r["id_2"]): r["similarity"] for r in similar.collect()} == {p: pytest.approx(v) for p, v in want.items() if v >= 0.4}
    exchanges = [line for line in similar._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not any("id_1" in line or "id_2" in line for line in exchanges)  # pairs are never shuffled
    assert graph.jaccard(df.filter("gene < 0"), "drug", "gene").count() == 0


def test_svd_against_numpy(spark):

    rng = np.random.default_rng(0)
    a = rng.random((12, 6)) * (rng.random((12, 6)) < 0.6)
    a[:, 0] += 0.1
    long = spark.createDataFrame([(f"d{i}", j, float(a[i, j])) for i in range(12) for j in range(6) if a[i, j]], "drug string, gene int, x double")
    z = {r["drug"]: np.array(r["embedding"]) for r in reduce.svd_embedding(long, "drug", "gene", "x", 3).collect()}
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = (u[:, :3] * s[:3]) @ (u[:, :3] * s[:3]).T
    got = np.array([[z[f"d{i}"] @ z[f"d{j}"] for j in range(12)] for i in range(12)])
    assert np.allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("keep,restart,blocks", [(1.0, 0.0, 12), (0.85, 0.15, 12), (0.85, 0.15, 1)])
def test_filled_svd_is_that_of_the_long_rows(spark, monkeypatch, keep, restart, blocks):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(reduce, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(reduce, "SPARE", 2)
    monkeypatch.setattr(reduce, "GENES", 16)
    ppi = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 90, (240, 2))], "gene_1 bigint, gene_2 bigint")
    drugs = [(f"d{i:02}", int(x)) for i in range(70) for x in rng.choice(95, 1 + i % 5, replace=False)] + [("far", 200)]
    x = graph.target_profiles(spark.createDataFrame(drugs, "drug string, gene bigint"), ppi)

    def dots(df):
        z = {r["drug"]: np.array(r["embedding"]) for r in df.collect()}
        assert "far" not in z and len(z) > 60
        return np.array([[z[a] @ z[b] for b in sorted(z)] for a in sorted(z)])

    long = graph.diffuse(x, graph.row_normalised(ppi), keep, restart, 2, WorkTables(spark, "t"))
    want = dots(reduce.svd_embedding(long.filter("x <> 0"), "drug", "gene", "x", 4))
    assert np.allclose(dots(reduce.filled_svd(x, ppi, 2, 4, WorkTables(spark, "t"), keep, restart)), want, atol=1e-8)
    monkeypatch.setattr(graph, "MAX_EDGES", 0)
    assert np.allclose(dots(reduce.filled_svd(x, ppi, 2, 4, WorkTables(spark, "t"), keep, restart)), want, atol=1e-8)


def test_filled_svd_of_few_rows(spark):
    ppi = spark.createDataFrame([(1, 2), (2, 3)], "gene_1 bigint, gene_2 bigint")
    x = graph.target_profiles(spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "drug string, gene bigint"), ppi)
    got = reduce.filled_svd(x, ppi, 2, 16, WorkTables(spark, "t")).collect()
    assert sorted(r["drug"] for r in got) == ["a", "b", "c"] and {len(r["embedding"]) for r in got} == {2}
    assert reduce.filled_svd(x.filter("gene > 3"), ppi, 2, 16, WorkTables(spark, "t")).count() == 0


@pytest.mark.parametrize("name", ["svd_embedding", "diffused_svd"])
def test_svd_queries_never_fill_the_profiles(spark, data_dir, monkeypatch, name):
    from pairlens.sources import graph_views as g

    saved, save = [], WorkTables.save

    def counted(self, df, *args, **kw):
        copy = save(self, df, *args, **kw)
        saved.append(copy.count())
        return copy

    monkeypatch.setattr(WorkTables, "save", counted)
    got = model_queries.queries()[name](spark, data_dir)
    bounds = g.targets(spark, data_dir).count(), 2 * g.ppi(spark, data_dir).count()
    assert got.count() and len(saved) >= 1 and max(saved) <= max(bounds)


def test_ridge_against_numpy(spark):

    rng = np.random.default_rng(1)
    x, w = rng.random((20, 3)), rng.random((3, 2))
    y = x @ w
    f = spark.createDataFrame([(f"d{i:02}", x[i].tolist()) for i in range(20)], "drug string, features array<double>")
    known = spark.createDataFrame([(f"d{i:02}", y[i].tolist()) for i in range(15)], "drug string, vector array<double>")
    out = {r["drug"]: r for r in reduce.ridge_map(f, known, "drug").collect()}
    coef = np.linalg.solve(x[:15].T @ x[:15] + np.eye(3), x[:15].T @ y[:15])
    assert all(out[f"d{i:02}"]["is_known"] == (i < 15) for i in range(20))
    assert np.allclose(out["d19"]["vector"], x[19] @ coef) and np.allclose(out["d03"]["vector"], y[3])


def test_ridge_query_keeps_whole_vectors(spark, tmp_path):

    rng = np.random.default_rng(4)
    x = rng.random((80, 64)).round(3)
    y = (x @ rng.random((64, 64))).round(3)
    rows = [(2 * i + k, f"CID{i:09}", m, v[i].tolist(), True, 0.0) for i in range(80) for k, (m, v) in enumerate([("graph_svd", x), ("node2vec", y)]) if k == 0 or i < 70]
    spark.createDataFrame(rows, "vec_id bigint, STITCH string, method string, embeddings array<double>, has_target boolean, fit_time_s double").write.parquet(f"{tmp_path}/embedding_result.parquet")
    out = {r["drug"]: r for r in model_queries.queries()["ridge_coldstart"](spark, str(tmp_path)).collect()}
    coef = np.linalg.solve(x[:70].T @ x[:70] + np.eye(64), x[:70].T @ y[:70])
    assert all(np.allclose(out[f"CID{i:09}"]["vector"], y[i] if i < 70 else x[i] @ coef, atol=1e-4) for i in range(80))
    assert all(out[f"CID{i:09}"]["is_known"] == (i < 70) for i in range(80))


def test_boosted_trees_learn(spark):
    rows = [(f"f{i % 2}", "train" if i % 3 else "test", int((i * 7) % 10 > 4), [float((i * 7) % 10), float(i % 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "relation string, fold string, label int, features array<double>")
    assert metrics.ranking_metrics(models.gbt_scores(df, ["fold"], category="relation"), ["fold"]).first()["auroc"] > 0.95
    assert metrics.ranking_metrics(models.mlp_scores(df, ["fold"], hidden=(8,)), ["fold"]).first()["auroc"] > 0.9


def test_every_relation_is_a_category(spark):
    """The label is a relation's alone, and there are more relations than bins by default."""
    rows = [(f"r{i:02}", fold, i % 2, [float(k)]) for i in range(40) for k, fold in enumerate(["train", "train", "test"])]
    df = spark.createDataFrame(rows, "relation string, fold string, label int, features array<double>")
    for scores in (models.gbt_scores, models.mlp_scores):
        scored = scores(df, ["relation", "fold"], category="relation")
        assert scored.select("relation").distinct().count() == 40
        assert metrics.ranking_metrics(scored, ["fold"]).first()["auroc"] > 0.95
    single = df.filter("features[0] <> 1")  # as many training rows as relations
    assert models.gbt_scores(single, ["relation"], rounds=2, category="relation").count() == 40


def test_products_beyond_64_bits(spark):
    q = (1 << 42) - 11
    rows = [(q - 1 - i, q - 7 * i - 1) for i in range(50)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(sampling._product_mod(F.col("a"), F.col("b"), q).alias("p")).collect()
    assert [r["p"] for r in got] == [a * b % q for a, b in rows]


def test_scores_with_real_tables_against_numpy(spark):
    rng = np.random.default_rng(5)
    names = ("h1", "h2", "h3", "r1", "r2", "r3", "t1", "t2", "t3")
    x = {n: rng.normal(size=(20, 6)) for n in names}
    weights, bases, m = rng.normal(size=(20, 3)), rng.normal(size=(3, 6, 6)), []
    rows = [(i, *([float(v) for v in x[n][i]] for n in names), [float(v) for v in weights[i]], bases.tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} array<double>" for n in names) + ", w array<double>, b array<array<array<double>>>")
    c = F.col
    scored = df.select(
        "i",
        pairops.simple_score(c("h1"), c("r1"), c("t2"), c("h2"), c("r2"), c("t1")).alias("simple"),
        pairops.trivec_score((c("h1"), c("h2"), c("h3")), (c("r1"), c("r2"), c("r3")), (c("t1"), c("t2"), c("t3"))).alias("trivec"),
        pairops.bilinear_score(c("h1"), pairops.basis_matrix(c("w"), c("b")), c("t1")).alias("bilinear"),
    ).orderBy("i").toPandas()
    three = lambda a, b, d: (x[a] * x[b] * x[d]).sum(axis=1)
    assert np.allclose(scored["simple"], (three("h1", "r1", "t2") + three("h2", "r2", "t1")) / 2)
    assert np.allclose(scored["trivec"], three("h1", "r1", "t3") + three("h2", "r2", "t2") + three("h3", "r3", "t1"))
    assert np.allclose(scored["bilinear"], np.einsum("nd,nde,ne->n", x["h1"], np.einsum("nk,kde->nde", weights, bases), x["t1"]))


def test_ranking_metrics_with_many_scores_and_null_groups(spark):
    """Cells of the score change nothing, whatever its range."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 3 else "a", int(rng.random() < 0.4), float(np.round(rng.normal() * 30, 2))) for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, label int, score double")
    got = {r["grp"]: r["auroc"] for r in metrics.ranking_metrics(df, ["grp"]).collect()}
    for grp in (None, "a"):
        pos = np.array([s for k, y, s in rows if k == grp and y])
        neg = np.array([s for k, y, s in rows if k == grp and not y])
        want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
        assert got[grp] == pytest.approx(want, abs=1e-4)
