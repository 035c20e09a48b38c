"""Models of groups: every row scored once, shards bounded, nulls and small groups defined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import group_models, metrics, pairops

FAST = {"gbt_stopped": {"rounds": 30, "rate": 0.3}, "gbt_fixed": {"rounds": 20}, "gbt_balanced": {"rounds": 20}, "mlp": {"hidden": (16,), "rate": 0.1}}
SCHEMA = "row_id long, relation string, label int, fold string, features array<double>"


def _rows(spark, sizes, seed=1):
    """Labels follow the product of two features in one relation and their sum in the others."""
    rng, out = np.random.default_rng(seed), []
    for relation, n in sizes.items():
        for _ in range(n):
            x = rng.normal(size=6)
            label = int((x[0] * x[1] if relation == "a" else x[0] + x[1]) > 0)
            out.append((len(out), relation, label, str(rng.choice(["train", "val", "test"], p=[0.7, 0.1, 0.2])), x.tolist()))
    return spark.createDataFrame(out, SCHEMA)


def test_every_model_learns_its_group_and_scores_each_row_once(spark):
    rows = _rows(spark, {"a": 1500, "b": 1500})
    sharded = group_models.with_shards(rows, ["relation"], "row_id")
    scored = group_models.group_scores(sharded, ["relation"], ["row_id", "fold"], list(group_models.MODELS), FAST).cache()
    held = rows.filter("fold <> 'train'").count()
    assert {r["model"]: r["count"] for r in scored.groupBy("model").count().collect()} == dict.fromkeys(group_models.MODELS, held)
    assert scored.select("model", "row_id").distinct().count() == held * len(group_models.MODELS)
    for r in metrics.ranking_metrics(scored.filter("fold = 'test'"), ["model", "relation"]).collect():
        assert r["auroc"] > 0.85, r


def test_hot_groups_are_spread_without_losing_rows(spark):
    rows = _rows(spark, {"b": 900, "c": 60})
    sharded = group_models.with_shards(rows, ["relation"], "row_id", shard_rows=300).cache()
    assert sharded.count() == 960
    sizes = {(r["relation"], r["shard"]): r["count"] for r in sharded.groupBy("relation", "shard").count().collect()}
    assert {s for k, s in sizes if k == "b"} == {0, 1, 2} and max(sizes.values()) < 400 and sizes["c", 0] == 60
    scored = group_models.group_scores(sharded, ["relation"], ["row_id", "fold"], ["gbt_stopped"], FAST).cache()
    assert scored.count() == rows.filter("fold <> 'train'").count()
    assert metrics.ranking_metrics(scored.filter("relation = 'b'"), ["relation"]).first()["auroc"] > 0.85


def test_small_one_class_null_and_empty_groups(spark):
    x = [1.0, 2.0]
    rows = [(i, "one", 1, "train", x) for i in range(20)] + [(20, "one", 1, "test", x), (21, "one", 0, "test", [None, 1.0]), (22, "one", None, "test", x), (23, "one", 0, "test", None), (24, "one", 0, "test", [float("nan"), 1.0])]
    rows += [(30, "few", 0, "train", x), (31, "few", 1, "val", x), (32, "train only", 1, "train", x), (33, None, 1, "test", x), (34, "one", 0, "test", [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(0))
    got = {r["row_id"]: (r["label"], r["score"]) for r in group_models.group_scores(df, ["relation"], ["row_id"], ["gbt_fixed"]).collect()}
    assert got == {20: (1, round(21 / 22, 6)), 31: (1, round(1 / 3, 6)), 33: (1, 0.5)}  # no fit possible: the smoothed share of positives
    assert group_models.group_scores(df.limit(0), ["relation"], ["row_id"], ["mlp"]).count() == 0
    with pytest.raises(ValueError):
        group_models.group_scores(df, ["relation"], [], ["forest"])


def test_constant_features_and_repeats_fit(spark):
    df = spark.createDataFrame([(i, "a", i % 2, "train" if i < 30 else "test", [1.0, 0.0]) for i in range(40)], SCHEMA).withColumn("shard", F.lit(0))
    for r in group_models.group_scores(df, ["relation"], [], list(group_models.MODELS)).groupBy("model").agg(F.count_distinct("score").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        assert (r["n"], r["rows"]) == (1, 10)


def test_feature_store_fills_missing_blocks(spark):
    v = spark.createDataFrame([("m", "d1", [1.0, 2.0]), ("n", "d1", [3.0, 4.0]), ("n", "d2", [5.0, 6.0]), ("other", "d3", [7.0, 8.0])], "method string, drug string, vector array<double>")
    store = pairops.feature_store(v, {"p": "m", "q": "n"}, 2)
    assert {r["drug"]: (r["p"], r["q"]) for r in store.collect()} == {"d1": ([1.0, 2.0], [3.0, 4.0]), "d2": ([0.0, 0.0], [5.0, 6.0]), "d3": ([0.0, 0.0], [0.0, 0.0])}


def _pairs_and_vectors(spark, seed=3):
    rng = np.random.default_rng(seed)
    pairs = [("ab"[i % 5 == 0], f"d{a:02}", f"d{b:02}", int(a + b > 40), str(rng.choice(["train", "val", "test"], p=[0.6, 0.1, 0.3])), i % 2) for i in range(900) for a, b in [rng.integers(0, 45, 2)] if a != b]
    vectors = [(m, f"d{i:02}", (rng.normal(size=4) + i / 9).astype(np.float32).astype(float).tolist()) for m, n in (("m", 40), ("n", 15)) for i in range(n)]
    vectors += [("m", "d40", [1.0, None, 2.0, 3.0]), ("m", "d41", [float("nan"), 1.0, 2.0, 3.0]), ("m", "d42", []), ("n", "d43", [1.0, 2.0])]
    rows = spark.createDataFrame([*pairs, ("a", "d01", "d02", None, "test", 0)], "relation string, drug_1 string, drug_2 string, label int, fold string, shard int")
    return rows, spark.createDataFrame(vectors, "method string, drug string, vector array<double>")


def test_pair_scores_are_those_of_the_features_which_are_never_shuffled(spark, monkeypatch):
    pairs, vectors = _pairs_and_vectors(spark)
    keep, order = ["drug_1", "drug_2", "fold"], ["method", "relation", "drug_1", "drug_2", "fold", "label", "score"]
    run = lambda: group_models.pair_scores(pairs, vectors, ["relation"], keep, ["gbt_stopped"], FAST)
    rows = lambda df: [tuple(r) for r in df.select(*order).orderBy(*order).collect()]
    want = rows(group_models.group_scores(pairops.pair_features(pairs, vectors, "hadamard_absdiff"), ["relation", "method"], keep, ["gbt_stopped"], FAST))
    monkeypatch.setattr(group_models, "LOOKED_UP", 50)
    scored = run()
    exchanges = [line for line in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and rows(scored) == want and len(want) > 200  # one shuffle, of rows that have no features
    assert not any("features" in line or "vector" in line for line in exchanges)
    monkeypatch.setattr(group_models, "MAX_HELD", 0)
    assert rows(run()) == want
    monkeypatch.undo()
    assert group_models.pair_scores(pairs, vectors.limit(0), ["relation"], keep, ["gbt_stopped"]).count() == 0


def test_vectors_keep_their_digits(spark):
    df = spark.createDataFrame([("m", "a", [0.1, 0.2])], "method string, drug string, vector array<double>")
    assert group_models._vectors(df).value.numbers.tolist() == [0.1, 0.2]


def test_histogram_sums(spark):
    rng = np.random.default_rng(2)
    codes, v = rng.integers(0, 9, (70, 5)), rng.integers(-99, 99, 70) / 64
    want = np.stack([np.bincount(codes[:, j], v, 12) for j in range(5)])
    assert np.array_equal(group_models._Histograms(codes, 12)(v).reshape(5, 12), want)


def test_negative_ablation_makes_no_features_outside_its_tasks(spark, data_dir, monkeypatch):
    from pairlens.plans import model_queries
    from pairlens.plans.worktables import WorkTables

    def never(*_):
        raise AssertionError("features of pairs are shuffled")

    monkeypatch.setattr(pairops, "pair_features", never)
    saved, save = set(), WorkTables.save
    monkeypatch.setattr(WorkTables, "save", lambda self, df, name="t", **kw: saved.add((id(self), name)) or save(self, df, name, **kw))
    cleared, clear = [], WorkTables.clear
    monkeypatch.setattr(WorkTables, "clear", lambda self: cleared.append(id(self)) or clear(self))
    got = model_queries.queries()["negative_ablation"](spark, data_dir)
    assert got.columns[:2] == ["negatives", "method"] and got.count()
    assert not any(name in ("positives", "labelled") and own not in cleared for own, name in saved) and len(cleared) == 2
