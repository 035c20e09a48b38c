"""Edge splits, sorted indexes, message passing and kernel components against hand-worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.hashing import sorted_index
from pairlens.operators import graph, reduce, splitting
from pairlens.plans import WorkTables


def test_sorted_index_counts_across_cells(spark):
    keys = [f"CID{i:09d}" for i in (7, 3, 100000001, 100000000, 12)]
    df = spark.createDataFrame([(k, 1) for k in keys] + [(None, 2)], "key string, id_extra int")
    got = {r["key"]: r["id"] for r in sorted_index(df, "key", 4).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert sorted_index(df.limit(0), "key", 4).count() == 0


@pytest.mark.parametrize(("n", "train", "val", "test"), [(0, 0, 0, 0), (1, 0, 0, 1), (10, 9, 0, 1), (200, 162, 18, 20)])
def test_random_edges(spark, n, train, val, test):
    triples = spark.range(n).select(F.lit("r").alias("relation"), F.col("id").cast("string").alias("drug_1"), F.lit("z").alias("drug_2"))
    got = {r["fold"]: r["count"] for r in splitting.random_edges(triples).groupBy("fold").count().collect()}
    assert got == {k: v for k, v in (("train", train), ("val", val), ("test", test)) if v}
    assert splitting.first_edges(triples, 7).count() == min(n, 7)


def test_message_round(spark):
    triples = spark.createDataFrame([("r", "A", "B"), ("r", "A", "C"), ("s", "A", "B"), ("s", "D", "D"), ("t", "E", "F")], "relation string, drug_1 string, drug_2 string")
    vectors = spark.createDataFrame([("A", [1.0, -9.0]), ("B", [2.0, 4.0]), ("C", [4.0, 0.0]), ("D", [1.0, 1.0])], "drug string, vector array<double>")
    got = {r["drug"]: (r["n_relations"], r["vector"]) for r in graph.relation_message_round(triples, vectors, 2).collect()}
    assert got == {"A": (2, [6.0, 0.0]), "B": (2, [4.0, 0.0]), "C": (1, [5.0, 0.0]), "D": (1, [2.0, 2.0])}  # E and F get nothing
    assert graph.relation_message_round(triples.limit(0), vectors, 2).count() == 0


def test_kernel_components_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, None), (99, [1.0])], "id int, v array<double>").repartition(3)
    tables = WorkTables(spark, "test")
    marks = df.filter("id < 30")
    out = {r["id"]: np.array(r["embedding"]) for r in reduce.kernel_components(marks, "id", "v", 5, tables, landmarks=64).collect()}
    k = np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()
    values, axes = np.linalg.eigh(c)
    want = axes[:, -5:] * values[-5:] @ axes[:, -5:].T
    got = np.stack([out[i] for i in range(30)])
    assert np.allclose(got @ got.T, want, atol=1e-6)
    few = reduce.kernel_components(marks, "id", "v", 5, tables, landmarks=8)  # every row is embedded
    assert few.count() == 30
    assert reduce.kernel_components(df.filter("id = 98"), "id", "v", 5, tables).count() == 0
    assert reduce.kernel_components(df.filter("id = 3"), "id", "v", 5, tables).first()["embedding"] == [0.0]
    with pytest.raises(ValueError):
        reduce.kernel_components(df, "id", "v", 5, tables, landmarks=0)
