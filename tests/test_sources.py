import pytest

from pairlens.sources import merge_keep_first, read_csv, table, write_result


def test_csv_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, None)], "`Gene 1` bigint, `Gene 2` bigint")
    write_result(df, str(tmp_path / "ppi"), "csv")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "ppi"), "ppi").collect()), key=repr) == [(1, 2), (3, None)]
    with pytest.raises(Exception, match="(?i)header|column|schema"):
        read_csv(spark, str(tmp_path / "ppi"), "mono").collect()
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "ppi"), "other")
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "x"), "png")


def test_table_fails_fast(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "mono.parquet"))
    with pytest.raises(ValueError, match="lacks the columns"):
        table(spark, str(tmp_path), "mono")


def test_merge_keeps_the_first(spark):
    old = spark.createDataFrame([("a", "x"), ("b", None), (None, "n")], "k string, v string")
    new = spark.createDataFrame([("a", "y", 1), ("b", "z", 2), ("c", "w", 3), ("c", "q", 4)], "k string, v string, extra int")
    got = {r["k"]: (r["v"], r["extra"]) for r in merge_keep_first([old, new], ["k"]).collect()}
    assert got == {"a": ("x", None), "b": (None, None), None: ("n", None), "c": ("q", 4)}


def test_cached_tables_follow_inputs_and_parameters(spark, tmp_path):
    from pairlens.plans.worktables import cached, drop_cached

    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path).filter("id >= 1")

    assert cached(spark, "t", [path], build, least=1).count() == 4
    assert cached(spark, "t", [path], build, least=1).count() == 4 and len(built) == 1
    cached(spark, "t", [path], build, least=2)
    assert len(built) == 2
    spark.range(9).write.mode("overwrite").parquet(path)
    assert cached(spark, "t", [path], build, least=1).count() == 8 and len(built) == 3
    drop_cached(spark)
    cached(spark, "t", [path], build, least=1)
    assert len(built) == 4


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from pairlens.plans.worktables import shared_dir

    context = SimpleNamespace(master="yarn", applicationId="a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs:///x/"}, sparkContext=context)) == "hdfs:///x"
