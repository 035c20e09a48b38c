from collections import Counter

from pyspark.sql import functions as F

from pairlens.functions import clean_value
from pairlens.operators.eager_join import eager_join_aggregate, heavy_keys


def test_equals_join_then_group_with_nulls_and_repeats(spark):
    left = [("a", "x", 1), ("a", "x", 2), ("a", "y", None), ("b", None, 5), (None, "x", 7), ("c", "x", 1)]
    right = [("a", 10, "r"), ("a", 20, "s"), ("b", None, "r"), (None, 1, "r"), ("d", 4, "r")]
    l = spark.createDataFrame(left, "k string, g string, v int").withColumn("l_n", F.lit(0))  # a clashing extra column
    r = spark.createDataFrame(right, "k string, w int, h string")
    got = {(x["g"], x["h"]): (x["join_rows"], x["sum_v"], x["sum_w"]) for x in eager_join_aggregate(l, r, ["k"], ["g"], ["h"], ["v"], ["w"]).collect()}
    want: dict = {}
    for k, g, v in left:
        for k2, w, h in right:
            if k is not None and k == k2:
                n, sv, sw = want.get((g, h), (0, None, None))
                want[g, h] = (n + 1, sv if v is None else (sv or 0) + v, sw if w is None else (sw or 0) + w)
    assert got == want


def test_heavy_keys_against_counting(spark):
    rows = [("CID 1",)] * 30 + [("cid-1",)] * 21 + [("x",)] * 20 + [("y",)] * 19 + [(None,)] * 5 + [(" - ",)] * 5 + [(f"z{i}",) for i in range(900)]
    df = spark.createDataFrame(rows, "`A B` string").withColumn("spelling", F.lit("CID1"))
    got = {(r["key_value"], r["key_rows"]) for r in heavy_keys(df, ["A B"], clean_value).collect()}
    assert got == {("CID1", 51), ("X", 20)}  # 20 of 1000 rows is exactly the share
    assert Counter(r["all_rows"] for r in heavy_keys(df, ["A B"], clean_value).collect()) == {1000: 2}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "`A B` string")
    assert heavy_keys(empty, ["A B"], clean_value).count() == 0
    e = spark.createDataFrame([], "k string, g string")
    assert eager_join_aggregate(e, e.withColumnRenamed("g", "h"), ["k"], ["g"], ["h"]).count() == 0
