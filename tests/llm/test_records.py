"""Copies, co-occurrence, entity groups and splits, near records: small cases against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairlens.llm import cooccurrence, copies, entity_splits, near_records
from pairlens.plans import WorkTables

FIELDS = ("A 1", "A 2", "S")


# --- hidden copies ---------------------------------------------------------------------------

ROWS = [
    (1, "CID1", "CID2", "C1"), (2, "cid-1", "CID 2", "c1"), (3, "CID2", "C1", "CID1"), (4, "CID1", "CID2", "C1"), (5, "CID1", "CID1", "C1"), (6, "CID1", "CID1", "C1 "),
    (7, None, "CID2", "C1"), (8, "--", "CID2", "C1"), (9, "X" * 50_000, "Y", "Z"), (10, "x" * 50_000, "z", "y"), (None, "CID9", "CID8", "C7"), (11, "CID9", "CID8", "C7"), (12, "A|B", "C", "D"), (13, "AB", "C", "D"),
]


def test_copies_of_records(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, `A 1` string, `A 2` string, S string").withColumns({"record": F.lit("x"), "copies": F.lit(9), "n": F.lit(1)})
    got = {r["record"][:20]: (r["copies"], r["spellings"], r["first_row_id"], r["last_row_id"]) for r in copies.collapse_copies(df, FIELDS).collect()}
    assert got == {"C1|CID1|CID2": (4, 3, 1, 4), "C1|CID1|CID1": (2, 2, 5, 6), "X" * 20: (2, 2, 9, 10), "C7|CID8|CID9": (2, 1, 11, 11), "AB|C|D": (2, 2, 12, 13)}
    pairs = {tuple(r) for r in copies.copies_of_records(df, FIELDS, WorkTables(spark, "t")).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (5, 6), (9, 10), (12, 13)}


def test_hot_copies_are_spread(spark):
    """A spelling and a record that hold most rows."""
    rows = [(i, "CID1", "CID2", "C1") for i in range(300)] + [(1000 + i, f"CID{'-' * (i + 1)}1", "CID2", "C1") for i in range(300)] + [(2000 + i, f"CID{i}7", "CID2", "C1") for i in range(30)] * 2
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id bigint, `A 1` string, `A 2` string, S string")
    pairs = {tuple(r) for r in copies.copies_of_records(df, FIELDS, WorkTables(spark, "t")).collect()}
    assert pairs == {(0, i) for i in range(1, 600)} | {(600 + i, 630 + i) for i in range(30)}


def test_copies_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, `A 1` string, `A 2` string, S string")
    assert copies.collapse_copies(df, FIELDS).count() == 0 and copies.copies_of_records(df, FIELDS, WorkTables(spark, "t")).count() == 0


# --- co-occurrence ---------------------------------------------------------------------------


@pytest.mark.parametrize("head,step,rest,most", [(4096, 1 << 20, 1 << 22, 1 << 20), (8, 16, 50, 1000), (0, 7, 1, 3)])
def test_gram_counts(spark, monkeypatch, head, step, rest, most):
    for name, value in (("HEAD", head), ("STEP", step), ("REST", rest), ("MAX_ITEMS", most)):
        monkeypatch.setattr(cooccurrence, name, value)
    rng = random.Random(3)
    baskets = {f"b{i}": {f"i{int(rng.paretovariate(0.6)) % 40:02}" for _ in range(rng.randint(1, 30))} for i in range(200)}
    baskets["hot"] = {f"i{i:02}" for i in range(40)}
    rows = [(b, i) for b, items in baskets.items() for i in items] * 2 + [(None, "i01"), ("b1", None)]
    want: Counter = Counter()
    for items in baskets.values():
        want.update((a, b) for a, b in itertools.combinations_with_replacement(sorted(items), 2))
    import pyarrow as pa

    ordered = sorted(set(rows) - {(None, "i01"), ("b1", None)})
    table = pa.table({"basket": [r[0] for r in ordered], "item": [r[1] for r in ordered]})
    local: Counter = Counter()
    n = 0
    for cells in cooccurrence._gram_cells(iter(table.to_batches(max_chunksize=37))):
        for a, b, k in zip(*(c.to_pylist() for c in cells.columns), strict=True):
            if a is None:
                n += k
            else:
                local[a, b] += k
    assert local == want and n == len(baskets)
    df = spark.createDataFrame(rows, "basket string, item string").withColumn("n", F.lit(1))
    gram = WorkTables(spark, "t").save(cooccurrence.gram_counts(df, "basket", "item"))
    got = {(r["item_1"], r["item_2"]): r["n"] for r in gram.collect()}
    assert got.pop((None, None)) == len(baskets) and got == dict(want)
    lifts = {(r["item_1"], r["item_2"]): r for r in cooccurrence.lift(gram).collect()}
    assert set(lifts) == {p for p in want if p[0] < p[1]}
    for (a, b), r in lifts.items():
        assert r["lift"] == pytest.approx(want[a, b] * len(baskets) / (want[a, a] * want[b, b]))


@pytest.mark.parametrize("vocabulary", [5_000, 60_000, 1_000_000])
def test_gram_memory_is_bounded(vocabulary):
    """Wide vocabularies and one large basket, in a process that may not grow by more than 1 GB."""
    import subprocess
    import sys

    code = f"""
import resource, numpy as np, pyarrow as pa
from pairlens.llm import cooccurrence as c
held = int(open('/proc/self/statm').read().split()[0]) * 4096
resource.setrlimit(resource.RLIMIT_AS, (held + (1 << 30),) * 2)
rng = np.random.default_rng(1)
def batches():
    for b in range(8):
        baskets = np.sort(rng.integers(0, 500, 10_000)) + 1000 * b
        items = np.minimum(rng.pareto(0.3, 10_000), {vocabulary} - 1).astype(int)
        pairs = np.unique(np.stack([baskets, items], 1), axis=0)
        yield pa.record_batch([pa.array([str(x) for x in pairs[:, 0]]), pa.array([f'i{{x}}' for x in pairs[:, 1]])], names=['basket', 'item'])
    yield pa.record_batch([pa.array(['wide'] * 3000), pa.array([f'w{{x}}' for x in range(3000)])], names=['basket', 'item'])
print(sum(x.num_rows for x in c._gram_cells(batches())))
"""
    out = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=__file__.rsplit("/tests", 1)[0])
    assert int(out.stdout) > 4_000_000


def test_gram_of_an_empty_table(spark):
    df = spark.createDataFrame([], "basket string, item string")
    assert cooccurrence.gram_counts(df, "basket", "item").count() == 0


# --- entity groups and splits ------------------------------------------------------------------


def brute_groups(rows):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, *values in rows:
        for v in values:
            if v is not None:
                parent[find(("e", v))] = find(("r", i))
        find(("r", i))
    out = defaultdict(list)
    for i, *_ in rows:
        out[find(("r", i))].append(i)
    return {i: min(g) for g in out.values() for i in g}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops", "none"])
def test_entity_groups(spark, shape):
    rng = random.Random(7)
    n = 120
    rows = {
        "random": [(i, rng.choice([None, *(f"d{rng.randrange(90)}" for _ in range(4))]), rng.choice([None, *(f"d{rng.randrange(90)}" for _ in range(4))])) for i in range(n)],
        "chain": [(i, f"d{i}", f"d{i + 1}") for i in range(n)],
        "star": [(i, "hub", f"d{i % 50}") for i in range(n)],
        "loops": [(i, f"d{i % 9}", f"d{i % 9}") for i in range(n)],
        "none": [(i, None, None) for i in range(5)],
    }[shape]
    df = spark.createDataFrame(rows, "row_id bigint, x string, y string").withColumns({"node": F.lit("q"), "root": F.lit("q")})
    groups = entity_splits.entity_groups(df, "row_id", ["x", "y"], WorkTables(spark, "t"))
    want = brute_groups(rows)
    got = groups.collect()
    assert {r["row_id"]: r["group_id"] for r in got} == want and len(got) == len(rows)
    sizes = Counter(want.values())
    assert all(r["group_rows"] == sizes[r["group_id"]] for r in got)
    assert {tuple(r) for r in entity_splits.rows_but_first(groups).collect()} == {(g, i) for i, g in want.items() if i != g}


def test_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, x string, y string")
    tables = WorkTables(spark, "t")
    groups = entity_splits.entity_groups(df, "row_id", ["x", "y"], tables)
    assert groups.count() == 0
    assert entity_splits.assign_splits(groups, {"train": 0.7, "test": 0.3}, tables).count() == 0


def test_splits_meet_the_shares(spark):
    rng = random.Random(1)
    sizes = [400, 90, 60, 33] + [rng.choice([1, 1, 1, 2, 3, 5, 8]) for _ in range(1500)]
    rows, at = [], 0
    for s in sizes:
        rows += [(i, at, s) for i in range(at, at + s)]
        at += s
    groups = spark.createDataFrame(rows, "row_id bigint, group_id bigint, group_rows bigint")
    shares = {"train": 0.7, "val": 0.1, "test": 0.2}
    assigned = entity_splits.assign_splits(groups, shares, WorkTables(spark, "t"))
    assert sorted(r["group_id"] for r in assigned.collect()) == sorted({r[1] for r in rows})
    for r in entity_splits.split_report(assigned, shares).collect():
        assert r["actual_share"] == pytest.approx(r["target_share"], abs=0.01)


# --- near records ------------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near(e, t):
    (a, b, s), (c, d, u) = e, t
    return edit(s, u) + min(edit(a, c) + edit(b, d), edit(a, d) + edit(b, c)) <= 1


def test_near_records_against_brute_force(spark):
    rng = random.Random(11)

    def typo(x):
        i, k = rng.randrange(len(x)), rng.random()
        return x[:i] + (rng.choice("019AC") if k < 0.7 else "") + x[i + (k > 0.3) :]

    base = [(f"CID{rng.randrange(2)}{rng.randrange(30):08}", f"CID0{rng.randrange(40):08}", f"C{rng.randrange(6):07}") for _ in range(50)] + [("A", "B", "C"), ("A", "", "C"), ("AB", "B", "C"), ("Q" * 3000, "B", "C")]
    rows = []
    for i in range(400):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            j = rng.randrange(3)
            x[j] = typo(x[j]) if x[j] else x[j]
        if rng.random() < 0.5:
            x[0], x[1] = x[1], x[0]
        rows.append((i, *(v.lower() if rng.random() < 0.3 else v for v in x), rng.choice(["train", "train", "test"]), rng.choice(["s1", "s2"])))
    rows += [(900, None, "B", "C", "train", "s1"), (901, "A", "B", "C", "train", None)]
    df = spark.createDataFrame(rows, "row_id bigint, drug_1 string, drug_2 string, side_effect string, fold string, strategy string").withColumns({"text": F.lit(1), "h": F.lit(2)})
    fields, side = ("drug_1", "drug_2", "side_effect"), F.col("fold") == "train"
    tables = WorkTables(spark, "t")
    records = tables.save(near_records.distinct_records(df, "row_id", fields, "strategy", side))
    pairs = tables.save(near_records.near_texts(records))
    member = near_records.members(df, records, "row_id", fields, "strategy", side)
    held = member.filter("NOT is_train").select(F.col("text_id").alias("eval_id"), F.col("row_id").alias("e"))
    train = member.filter("is_train").select(F.col("text_id").alias("train_id"), F.col("row_id").alias("t"))
    got = [(r["e"], r["t"]) for r in pairs.join(held, "eval_id").join(train, "train_id").collect()]
    full = [r for r in rows if all(r[1:4]) and r[5]]
    up = lambda r: tuple(x.upper() for x in r[1:4])
    want = {(e[0], t[0]) for e in full if e[4] == "test" for t in full if t[4] == "train" and e[5] == t[5] and near(up(e), up(t))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert all(r["coverage"] == pytest.approx(1.0) for r in pairs.filter("edits = 0").collect())


def test_near_records_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, drug_1 string, drug_2 string, side_effect string, fold string, strategy string")
    assert near_records.near_texts(near_records.distinct_records(df, "row_id", ("drug_1", "drug_2", "side_effect"), "strategy", F.col("fold") == "train")).count() == 0


def test_near_records_are_not_broadcast(spark):
    """Saved records look small to the planner; their fingerprints are many times as many."""
    rows = [(i, f"CID0{i % 700:08}", f"CID0{i % 500:08}", "C0000001", "train" if i % 3 else "test", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id bigint, drug_1 string, drug_2 string, side_effect string, fold string, strategy string")
    tables = WorkTables(spark, "t")
    fields, side = ("drug_1", "drug_2", "side_effect"), F.col("fold") == "train"
    records = tables.save(near_records.distinct_records(df, "row_id", fields, "strategy", side))
    for frame in (near_records.near_texts(records), near_records.members(df, records, "row_id", fields, "strategy", side)):
        assert frame.count() > 0 and "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
