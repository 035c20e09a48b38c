"""Splits that keep related records together.

Entities that stand in one record are joined by an edge.  Connected groups come from
Boruvka-style contraction: in each round every group picks its minimum edge to another
group, the picked edges are the forest's next level, trees of picked edges are contracted
to their roots by pointer doubling, and edges inside a group are dropped.  Every level of
the forest is a written table.  The number of groups with edges at least halves in each
round.  The roots are then put in size bands and dealt to the splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairlens.plans import WorkTables


def _roots(parents: DataFrame, tables: WorkTables) -> DataFrame:
    """``node, root`` from ``node, parent`` by pointer doubling; the depth halves each time."""
    pointers = tables.save(parents, "pointers")
    while True:
        up = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = pointers.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        step = tables.save(step, "pointers")
        tables.drop(pointers)
        pointers = step
        if step.filter("moved").isEmpty():
            return step.select("node", F.col("parent").alias("root"))


def connected_groups(edges: DataFrame, tables: WorkTables) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; nodes with equal roots are connected.

    Edges may repeat, be reversed, or join a node to itself; an edge with a null end is
    ignored.  An empty table gives no rows.  Edge weights are a hash of the edge, with the
    edge itself to break ties, so all weights differ and the picked edges make no cycle
    besides the two groups that pick the same edge; of these the smaller becomes the root.
    """
    pairs = edges.select("a", "b").dropna()
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    live = tables.save(
        pairs.filter("a <> b").select(lo.alias("a"), hi.alias("b")).distinct().select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("w")),
        "edges",
    )
    nodes = tables.save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    levels = []
    while not live.isEmpty():
        ends = live.select("u", "v", "w").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        picked = tables.save(ends.groupBy(F.col("u").alias("node")).agg(F.min(F.struct("w", "v")).alias("m")).select("node", F.col("m.v").alias("parent"), F.col("m.w").alias("w")), "forest")
        other = picked.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        mutual = (F.col("above") == F.col("node")) & (F.col("node") < F.col("parent"))
        parents = picked.join(other, "parent").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent"))
        roots = _roots(parents, tables)
        levels.append(roots)
        ru, rv = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = live.join(ru, "u").join(rv, "v").filter("ru <> rv")
        contracted = moved.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("w").alias("w"))
        contracted = tables.save(contracted, "edges")
        tables.drop(live)
        live = contracted
    above = None
    for level in reversed(levels):  # a node's root, followed to the last level
        if above is not None:
            top = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
            level = tables.save(level.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        above = level
    if above is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(above, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def entity_groups(records: DataFrame, id_col: str, entities: Sequence[str], tables: WorkTables) -> DataFrame:
    """``row_id, group_id, group_rows``: the group of every record and its number of records.

    ``entities`` are columns of two (or one) entity values; records that share a value in any
    of them, directly or through other records, are one group, whose ``group_id`` is its
    smallest record id.  A null value joins nothing; a record without any value is a group
    of its own.  Record ids must be unique; records with a null id are left out.
    """
    cols = [F.col(f"`{e}`").cast("string") for e in entities]
    rows = records.select(F.col(f"`{id_col}`").alias("row_id"), *(c.alias(f"e{i}") for i, c in enumerate(cols))).dropna(subset=["row_id"])
    names = [f"e{i}" for i in range(len(entities))]
    first = F.coalesce(*names)
    edges = None
    for n in names[1:] or names:
        some = rows.select(first.alias("a"), F.coalesce(F.col(n), first).alias("b"))
        edges = some if edges is None else edges.unionAll(some)
    groups = connected_groups(edges, tables)
    rooted = tables.save(rows.select("row_id", first.alias("node")).join(groups, "node", "left").select("row_id", "node", "root"), "rooted")
    sizes = rooted.filter("root is not null").groupBy("root").agg(F.min("row_id").alias("group_id"), F.count(F.lit(1)).alias("group_rows"))
    alone = rooted.filter("root is null").select("row_id", F.col("row_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_rows"))
    return rooted.join(sizes, "root").select("row_id", "group_id", "group_rows").unionByName(alone)


def rows_but_first(groups: DataFrame) -> DataFrame:
    """``first_row_id, row_id`` for each record of a group but the one with the smallest id."""
    return groups.filter("row_id > group_id").select(F.col("group_id").alias("first_row_id"), "row_id")


#: Hash cells per size band, so that running totals within a band need no single task.
CELLS = 256
#: Groups with at least this share of all rows are placed one by one; there are at most 1 / LARGE.
LARGE = 0.005


def assign_splits(groups: DataFrame, shares: dict[str, float], tables: WorkTables, seed: int = 42) -> DataFrame:
    """``group_id, group_rows, band, fold``: whole groups dealt so that rows meet the shares.

    Groups with at least ``LARGE`` of all rows (at most 1 / LARGE groups, a fixed bound) are
    placed one by one, largest first, where the most rows are still wanted.  What each split
    still wants is then dealt systematically within each size band (powers of two), in
    hashed order: the running total of rows in the band, as a share of the band, falls into
    the interval of one split.  Running totals are taken over hash cells first and within a
    cell afterwards.  Ties in size or hash go by group id.  An empty table gives no rows.
    """
    g = tables.save(groups.groupBy("group_id").agg(F.max("group_rows").alias("group_rows")), "groups")
    total = g.agg(F.coalesce(F.sum("group_rows"), F.lit(0)).alias("n")).first()["n"]
    edge = max(2, total * LARGE)
    wanted = {name: share * total / sum(shares.values()) for name, share in shares.items()}
    placed = []
    for r in g.filter(F.col("group_rows") >= edge).orderBy(F.desc("group_rows"), "group_id").collect():  # at most 1 / LARGE rows
        fold = max(wanted, key=lambda s: wanted[s])
        wanted[fold] -= r["group_rows"]
        placed.append((r["group_id"], r["group_rows"], None, fold))
    schema = T.StructType([g.schema["group_id"], g.schema["group_rows"], T.StructField("band", T.IntegerType()), T.StructField("fold", T.StringType())])
    large = g.sparkSession.createDataFrame(placed, schema)
    left = {s: max(0.0, w) for s, w in wanted.items()}
    whole = sum(left.values()) or 1.0
    order = F.xxhash64("group_id", F.lit(seed))
    small = g.filter(F.col("group_rows") < edge).withColumns({"band": F.floor(F.log2("group_rows")).cast("int"), "h": order, "cell": F.pmod(F.shiftrightunsigned(order, 20), F.lit(CELLS))})
    cells = small.groupBy("band", "cell").agg(F.sum("group_rows").alias("cell_rows"))
    by_band = Window.partitionBy("band")
    cells = cells.withColumns({"before_cell": F.sum("cell_rows").over(by_band.orderBy("cell")) - F.col("cell_rows"), "band_rows": F.sum("cell_rows").over(by_band)})
    in_cell = Window.partitionBy("band", "cell").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = small.join(F.broadcast(cells), ["band", "cell"])  # at most CELLS rows for each of at most 63 bands
    at = (F.col("before_cell") + F.sum("group_rows").over(in_cell) - F.col("group_rows") / 2) / F.col("band_rows")
    fold, upto = None, 0.0
    for name, rows in list(left.items())[:-1]:
        upto += rows / whole
        fold = F.when(F.col("at") < upto, name) if fold is None else fold.when(F.col("at") < upto, name)
    last = list(left)[-1]
    dealt = dealt.withColumn("at", at).select("group_id", "group_rows", "band", (F.lit(last) if fold is None else fold.otherwise(last)).alias("fold"))
    return dealt.unionByName(large)


def split_report(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``fold, target_share, n_groups, n_rows, actual_share`` for each split."""
    spark = assigned.sparkSession
    targets = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "fold string, target_share double")
    per_fold = assigned.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("group_rows").alias("n_rows"))
    joined = targets.join(per_fold, "fold", "left").fillna(0, ["n_groups", "n_rows"])
    return joined.withColumn("actual_share", F.col("n_rows") / F.nullif(F.sum("n_rows").over(Window.partitionBy()), F.lit(0)))
