"""Train, validation and test folds of labelled pairs, by content hash.

A fold is a column.  All relations are split in one pass: the place of a row in its group by
hash, against the group's size.  Places come from ``hashed_rank``, which never sorts a whole
group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.functions.hashing import content_hash, hashed_rank
from pairlens.plans.worktables import WorkTables

TRAIN, VAL, TEST = 0.70, 0.10, 0.20


def _hash_of(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("h", content_hash(F.col("relation"), F.col("drug_1"), F.col("drug_2"), F.col("label"), seed=seed))


def _cut(place: Column, train: Column, val: Column) -> Column:
    return F.when(place < train, "train").when(place < train + val, "val").otherwise("test")


def random_pair(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Per relation: the first int(.7 n) by hash train, the next int(.1 n) validation, the rest test."""
    r = hashed_rank(_hash_of(pairs, seed), ["relation"], "h")
    n = F.col("group_size")
    return r.withColumn("fold", _cut(F.col("rank"), F.floor(n * F.lit(TRAIN)), F.floor(n * F.lit(VAL)))).drop("h", "rank", "group_size")


def stratified_pair(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Per relation and label: ceil(.3 n) held out, of these ceil(2/3) test; under 3 rows all train."""
    r = hashed_rank(_hash_of(pairs, seed), ["relation", "label"], "h")
    n = F.col("group_size")
    held = F.ceil(n * F.lit(VAL + TEST))
    test = F.ceil(held * F.lit(TEST / (VAL + TEST)))
    fold = F.when(n < 3, "train").otherwise(_cut(F.col("rank"), n - held, held - test))
    return r.withColumn("fold", fold).drop("h", "rank", "group_size")


def heldout_drugs(pairs: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``drug``: max(1, int(share * n)) of all drugs, first by hash, the same for all relations."""
    drugs = pairs.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    r = hashed_rank(drugs.withColumn("h", content_hash(F.col("drug"), seed=seed)), [], "h")
    return r.filter(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(share)))).select("drug")


def cold_start(pairs: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Pairs with a held-out drug test; per relation int(n * .7 / .8) of the others train, the rest validation."""
    held = heldout_drugs(pairs, share, seed)
    flagged = pairs
    for c in ("drug_1", "drug_2"):
        flagged = flagged.join(held.select(F.col("drug").alias(c), F.lit(True).alias(f"held_{c}")), c, "left")
    flagged = flagged.withColumn("is_test", F.coalesce(F.col("held_drug_1"), F.col("held_drug_2"), F.lit(False))).drop("held_drug_1", "held_drug_2")
    r = hashed_rank(_hash_of(flagged, seed), ["relation", "is_test"], "h")
    train = F.floor(F.col("group_size") * F.lit(TRAIN) / F.lit(TRAIN + VAL))
    return r.withColumn("fold", F.when(F.col("is_test"), "test").when(F.col("rank") < train, "train").otherwise("val")).drop("h", "rank", "group_size", "is_test")


def cold_start_in_place(pairs: DataFrame, by: list[str], drugs_of: DataFrame, tables: WorkTables, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The folds of ``cold_start`` for each group of ``by`` (with the relation), and ``group_size``, the rows of the group.

    The rows stay where they are: a drug is held out up to the last hash of the held-out ones,
    and a row trains below the hash of its group's first validation row.  For that hash only
    the rows of one cell in 64 are ranked.  ``drugs_of`` has all drugs that any of the groups
    has; columns of ``by`` hold no nulls.
    """
    hashed = lambda c: content_hash(F.col(c), seed=seed)
    last = heldout_drugs(drugs_of, share, seed).agg(F.max(hashed("drug")).alias("h")).first()["h"] or ""  # one row
    flagged = _hash_of(pairs, seed).withColumn("_test", F.least(hashed("drug_1"), hashed("drug_2")) <= last)
    flagged = flagged.withColumn("_cell", F.when(F.col("_test"), -1).otherwise(F.expr("cast(conv(substring(h, 1, 2), 16, 10) as int) div 4")))
    cells = tables.save(flagged.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n")), "cells")
    others = F.sum(F.when(F.col("_cell") >= 0, F.col("_n")).otherwise(0))
    sizes = cells.groupBy(*by).agg(F.sum("_n").alias("group_size"), F.floor(others * F.lit(TRAIN) / F.lit(TRAIN + VAL)).alias("_train"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_n")  # at most 64 rows
    reached = cells.filter("_cell >= 0").withColumn("_before", before).join(sizes, by).filter("_before <= _train AND _train < _before + _n")
    reached = tables.save(reached.select(*by, "_cell", (F.col("_train") - F.col("_before") + 1).alias("_place")), "reached")  # one row per group
    near = flagged.join(reached, [*by, "_cell"]).select(*by, "_place", "h").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("h")))
    cuts = tables.save(sizes.select(*by, "group_size").join(near.filter("_k = _place").select(*by, F.col("h").alias("_cut")), by, "left"), "cuts")  # one row per group
    fold = F.when(F.col("_test"), "test").when(F.col("h") < F.col("_cut"), "train").otherwise("val")
    return flagged.join(cuts, by).withColumn("fold", fold).drop("h", "_test", "_cell", "_cut")


def weak_nodes(triples: DataFrame, n_weak: int) -> DataFrame:
    """``drug, degree``: the n_weak drugs of lowest degree, ties by id."""
    degree = triples.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).groupBy("drug").agg(F.count(F.lit(1)).alias("degree"))
    return degree.orderBy("degree", "drug").limit(n_weak)


def weak_node(triples: DataFrame, n_weak: int = 98, seed: int = 42) -> DataFrame:
    """Triples of the weakest drugs half validation, half test (by hash); all others train."""
    weak = F.broadcast(weak_nodes(triples, n_weak).select("drug"))  # n_weak rows
    flagged = triples
    for c in ("drug_1", "drug_2"):
        flagged = flagged.join(weak.select(F.col("drug").alias(c), F.lit(True).alias(f"weak_{c}")), c, "left")
    flagged = flagged.withColumn("weak", F.coalesce(F.col("weak_drug_1"), F.col("weak_drug_2"), F.lit(False))).drop("weak_drug_1", "weak_drug_2")
    r = hashed_rank(flagged.withColumn("h", content_hash(F.col("relation"), F.col("drug_1"), F.col("drug_2"), seed=seed)), ["weak"], "h")
    return r.withColumn("fold", F.when(~F.col("weak"), "train").when(F.col("rank") < F.floor(F.col("group_size") / 2), "val").otherwise("test")).drop("h", "rank", "group_size", "weak")


def _ranked_edges(triples: DataFrame, seed: int) -> DataFrame:
    return hashed_rank(triples.withColumn("h", content_hash(F.col("relation"), F.col("drug_1"), F.col("drug_2"), seed=seed)), [], "h")


def random_edges(triples: DataFrame, train: float = 0.9, val_of_train: float = 0.1, seed: int = 42) -> DataFrame:
    """All triples in one hashed order: int(.9 n) train, of these the last int(.1 n_train) validation, the rest test."""
    n_train = F.floor(F.col("group_size") * F.lit(train))
    n_val = F.floor(n_train * F.lit(val_of_train))
    return _ranked_edges(triples, seed).withColumn("fold", _cut(F.col("rank"), n_train - n_val, n_val)).select("relation", "drug_1", "drug_2", "fold")


def first_edges(triples: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` triples, the first in hashed order: a subsample for one training round."""
    return _ranked_edges(triples, seed).filter(F.col("rank") < most).select("relation", "drug_1", "drug_2")


STRATEGIES = {"random_pair": random_pair, "stratified_pair": stratified_pair, "drug_cold_start": cold_start}


def split(pairs: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """The pairs with a ``fold``; an unknown strategy raises ValueError."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](pairs, seed=seed)


def split_sizes(folded: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group, fold and label, as columns ``{fold}_{pos|neg}``."""
    count = lambda fold, label: F.count_if((F.col("fold") == fold) & (F.col("label") == label)).alias(f"{fold}_{'pos' if label else 'neg'}")
    return folded.groupBy(*by).agg(*(count(f, v) for f in ("train", "val", "test") for v in (1, 0)))


def drug_overlap(folded: DataFrame, by: list[str]) -> DataFrame:
    """Percentage of a group's distinct test drugs that stand in its train fold; 0 without test drugs."""
    ends = folded.select(*by, "fold", F.explode(F.array("drug_1", "drug_2")).alias("drug")).filter(F.col("fold").isin("train", "test"))
    per_drug = ends.groupBy(*by, "drug").agg(F.bool_or(F.col("fold") == "test").alias("in_test"), F.bool_or(F.col("fold") == "train").alias("in_train"))
    n, seen = F.count_if("in_test"), F.count_if(F.col("in_test") & F.col("in_train"))
    return per_drug.groupBy(*by).agg(n.alias("n_test_drugs"), F.coalesce(F.round(seen * 100e0 / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("pct_in_train"))


def training_drugs(folded: DataFrame, by: list[str]) -> DataFrame:
    """Distinct drugs of the train fold, per group."""
    return folded.filter(F.col("fold") == "train").select(*by, F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
