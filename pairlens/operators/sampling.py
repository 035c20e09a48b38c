"""Negative pairs by the ratio rule, for all relations in one distributed job.

A relation with n positive pairs gets max(1, int(n * ratio)) negatives, or all free pairs
where there are fewer.  Every relation has an order of its own over all candidate pairs: a
pair's place is ``(slot * factor + shift) mod q`` for a prime q, with factor and shift from
a hash of the relation.  Its negatives are the first free pairs in that order.  The places
of the positives are worked out directly, so the free places are counted block by block and
only the pairs that are taken are ever made: nothing is drawn in vain, no relation is
crossed with all pairs, and a relation with a third of all triples is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.functions.hashing import content_hash, hash_slot, hashed_rank
from pairlens.operators.spread import spread_join
from pairlens.plans.worktables import WorkTables

#: Places of a relation's order that are looked at together.
BLOCK = 4096
#: Bits of the largest number of candidate pairs; products are taken in two halves.
PAIR_BITS = 42


def _prime_from(n: int) -> int:
    """The smallest prime that is no less than n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _product_mod(a: Column, b: Column, q: int) -> Column:
    """a * b mod q without overflow, for a and b below q."""
    half = 1 << (PAIR_BITS // 2)
    high = F.pmod(F.pmod(F.floor(a / half).cast("bigint") * b, F.lit(q)) * half, F.lit(q))
    return F.pmod(high + F.pmod(F.pmod(a, F.lit(half)) * b, F.lit(q)), F.lit(q))


def _order(q: int, seed: int) -> tuple[Column, Column]:
    """Factor and shift of a relation's order."""
    h = content_hash(F.col("relation"), seed=seed)
    return hash_slot(h, F.lit(min(q - 1, 2**31))) + 1, hash_slot(h, F.lit(q), 9)


def _inverse(q: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["inverse"] = [pow(int(f), -1, q) for f in pdf["factor"]]
            yield pdf

    return rows


def _first_free(wanted: DataFrame, taken: DataFrame, size: int, seed: int, tables: WorkTables) -> DataFrame:
    """``relation, slot``: of the slots below ``size``, the first ``n_neg`` of each relation's order that are not taken.

    ``wanted`` has ``relation, n_neg, n_taken``; ``taken`` has distinct ``relation, slot``.
    The planner knows the bytes of the blocks, not the many rows that come out of them, so
    joins of the result ask for a shuffle; else all negatives are sent to the driver.
    """
    q = _prime_from(size)
    if q >= 1 << PAIR_BITS:
        raise ValueError(f"{size} candidate pairs are more than {1 << PAIR_BITS}")
    factor, shift = _order(q, seed)
    none = F.lit(q - size)  # slots from size on hold no pair
    walks = wanted.filter("n_neg > 0").select("relation", "n_neg", "n_taken", factor.alias("factor"), shift.alias("shift"), F.least(F.lit(q), F.col("n_neg") + F.col("n_taken") + none).cast("bigint").alias("reach"))
    walks = tables.save(walks.mapInPandas(_inverse(q), "relation string, n_neg bigint, n_taken bigint, factor bigint, shift bigint, reach bigint, inverse bigint"), "walks")  # one row per relation
    ghosts = walks.select("relation", F.explode(F.expr(f"sequence({size}L, {q - 1}L)") if q > size else F.array().cast("array<bigint>")).alias("slot"))
    near = spread_join(taken.unionByName(ghosts), walks.select("relation", "factor", "shift", "reach"), wanted, ["relation"], "n_taken", "slot")
    placed = near.withColumn("k", F.pmod(_product_mod(F.col("slot"), F.col("factor"), q) + F.col("shift"), F.lit(q))).filter("k < reach")
    holes = placed.groupBy("relation", F.expr(f"k div {BLOCK}").alias("block")).agg(F.collect_set(F.expr(f"cast(k % {BLOCK} as int)")).alias("holes"))  # at most BLOCK
    blocks = walks.withColumn("block", F.explode(F.expr(f"sequence(0L, (reach - 1) div {BLOCK})"))).join(holes, ["relation", "block"], "left")
    length = F.least(F.lit(BLOCK), F.col("reach") - F.col("block") * BLOCK)
    sized = blocks.withColumns({"holes": F.coalesce("holes", F.array().cast("array<int>")), "length": length.cast("int")}).withColumn("free", F.col("length") - F.size("holes"))
    before = F.sum("free").over(Window.partitionBy("relation").orderBy("block")) - F.col("free")  # one row per block
    needed = sized.withColumn("need", F.col("n_neg") - before).filter("need > 0").select("relation", "block", "length", "holes", "need", "inverse", "shift")
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, else the few bytes of the blocks end in one task
    spread = needed.repartition(tasks, "relation", "block")
    free = F.slice(F.array_except(F.sequence(F.lit(0), F.col("length") - 1), "holes"), F.lit(1), F.least("need", F.lit(BLOCK)).cast("int"))
    each = spread.select("relation", "inverse", "shift", "block", F.explode(free).alias("at")).withColumn("k", F.col("block") * BLOCK + F.col("at"))
    return each.select("relation", _product_mod(F.pmod(F.col("k") - F.col("shift"), F.lit(q)), F.col("inverse"), q).alias("slot"))


def _positives(triples: DataFrame, tables: WorkTables) -> DataFrame:
    return tables.save(triples.select("relation", F.least("drug_1", "drug_2").alias("drug_1"), F.greatest("drug_1", "drug_2").alias("drug_2")).distinct(), "positives")


def _wanted(positives: DataFrame, ratio: float) -> DataFrame:
    """``relation, n_neg, n_taken``: max(1, int(n * ratio)) negatives for n positive pairs."""
    n = F.count(F.lit(1))
    return positives.groupBy("relation").agg(F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio)))).cast("bigint").alias("n_neg"), n.alias("n_taken"))


class _Drugs:
    """All drugs by place, and unordered pairs of them by slot: p1 (p1 - 1) / 2 + p2 for places p2 < p1."""

    def __init__(self, positives: DataFrame, seed: int, tables: WorkTables) -> None:
        drugs = positives.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
        ranked = hashed_rank(drugs.withColumn("h", content_hash(F.col("drug"), seed=seed)), [], "h", "place", "n_drugs")
        self.places = tables.save(ranked.select("place", "drug", "n"), "drugs")
        n = self.places.count()
        self.pairs = n * (n - 1) // 2

    def slots(self, pairs: DataFrame) -> DataFrame:
        """``relation, slot`` of the pairs; pairs of a drug with itself have none."""
        out = pairs
        for i in (1, 2):
            counts = self.places.select(F.col("drug").alias(f"drug_{i}"), "n")
            out = spread_join(out, self.places.select(F.col("drug").alias(f"drug_{i}"), F.col("place").alias(f"p{i}")), counts, [f"drug_{i}"], "n", f"drug_{3 - i}")
        high, low = F.greatest("p1", "p2"), F.least("p1", "p2")
        return out.filter("p1 <> p2").select("relation", (F.expr("greatest(p1, p2) * (greatest(p1, p2) - 1) div 2") + low).alias("slot"))

    def named(self, slots: DataFrame) -> DataFrame:
        """``relation, drug_1, drug_2`` of the slots."""
        t = F.col("slot")
        guess = F.floor((F.sqrt(8 * t + 1) + 1) / 2)
        high = F.when(guess * (guess - 1) / 2 > t, guess - 1).when(guess * (guess + 1) / 2 <= t, guess + 1).otherwise(guess)  # the root is rounded
        placed = slots.withColumn("p1", high.cast("bigint")).select("relation", "p1", (t - F.expr("p1 * (p1 - 1) div 2")).alias("p2"))
        a, b = self.places.select(F.col("place").alias("p1"), F.col("drug").alias("a")), self.places.select(F.col("place").alias("p2"), F.col("drug").alias("b"))
        return placed.join(a.hint("merge"), "p1").join(b.hint("merge"), "p2").select("relation", F.least("a", "b").alias("drug_1"), F.greatest("a", "b").alias("drug_2"))


def random_negatives(triples: DataFrame, seed: int = 42, ratio: float = 1.0, tables: WorkTables | None = None) -> DataFrame:
    """``relation, drug_1, drug_2``: pairs of distinct drugs that are no positives of the relation."""
    tables = tables or WorkTables(triples.sparkSession, "negatives")
    positives = _positives(triples, tables)
    drugs = _Drugs(positives, seed, tables)
    return drugs.named(_first_free(tables.save(_wanted(positives, ratio), "wanted"), drugs.slots(positives), drugs.pairs, seed, tables))


def structured_negatives(triples: DataFrame, seed: int = 42, ratio: float = 1.0, tables: WorkTables | None = None) -> DataFrame:
    """``relation, drug_1, drug_2``: pairs that are known for another relation and not for this one.

    Pairs of a drug with itself are left out.  Where a relation has too few such pairs, all
    are taken, and random pairs of distinct drugs follow until it has its number or no pair
    is free.
    """
    tables = tables or WorkTables(triples.sparkSession, "negatives")
    positives = _positives(triples, tables)
    wanted = tables.save(_wanted(positives, ratio), "wanted")
    pool = positives.filter("drug_1 < drug_2").select("drug_1", "drug_2").distinct()
    ranked = hashed_rank(pool.withColumn("h", content_hash(F.col("drug_1"), F.col("drug_2"), seed=seed)), [], "h", "slot", "n_pool")
    ranked = tables.save(ranked.select("slot", "drug_1", "drug_2"), "pool")
    n_pool = ranked.count()
    own = positives.join(ranked, ["drug_1", "drug_2"]).select("relation", "slot")
    known = tables.save(_first_free(wanted, own, n_pool, seed, tables).join(ranked.hint("merge"), "slot").select("relation", "drug_1", "drug_2"), "known")
    got = known.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    have = wanted.join(got, "relation", "left").fillna(0, ["n"])
    short = tables.save(have.select("relation", (F.col("n_neg") - F.col("n")).alias("n_neg"), (F.col("n_taken") + F.col("n")).alias("n_taken")).filter("n_neg > 0"), "short")
    if short.isEmpty():
        return known
    drugs = _Drugs(positives, seed, tables)
    taken = tables.save(positives.unionByName(known).join(short.select("relation"), "relation", "left_semi"), "taken")
    return known.unionByName(drugs.named(_first_free(short, drugs.slots(taken), drugs.pairs, seed, tables)))


STRATEGIES = {"random": random_negatives, "structured": structured_negatives}


def sample_negatives(triples: DataFrame, strategy: str, seed: int = 42, ratio: float = 1.0, tables: WorkTables | None = None) -> DataFrame:
    """Negatives by a named strategy, ``ratio`` for each positive pair; an unknown name raises ValueError.

    The result reads copies in ``tables``, which the caller may clear once the negatives are saved.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](triples, seed, ratio, tables)


def known_share(negatives: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: negatives, and the percentage of them that are known pairs of any relation."""
    known = triples.select("drug_1", "drug_2").distinct().withColumn("known", F.lit(1))
    joined = negatives.join(known, ["drug_1", "drug_2"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_negatives"), F.round(F.count("known") * 100e0 / F.count(F.lit(1)), 2).alias("pct_known"))


def corrupted_tails(triples: DataFrame, seed: int = 42) -> DataFrame:
    """``relation, drug_1, drug_2, tail``: a drug drawn by hash in place of each triple's second drug."""
    drugs = triples.select(F.explode(F.array("drug_1", "drug_2")).alias("drug")).distinct()
    ranked = hashed_rank(drugs.withColumn("d", content_hash(F.col("drug"), seed=seed)), [], "d", "place", "n_drugs")
    n = ranked.select("n_drugs").limit(1)
    h = content_hash(F.col("relation"), F.col("drug_1"), F.col("drug_2"), seed=seed)
    placed = triples.join(F.broadcast(n)).withColumn("place", hash_slot(h, F.col("n_drugs")))  # n is one row
    return placed.join(ranked.select("place", F.col("drug").alias("tail")), "place").select("relation", "drug_1", "drug_2", "tail")
