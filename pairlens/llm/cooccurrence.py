"""Items that appear together: a blocked Gram matrix over binary sparse item blocks.

Baskets are partitioned by their key.  A task reads its baskets in order, as record blocks;
each record block is a binary sparse matrix X (baskets by items), and its transpose product
X'X is added to the task's sums, block by block of items: products inside the first
``HEAD`` items, which a task meets first and most often, go to a dense head block; all
others to a sparse rest.  The rest is summed and handed on whenever it holds ``REST``
products, so a task's memory is bounded whatever the vocabulary.  Only summed cells leave
the task; Spark adds them over all tasks.  No pair of items is emitted per basket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of the dense head block, at most: it holds HEAD x HEAD counts (134 MB).
HEAD = 4096
#: Products that are worked out at a time, and that the sparse rest holds (8 bytes each).
STEP, REST = 1 << 20, 1 << 22
#: Items that a task keeps codes for; beyond, it hands on its cells and starts anew.
MAX_ITEMS = 1 << 20


class GramAccumulator:
    """Sums of X'X over the record blocks of one task."""

    def __init__(self) -> None:
        self._start()

    def _start(self) -> None:
        self.codes: dict[str, int] = {}
        self.items: list[str] = []
        self.head = np.zeros((0, 0), dtype=np.int64)
        self.rest: list[np.ndarray] = []
        self.n_rest = 0

    def encode(self, items: pa.Array) -> np.ndarray:
        """Task-local codes of the items; new items get the next code."""
        coded = items.dictionary_encode()
        local = np.empty(len(coded.dictionary), dtype=np.int64)
        for i, item in enumerate(coded.dictionary.to_pylist()):
            code = self.codes.get(item)
            if code is None:
                code = self.codes[item] = len(self.items)
                self.items.append(item)
            local[i] = code
        return local[coded.indices.to_numpy(zero_copy_only=False)]

    def _room(self) -> int:
        """Items of the head block, grown to hold the items met so far as far as it may."""
        size = len(self.head)
        wanted = min(HEAD, len(self.items))
        if wanted > size:
            size = min(HEAD, max(wanted, 2 * size, 64))
            grown = np.zeros((size, size), dtype=np.int64)
            grown[: len(self.head), : len(self.head)] = self.head
            self.head = grown
        return size

    def _add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Add one for each product of the items a[i] and b[i]; yields the rest where it is full."""
        size = self._room()
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        inside = hi < size
        if inside.all():
            cells = lo * size + hi
        else:
            cells = lo[inside] * size + hi[inside]
            self.rest.append((lo[~inside] << 32) | hi[~inside])
            self.n_rest += self.rest[-1].size
        flat = self.head.reshape(-1)
        if cells.size * 8 > flat.size:
            flat += np.bincount(cells, minlength=flat.size)
        else:
            np.add.at(flat, cells, 1)
        if self.n_rest >= REST:
            yield self._sparse()

    def add_block(self, starts: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One record block: basket i has the distinct codes from starts[i] to starts[i + 1].

        X'X is the sum of its baskets' outer products: each entry meets itself and the later
        entries of its basket, about ``STEP`` products at a time.
        """
        ends = np.repeat(starts[1:], np.diff(starts))
        n = ends - np.arange(codes.size)
        reach = np.cumsum(n)
        first = 0
        while first < codes.size:
            done = reach[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(reach, done + STEP, side="right")))
            m = n[first:last]
            a = np.repeat(np.arange(first, last), m)
            b = a + np.arange(a.size) - np.repeat(reach[first:last] - m - done, m)
            yield from self._add(codes[a], codes[b])
            first = last

    def _batch(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        names = pa.array(self.items, pa.string())
        a, b = names.take(pa.array(lo)), names.take(pa.array(hi))
        swap = pc.greater(a, b)
        return pa.record_batch([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(n)], names=["item_1", "item_2", "n"])

    def _sparse(self) -> pa.RecordBatch:
        """The summed rest, which is then forgotten."""
        keys, n = np.unique(np.concatenate(self.rest), return_counts=True)
        self.rest, self.n_rest = [], 0
        return self._batch(keys >> 32, keys & 0xFFFFFFFF, n)

    def cells(self) -> Iterator[pa.RecordBatch]:
        """All non-zero cells; items and sums are then forgotten."""
        if self.rest:
            yield self._sparse()
        for row in range(0, len(self.head), 256):
            lo, hi = np.nonzero(self.head[row : row + 256])
            if lo.size:
                yield self._batch(lo + row, hi, self.head[row : row + 256][lo, hi])
        self._start()


def _gram_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc, n_baskets, rest = GramAccumulator(), 0, None

    def take(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Add all baskets of the table."""
        nonlocal n_baskets
        key = table.column("basket").combine_chunks()
        codes = acc.encode(table.column("item").combine_chunks())
        keys = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [keys.size]])
        n_baskets += starts.size - 1
        yield from acc.add_block(starts, codes)
        if len(acc.items) > MAX_ITEMS:
            yield from acc.cells()

    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("basket")), pc.is_valid(batch.column("item"))))
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        key = table.column("basket")
        last = key[len(key) - 1].as_py()
        cut = pc.index(key, pa.scalar(last, key.type)).as_py()  # the last basket may go on
        rest = table.slice(cut)
        if cut:
            yield from take(table.slice(0, cut))
    if rest is not None:
        yield from take(rest)
    yield from acc.cells()
    if n_baskets:
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([n_baskets])], names=["item_1", "item_2", "n"])


def gram_counts(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """``item_1 <= item_2, n``: baskets that hold both; equal items give an item's own count.

    The row with null items holds the number of baskets.  Repeated (basket, item) rows count
    once; rows with a null basket or item are left out; an empty table gives no rows.
    A task holds the head block, the rest and one basket's distinct items; a basket's
    products are as many as its cells of the result.
    """
    entries = baskets.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).distinct()  # nulls, few by now, are dropped in the task
    cells = entries.repartition("basket").sortWithinPartitions("basket", "item").mapInArrow(_gram_cells, "item_1 string, item_2 string, n bigint")
    return cells.groupBy("item_1", "item_2").agg(F.sum("n").alias("n"))


def lift(gram: DataFrame) -> DataFrame:
    """``item_1 < item_2, n_both, n_1, n_2, n_baskets, lift`` from (saved) Gram counts.

    ``lift`` is n_both / (n_1 * n_2 / n_baskets): the counts normalised by the product of
    the marginals.  Pairs that never stand together have no row.
    """
    own = gram.filter(F.col("item_1") == F.col("item_2"))
    total = gram.filter(F.col("item_1").isNull()).select(F.col("n").alias("n_baskets"))
    pairs = gram.filter(F.col("item_1") < F.col("item_2")).withColumnRenamed("n", "n_both")
    return (
        pairs.join(own.select("item_1", F.col("n").alias("n_1")), "item_1")
        .join(own.select("item_2", F.col("n").alias("n_2")), "item_2")
        .join(F.broadcast(total))  # one row
        .withColumn("lift", F.col("n_both") * F.col("n_baskets") / (F.col("n_1").cast("double") * F.col("n_2")))
    )
