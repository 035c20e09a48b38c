"""Evaluation texts leaking into training text.

Words are hashed in the JVM; documents and items are then sequences of word hashes.  Both
are winnowed with windows chosen so that every run of at least ``span`` shared words leaves
a common fingerprint; common fingerprints are seeds, and seeds are extended to the left and
right.  A document leaks an item if an extended run has ``span`` words.

Winnowing with windows of w also bounds how far a run reaches beyond its outermost seeds:
by w - 1 words.  So a fingerprint carries only that many words before and behind it, and
documents and items are never joined with their texts.  Fingerprints are joined by a
shuffle.  Before it, a bitmap of fixed size (``FILTER_BITS``), set from the items'
fingerprints, drops document fingerprints that no item has; it may let others through, and
never decides a result.  Of text that many documents share, each distinct fingerprint with
its surroundings meets the items once; only what is a true run goes back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlens.llm.winnow import fingerprints
from pairlens.plans import WorkTables

#: The filter has 2 ** FILTER_BITS bits (2 MB), whatever the number of items.
FILTER_BITS = 24
#: Parts into which the documents of one shared passage are spread.
SALTS = 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words in lower case; words are the longest runs of letters and digits."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64, copy=False).view(np.uint64), offsets - offsets[0]


def _slices(values: np.ndarray, first: np.ndarray, n: np.ndarray, step: int) -> pa.ListArray:
    """``n[i]`` values from place ``first[i]`` on, forwards or backwards."""
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first - step * ends[:-1], n) + step * np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[at].view(np.int64)))


def _print_rows(id_name: str, k: int, w: int, bitmap=None):
    """(id, words) to (id, h, at, before, behind); with a bitmap, only fingerprints that it holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("words"))
            h, place, seq = fingerprints(values, offsets, k, w)
            if bitmap is not None:
                bit = h & np.uint64((1 << FILTER_BITS) - 1)
                held = (bitmap.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                h, place, seq = h[held], place[held], seq[held]
            before = np.minimum(place - offsets[seq], w - 1)
            behind = np.minimum(offsets[seq + 1] - place - k, w - 1)
            columns = [pa.array(h.view(np.int64)), pa.array((place - offsets[seq]).astype(np.int32)), _slices(values, place - 1, before, -1), _slices(values, place + k, behind, 1)]
            yield pa.record_batch([batch.column(id_name).take(pa.array(seq)), *columns], names=[id_name, "h", "at", "before", "behind"])

    return rows


_PRINT = "h bigint, at int, before array<bigint>, behind array<bigint>"


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bits of all fingerprints; at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    bit = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    words = prints.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _equal_words(a: str, b: str) -> Column:
    """Number of leading places at which two arrays agree."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise((first - 1).cast("int"))


def find_leaks(documents: DataFrame, items: DataFrame, tables: WorkTables, span: int = 13, k: int = 8) -> DataFrame:
    """``doc_id, item_id, doc_from, item_from, n_words``: the longest shared run of each pair.

    One row per document and item that share at least ``span`` consecutive words; the runs
    start at word ``doc_from`` and ``item_from`` (from 0).  Of equally long runs the last is
    given.  Null or short texts leak nothing; empty tables give no rows.  Ids are one row's
    each; extra columns are ignored.  ``k`` must be at most ``span``.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    w = span - k + 1
    words = lambda df, name, kind: df.select(F.col(name).cast(kind), word_hashes(F.col("text")).alias("words")).dropna().filter(F.size("words") >= span)
    item_prints = tables.save(words(items, "item_id", "string").mapInArrow(_print_rows("item_id", k, w), f"item_id string, {_PRINT}"), "items")
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(item_prints))
    found = words(documents, "doc_id", "bigint").mapInArrow(_print_rows("doc_id", k, w, shared), f"doc_id bigint, {_PRINT}")
    doc_prints = tables.save(found.withColumn("place", F.xxhash64("h", "before", "behind")), "documents")

    distinct = doc_prints.groupBy("h", "place").agg(F.any_value("before").alias("d_before"), F.any_value("behind").alias("d_behind"))
    met = distinct.join(item_prints, "h").withColumns({"left": _equal_words("d_before", "before"), "right": _equal_words("d_behind", "behind")})
    runs = met.filter(F.col("left") + F.col("right") + k >= span).select("h", "place", "item_id", F.col("at").alias("q"), "left", "right")  # a seed of a long run has that much
    spread = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seeds = doc_prints.select("doc_id", "h", "place", F.col("at").alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(spread, ["h", "place", "salt"])
    pieces = seeds.select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift"), (F.col("p") - F.col("left")).alias("lo"), (F.col("p") + F.col("right") + k).alias("hi"))

    diagonal = Window.partitionBy("doc_id", "item_id", "shift").orderBy("lo", "hi")  # at most the words of one item
    reached = F.max("hi").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    apart = pieces.withColumn("starts", (reached.isNull() | (F.col("lo") > reached)).cast("int"))
    chained = apart.withColumn("run", F.sum("starts").over(diagonal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = chained.groupBy("doc_id", "item_id", "shift", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(F.col("hi") - F.col("lo") >= span)
    best = whole.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("hi") - F.col("lo")).alias("n"), "lo", "shift")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.lo").alias("doc_from"), (F.col("m.lo") - F.col("m.shift")).alias("item_from"), F.col("m.n").alias("n_words"))


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, item_set, n_docs, longest_run, share_of_item``: what leaked of every item."""
    sizes = items.select(F.col("item_id").cast("string"), "item_set", F.size(word_hashes(F.col("text"))).alias("n_item_words"))
    per_item = leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_run"))
    joined = sizes.join(per_item, "item_id", "left").fillna(0, ["n_docs", "longest_run"])
    share = F.round(F.col("longest_run") / F.nullif(F.col("n_item_words"), F.lit(0)), 4)
    return joined.select("item_id", "item_set", "n_docs", "longest_run", share.alias("share_of_item"))
