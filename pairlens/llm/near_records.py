"""Same or near-same records across splits, by winnowing of cyclic record texts.

A record is a cyclic text of its cleaned values.  Two cyclic texts that differ by one
inserted, dropped or replaced character share a run of all characters but that one, so
winnowing with ``k + w <= M`` (M: the longer text's length) finds every such pair, while
k-grams of nearly the whole text stay selective for hot values.  Exact
copies are collapsed before, so a record that fills a third of a split is one text.
Common fingerprints are chained when they lie on one diagonal; chained pairs are aligned
exactly, and coverage is reported per record and source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions import clean_value
from pairlens.llm.winnow import gram_hashes, window_minima

#: Lengths of cyclic texts that share one k: from a multiple of STEP less 6 on.  The shortest
#: text of a step has windows of WINDOW hashes; texts under SHORT characters have k = M - 1.
STEP, WINDOW, SHORT = 8, 4, 18


def _k(m: int) -> int:
    """k for pairs whose longer text has m characters."""
    return m - 1 if m < SHORT else (m + 6) // STEP * STEP - 6 - WINDOW


def _cyclic_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_id, scope, text) to (text_id, scope, k, h, at, size), for partners up to one character longer.

    Windows of ``size - k`` hashes suit partners of equal length and, where k is the same,
    longer ones; where a longer partner has another k, fingerprints for that k are added.
    """
    for batch in batches:
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        length = np.array([len(t) for t in raw])
        parts = []
        for size in np.unique(length):
            size = int(size)
            rows = np.flatnonzero(length == size)
            chars = np.frombuffer(b"".join(raw[r] for r in rows), dtype=np.uint8).reshape(rows.size, size)
            cycle = np.concatenate([chars, chars], axis=1).astype(np.uint64) + np.uint64(1)
            for k, w in {_k(m): m - _k(m) for m in (size + 1, size)}.items():
                if k < 1 or k > size:
                    continue
                h = gram_hashes(cycle[:, : size + k - 1], k)  # one hash for each of the places
                at = window_minima(np.concatenate([h, h[:, : w - 1]], axis=1), w) % size
                kept = np.zeros((rows.size, size), dtype=bool)
                np.put_along_axis(kept, at, True, axis=1)
                r, place = np.nonzero(kept)
                parts.append((rows[r], np.full(r.size, k, dtype=np.int32), h[r, place].view(np.int64), place.astype(np.int32), np.full(r.size, size, dtype=np.int32)))
        if parts:
            r, k, h, at, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(r)
            yield pa.record_batch([batch.column("text_id").take(take), batch.column("scope").take(take), pa.array(k), pa.array(h), pa.array(at), pa.array(size)], names=["text_id", "scope", "k", "h", "at", "size"])


def distinct_records(rows: DataFrame, id_col: str, fields: tuple[str, str, str], scope: str, side) -> DataFrame:
    """``scope, is_train, a, b, s, text_id, copies`` for each distinct cleaned record.

    ``fields`` are the two interchangeable values and the third; a <= b.  ``text_id`` is the
    smallest id of the record's rows.  Rows with a missing value, scope or side are left out.
    """
    x, y, s = (clean_value(F.col(f"`{f}`")) for f in fields)
    clean = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{scope}`").alias("scope"), side.alias("is_train"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), s.alias("s"), x.alias("x"), y.alias("y"))
    whole = clean.dropna().drop("x", "y")
    return whole.groupBy("scope", "is_train", "a", "b", "s").agg(F.min("row_id").alias("text_id"), F.count(F.lit(1)).alias("copies"))


def near_texts(records: DataFrame) -> DataFrame:
    """``scope, eval_id, train_id, edits, seeds, coverage`` for pairs of distinct records.

    Pairs of an evaluation and a training record of the same scope whose three values are
    equal, or differ by one character in all three together, in either order of a and b.
    ``seeds`` is the number of common fingerprints on the best diagonal and ``coverage`` the
    share of the evaluation record's characters that the alignment matches.
    All joins ask for a shuffle: to the planner fingerprints are as small as the saved records
    they are made of, and saved records as their compressed files, so either might be broadcast.
    """
    text = lambda p, q: F.concat_ws("#", "s", p, q, F.lit(""))
    train = records.filter("is_train").select("text_id", "scope", text("a", "b").alias("text"))
    held = records.filter("NOT is_train")
    both_orders = held.select("text_id", "scope", text("a", "b").alias("text")).unionByName(held.filter("a <> b").select("text_id", "scope", text("b", "a").alias("text")))
    schema = "text_id bigint, scope string, k int, h bigint, at int, size int"
    e = both_orders.mapInArrow(_cyclic_prints, schema).select("scope", "k", "h", F.col("text_id").alias("eval_id"), F.col("at").alias("p"), "size")
    t = train.mapInArrow(_cyclic_prints, schema).select("scope", "k", "h", F.col("text_id").alias("train_id"), F.col("at").alias("q"))
    seeds = e.join(t.hint("merge"), ["scope", "k", "h"]).groupBy("scope", "eval_id", "train_id", F.pmod(F.col("p") - F.col("q"), "size").alias("diagonal")).agg(F.count(F.lit(1)).alias("seeds"))
    chains = seeds.groupBy("scope", "eval_id", "train_id").agg(F.max("seeds").alias("seeds"))
    left = held.select(F.col("text_id").alias("eval_id"), *(F.col(c).alias(f"e_{c}") for c in "abs"))
    right = records.filter("is_train").select(F.col("text_id").alias("train_id"), *(F.col(c).alias(f"t_{c}") for c in "abs"))
    edit = lambda p, q: F.levenshtein(F.col(p), F.col(q))
    edits = edit("e_s", "t_s") + F.least(edit("e_a", "t_a") + edit("e_b", "t_b"), edit("e_a", "t_b") + edit("e_b", "t_a"))
    size = F.length("e_s") + F.length("e_a") + F.length("e_b")
    return (
        chains.join(left.hint("merge"), "eval_id")
        .join(right.hint("merge"), "train_id")
        .withColumn("edits", edits)
        .filter("edits <= 1")
        .select("scope", "eval_id", "train_id", "edits", "seeds", (F.greatest(size - F.col("edits"), F.lit(0)) / size).alias("coverage"))
    )


def members(rows: DataFrame, records: DataFrame, id_col: str, fields: tuple[str, str, str], scope: str, side, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row_id, text_id`` and the kept columns: each row with its distinct record."""
    x, y, s = (clean_value(F.col(f"`{f}`")) for f in fields)
    extra = [F.col(f"`{c}`").alias(f"k_{c}") for c in keep]
    keyed = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{scope}`").alias("scope"), side.alias("is_train"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), s.alias("s"), *extra)
    return keyed.join(records.drop("copies").hint("merge"), ["scope", "is_train", "a", "b", "s"]).select("row_id", "text_id", "is_train", "scope", *(f"k_{c}" for c in keep))
