"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Tokens are counted where the text lies and kept as a narrow written table; the sums per
source are combined map-side.  A source's rate is the mean number of times each of its
documents is used.  A document is emitted floor(rate) times, and once more if its own hash
falls below the fraction, so no task needs to know about any other document.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.plans import WorkTables

#: Folder of the public vocabularies; not part of this repository.
TOKENIZER_DIR = os.environ.get("PAIRLENS_TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The splitter's work on one run of characters without white space may grow faster than
#: the run; texts are cut between words, where the pattern cuts them too, into parts of about this size.
PART = 100_000

#: Bytes of a vocabulary file, at most; it is handed to every task.
MAX_VOCABULARY = 32 << 20

_ENCODINGS: dict = {}


def _read(directory: str, vocabulary: str) -> bytes:
    """The vocabulary file, read on the driver; executors need no copy of their own."""
    with open(os.path.join(directory, vocabulary), "rb") as file:
        content = file.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} has more than {MAX_VOCABULARY} bytes")
    return content


def _encoding(content: bytes, vocabulary: str):
    """The tokenizer, built once per Python worker."""
    key = vocabulary, len(content), hash(content)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


_CUT = re.compile(r"(?<=\S)(?= \w)")


def count_tokens(encode, text: str | None) -> int:
    """Tokens of one text; a null text has none.  Long texts are counted in parts."""
    if not text:
        return 0
    n, start = 0, 0
    while len(text) - start > PART:
        cut = _CUT.search(text, start + PART)
        if not cut:
            break
        n += len(encode(text[start : cut.start()]))
        start = cut.start()
    return n + len(encode(text[start:]))


def token_counts(documents: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document."""

    shared = documents.sparkSession.sparkContext.broadcast(_read(directory, vocabulary))  # at most MAX_VOCABULARY

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, vocabulary).encode_ordinary
        for batch in batches:
            n = [count_tokens(encode, t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text")
    return narrow.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def source_rates(counts: DataFrame, weights: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, source_tokens, rate`` for each weighted source.

    Without ``total_tokens`` the mix is as large as it can be with every source that has
    text at its share: the smallest of max_repeats * tokens / share over these sources.
    With ``total_tokens`` a source that is too small is used ``max_repeats`` times.  Sources
    without text get rate 0; their share then falls to the others in proportion.  Documents
    of a null source, or one without a weight, are not used.
    """
    sums = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    joined = weights.select("source", "target_share", "max_repeats").join(sums, "source", "left").fillna(0, ["n_docs", "source_tokens"])
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    if total_tokens is None:
        limit = joined.filter(usable).agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("all_tokens"))
    else:
        present = F.sum(F.when(usable, F.col("target_share")))
        limit = joined.agg((F.lit(float(total_tokens)) / present).alias("all_tokens"))
    rate = F.when(usable, F.least(F.col("all_tokens") * F.col("target_share") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return joined.join(F.broadcast(limit)).withColumn("rate", rate).drop("all_tokens")  # limit is one row


def mix_sources(documents: DataFrame, weights: DataFrame, tables: WorkTables, seed: int = 42, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen rows ``doc_id, source, n_tokens, copy_no`` and the shares by source.

    ``copy_no`` runs from 1 to at most ``max_repeats``.  The report has ``source,
    target_share, max_repeats, source_tokens, rate, mixed_docs, mixed_tokens,
    actual_share``.  Equal seeds and ids give equal choices, whatever the partitions.
    Empty texts have no tokens but are chosen like others.  Empty tables give no rows.
    """
    counts = tables.save(token_counts(documents), "tokens")
    rates = tables.save(source_rates(counts, weights, total_tokens), "rates")
    coin = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = F.floor("rate") + F.when(coin < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    used = counts.join(rates.select("source", "rate"), "source").withColumn("copies", copies.cast("int")).filter("copies > 0")
    rows = used.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    mixed = used.groupBy("source").agg(F.sum("copies").alias("mixed_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    whole = mixed.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        rates.join(mixed, "source", "left")
        .fillna(0, ["mixed_docs", "mixed_tokens"])
        .join(F.broadcast(whole))  # one row
        .select("source", "target_share", "max_repeats", "source_tokens", "rate", "mixed_docs", "mixed_tokens", (F.col("mixed_tokens") / F.col("all_tokens")).alias("actual_share"))
    )
    return rows, report
