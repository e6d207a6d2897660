"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import ensure_workers, materialize, slices
from .tokenizing import encoder, tokenizer_path

BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", extra_tokens: int = 0) -> DataFrame:
    """``n_tokens, n_docs``: how many documents encode to each length.

    Whole texts, null as empty (length ``extra_tokens``). Each batch sends a row
    for each distinct length, summed again before the shuffle.
    """
    ensure_workers(docs.sparkSession)
    path = tokenizer_path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text"):
            sizes = np.array([len(x) // 4 for x in enc.ids([t or "" for t in batch.column(0).to_pylist()])], np.int64) + extra_tokens
            value, n = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], names=["n_tokens", "n"])

    return docs.select("text").mapInArrow(count, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """What every context limit L that is some document's length means, by suffix sums over the histogram.

    Returns a row per distinct length ``n_tokens`` = L: ``n_docs`` (of that length),
    ``docs_over`` (longer than L), ``tokens_over`` (theirs), ``total_tokens`` (of
    all), ``kept_tokens`` (if each document is truncated to L), ``cut_tokens`` (the
    rest) and ``quantile`` (share of documents of at most L tokens). A limit
    between two lengths keeps ``kept_tokens`` of the lower plus ``docs_over`` times
    the difference. Sums run within blocks of lengths and over the blocks' totals,
    of which there are the longest length / 1024 at most. Empty input: no rows.
    """
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
            F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
            F.sum("d").over(total.partitionBy(F.lit(0))).alias("all_docs"),
            F.sum("t").over(total.partitionBy(F.lit(0))).alias("total_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        h.withColumns({"d_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
        .join(blocks, "block")
        .withColumns({"docs_over": F.col("d_in") + F.col("d_later"), "tokens_over": F.col("t_in") + F.col("t_later")})
    )
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        "total_tokens",
        kept.alias("kept_tokens"),
        (F.col("total_tokens") - kept).alias("cut_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", extra_tokens: int = 0) -> DataFrame:
    """:func:`context_table` of the documents' :func:`length_histogram`, a row per length that is written once: the table reads it twice."""
    return context_table(materialize(length_histogram(docs, tokenizer, extra_tokens), "lengths"))


def quantile_lengths(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of the documents doesn't exceed."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return table.select("n_tokens", "quantile", wanted).filter("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
