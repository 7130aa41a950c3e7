"""Stupid backoff of any order with a count table for each length of n-grams.

With c the counts over all documents, N the number of words, and an n-gram's context and ending the words but its last and
but its first: score(gram) = c(gram) / c(context) if c(gram) >= min_count, else backoff * score(ending); score(word) = c(word) / N.
So every distinct n-gram has one score, whatever the document: tables are built from words upwards, each joined to the one
before by context and by ending, and the exploded n-grams of the documents (row, gram, how often) are joined to the scores and
summed. A document's first words have the shorter n-grams that they end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, lean, mix, words
from .shared import saved

STEP = U64(0xD6E8FEB86659FD93)


def _grams(h: np.ndarray, order: int) -> list[np.ndarray]:
    """64-bit hashes of the runs of 1 .. order words that begin at each word; runs over a text's end are to be left out."""
    out = [mix(h + U64(1))]
    for k in range(2, order + 1):
        last = out[-1]
        n = max(0, len(h) - k + 1)
        out.append(mix(last[:n] * STEP + h[k - 1 : k - 1 + n] + U64(k)))
    return out


def _pieces(column, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """For pieces of texts: first and last row, each word's row, words left in its row from it on, n-grams, offsets of rows."""
    for i, j, h, at in words(column):
        row = np.repeat(np.arange(j - i), np.diff(at))
        yield i, j, row, np.repeat(at[1:], np.diff(at)) - np.arange(len(h)), _grams(h, order), at


def gram_counts(docs: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """(k, gram, context, ending, c) of all n-grams of 1 .. order words; context and ending are null for words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, left, grams, _ in _pieces(b.column(0), order):
                for k, g in enumerate(grams, 1):
                    full = np.flatnonzero(left[: len(g)] >= k)
                    u, first, c = np.unique(g[full], return_index=True, return_counts=True)
                    at = full[first]
                    none = pa.nulls(len(u), pa.int64())
                    parts = [none, none] if k == 1 else [pa.array(grams[k - 2][at].view(np.int64)), pa.array(grams[k - 2][at + 1].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), *parts, pa.array(c.astype(np.int64))], ["k", "gram", "context", "ending", "c"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "k int, gram long, context long, ending long, c long")
    return rows.groupBy("k", "gram").agg(F.first("context").alias("context"), F.first("ending").alias("ending"), F.sum("c").alias("c"))


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """(row, gram, n) of rows (row, text): for every word the longest n-gram that ends with it, order words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, _, row, left, grams, at in _pieces(b.column(1), order):
                rows, found = [], []
                for k, g in enumerate(grams, 1):
                    full = np.flatnonzero(left[: len(g)] >= k)
                    if k < order:  # the first words of a text
                        full = full[full == at[row[full]]]
                    rows.append(row[full]), found.append(g[full])
                rows, found = np.concatenate(rows), np.concatenate(found)
                by = np.lexsort((found, rows))
                rows, found = rows[by], found[by]
                new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])))) if len(rows) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + rows[new]]), pa.array(found[new].view(np.int64)), pa.array(np.diff(np.append(new, len(rows))).astype(np.int64))], ["row", "gram", "n"])

    return docs.select("row", "text").mapInArrow(lean(run), "row long, gram long, n long")


def gram_scores(counts: DataFrame, order: int, backoff: float = 0.4, min_count: int = 2) -> DataFrame:
    """(gram, c, s) of all n-grams of gram_counts(); s is the logarithm of the score."""
    counts = saved(counts)
    total = counts.where("k = 1").agg(F.sum("c")).first()[0] or 1
    below = counts.where("k = 1").select("gram", "c", F.log(F.col("c") / total).alias("s"))
    out = below
    for k in range(2, order + 1):
        own = counts.where(F.col("k") == k)
        x = own.join(below.select(F.col("gram").alias("context"), F.col("c").alias("of")), "context").join(below.select(F.col("gram").alias("ending"), F.col("s").alias("shorter")), "ending")
        s = F.when(F.col("c") >= min_count, F.log("c") - F.log("of")).otherwise(F.lit(float(np.log(backoff))) + F.col("shorter"))
        below = saved(x.select("gram", "c", s.alias("s")))
        out = out.unionByName(below)
    return out


def scored(docs: DataFrame, order: int, backoff: float, min_count: int) -> DataFrame:
    """(doc_id, n_words, log_score) of rows (doc_id, text)."""
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    grams = saved(exploded(docs, order))
    scores = gram_scores(gram_counts(docs, order), order, backoff, min_count)
    sums = grams.join(scores.select("gram", "s"), "gram").groupBy("row").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("s")).alias("log_score"))
    own = docs.select("row", "doc_id").join(sums, "row", "left")
    return own.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
