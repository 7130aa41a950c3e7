"""Sharding by a Feistel permutation of global row numbers.

Row r of n goes to place p = permute(r); its shard is p mod shards, its slot p div shards. So shard sizes differ by one
row at most, the order is a reproducible shuffle, and both directions can be computed for any row without the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix
from .shared import numbered, saved

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(2, n) - 1).bit_length() + 1 >> 1)


def _network(x: np.ndarray, bits: int, seed: int, inverse: bool) -> np.ndarray:
    mask, half = U64((1 << bits) - 1), U64(bits)
    left, right = x >> half, x & mask
    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        key = U64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xC2B2AE3D27D4EB4F) % 2**64)
        if inverse:
            left, right = right ^ (mix(left + key) & mask), left
        else:
            left, right = right, left ^ (mix(right + key) & mask)
    return left << half | right


def permute(rows: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The place of each row number below n (or, inverse, the row number of each place): a permutation of 0..n-1.

    The network permutes 0..4**bits-1, less than 4n for n > 1; values of n or more walk on along their cycle."""
    x, bits = np.asarray(rows).astype(np.uint64), _half_bits(n)
    if n <= 1 or not len(x):
        return x.astype(np.int64)
    x = _network(x, bits, seed, inverse)
    while (out := np.flatnonzero(x >= U64(n))).size:
        x[out] = _network(x[out], bits, seed, inverse)
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number in a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def feistel_shard(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, size (UTF-8 bytes of the text + 8), text_crc32, row_number, shard and slot.

    Rows are numbered by id, then by the text's checksum, size and 64-bit hash; the text itself isn't moved. A null id
    comes first, a null text counts as no bytes (size 8, checksum of the empty text); repeated rows each get a slot of
    their own. An empty table gives no rows. Other columns are not returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    ranked = saved(numbered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("h")], "row_number"))
    n = ranked.count()

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    p = place("row_number")
    return ranked.withColumn("p", p).select("doc_id", "size", "text_crc32", "row_number", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"p div {shards}").alias("slot"))


