"""Bounded-space best-fit packing of token pieces into sequences.

Pieces come one after the other (online). A piece goes to the open bin with the least free space that holds it; a bitset
over free space (an integer) finds it at once. At most `open_bins` bins are open: before one more opens, the fullest closes.
The order is by a hash of id and text, whatever the length, so a stream could come in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lean, utf8
from .kernels import pieces as ranges
from .shared import clear_of
from .tokens import word_tokenizer

#: Documents that are packed together on average: some thousands of bins, of which only those open at the end stay partly empty.
GROUP = 16_384
#: Bins open at once. More would not save a sequence on the documents at hand (see README), fewer would.
OPEN_BINS = 64


class BestFit:
    """Online best-fit for bins of `size`: put(length) -> (bin, offset)."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.most, self.open, self.next = size, open_bins, 0, 0
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return out

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} in bins of {self.size}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            at, free = self.next, self.size
            self.next += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.size - free


def token_pieces(docs: DataFrame, max_tokens: int = 2048, tokenizer_path: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_crc32, piece, start, length, ids_crc32[, ids]): every document's ids and `end_id`, cut at max_tokens."""
    schema = "doc_id long, text_crc32 long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        for b in batches:
            data, off = utf8(b.column(1))
            keys = b.column(0).to_pylist()
            for i, j in ranges(off):
                ids, before = tok.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                rows = []
                for r in range(i, j):
                    mine = np.append(ids[before[r - i] : before[r - i + 1]], np.uint32(end_id)).astype("<u4")
                    text = zlib.crc32(data[off[r] : off[r + 1]])
                    for p, s in enumerate(range(0, len(mine), max_tokens)):
                        part = mine[s : s + max_tokens]
                        rows.append((keys[r], text, p, s, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "text_crc32", "piece", "start", "length", "ids_crc32", "ids"]
                m = 7 if with_ids else 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds, strict=True))[:m]], names[:m])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def pack(pieces: DataFrame, groups: int, max_tokens: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """`pieces` with sequence_id (long) and offset (long).

    Pieces are dealt to `groups` by a hash of id and text and come in the order of another one, so the result doesn't depend
    on partitioning, and a hot source or length doesn't matter. A group's sequences have ids of their own (group * 2**32 +
    number). Repeated rows are pieces of their own. Groups are streams: a task holds its open bins and one batch. Further
    columns are kept; if there are sequence_id or offset among them, the new ones are named with _ before.
    """
    order, group_, sequence, offset_ = clear_of(pieces, "order", "group", "sequence_id", "offset")
    dealt = pieces.withColumn(order, F.xxhash64("doc_id", "text_crc32", F.lit(0x5EED))).withColumn(group_, F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(0xDEA1)), F.lit(groups)))
    parts = max(1, min(groups, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(parts, group_).sortWithinPartitions(group_, order, "doc_id", "piece", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for b in batches:
            seq, place = [], []
            for g, n in zip(b.column(b.num_columns - 1).to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, BestFit(max_tokens, open_bins)
                at, offset = bins.put(n)
                seq.append(g << 32 | at)
                place.append(offset)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(seq, pa.int64()), pa.array(place, pa.int64())], [*b.schema.names[:-2], sequence, offset_])

    out = T.StructType([*pieces.schema, T.StructField(sequence, T.LongType()), T.StructField(offset_, T.LongType())])
    return dealt.mapInArrow(lean(run), out)


def pack_documents(docs: DataFrame, max_tokens: int = 2048, tokenizer_path: str | None = None, with_ids: bool = False, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs all rows of `docs` (doc_id, text) into sequences of at most max_tokens.

    Null texts are empty and have one token, the end; only longer documents are cut, into pieces that are packed each on its
    own, so a text may be of any length. The tokenizer's own marks (such as its end of text) count as one id where they
    stand in a text. Null and repeated ids are documents of their own. An empty table gives no rows. Further columns are ignored.
    """
    n = docs.select("doc_id").count()
    return pack(token_pieces(docs, max_tokens, tokenizer_path, with_ids=with_ids), max(1, -(-n // GROUP)), max_tokens, open_bins)
