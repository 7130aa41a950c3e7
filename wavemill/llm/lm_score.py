"""Stupid-backoff scores of documents under the corpus' own bigram counts, computed relationally.

Words are those of kernels.py. Every word counts by itself, unless a vocabulary size is given: then the vocabulary is the most
frequent words, in whole levels of equal counts, and others are one unknown word. With c the counts over all documents and N the number of words, the score of word w after v is
c(vw)/c(v) if c(vw) >= min_count, else backoff * c(w)/N; a document's first word has c(w)/N. A document's score is the sum
of the natural logarithms.

Bigrams of the HEAD most frequent words are counted and looked up in one table of HEAD x HEAD, which every task holds. So a
bigram outside it has a word outside the first HEAD, and makes up at most 1/HEAD of all: the others are dealt out by
hash, and in each part the count table (by bigram) is joined to the occurrences (by document and bigram), and logarithms are
summed by document.

Every task also holds the counts of the VOCABULARY most frequent words. Each other word is rare (1/VOCABULARY of all at most):
its count and its bigrams go to the part of its hash. There, a bigram with one rare word is scored. One with two goes to both
words' parts, each of which counts it: the first word's scores it if it is counted often enough, the second's if it backs off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean, lean_group, mix, words
from .ngram_tables import scored
from .shared import saved

#: Words whose counts every task holds at most (16 bits each, 1 MB in all), and words of the dense table (2 MB).
VOCABULARY, HEAD = 65_535, 512
#: Occurrences that a part has on average; a part is one task's work.
PART = 2_000_000
#: An occurrence of a rare word: its hash and the bigram's, the other word's number, its place in the bigram (0: a text's first word), the row's place.
RARE = np.dtype([("word", "<u8"), ("gram", "<u8"), ("other", "<u2"), ("side", "u1"), ("place", "<i4")])
SECOND, FIRST = 1, 2
COLUMNS = ["part", "key", "ids", "x", "y", "z"]
STEP = np.uint64(0xD6E8FEB86659FD93)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, c): 64-bit hash and count of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64) if len(u) else np.zeros(0, np.int64)
            return u, c

        def batch(u, c):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

        held: list = []
        for b in batches:
            for _, _, h, _ in words(b.column(0)):
                held.append(np.unique(h, return_counts=True))
                if len(held) >= 16:
                    held = [out(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield batch(*held.pop())
        if held:
            yield batch(*out(held))

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Words in order of count: hashes, counts, the number of all words, and the unknown words' count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = hashes[order], counts[order]
        self.by_hash = np.argsort(self.hashes)
        self.sorted = self.hashes[self.by_hash]
        self.total = total
        #: counts by number; the last is the unknown word
        self.count = np.append(self.counts, total - int(self.counts.sum())).astype(np.float64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in the order, or the number of words for an unknown one."""
        if not len(self.sorted):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.by_hash[at], len(self.sorted))


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The words of the highest counts: of every count whose words, with those of all higher counts, are `most` at most."""
    levels = counts.groupBy("c").agg(F.count("*").alias("n"))
    total = levels.agg(F.sum(F.col("c") * F.col("n"))).first()[0] or 0
    top = counts.orderBy(F.desc("c")).limit(most + 1).toArrow()  # bounded
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    if len(h) > most:
        keep = c > c.min()
        h, c = h[keep], c[keep]
    return Vocabulary(h, c.astype(np.int64), int(total))


def _bigrams(v: Vocabulary, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, places of bigrams' first words, and the row of each place, of a piece of words()."""
    w = v.numbers(h)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(row[1:] == row[:-1])
    return w, first, row


def score_documents(docs: DataFrame, backoff: float = 0.4, min_count: int = 2, vocabulary_size: int | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = 2, tables: bool = False) -> DataFrame:
    """(doc_id, n_words, log_score, per_word) of every row of `docs`.

    Null and empty texts have no words: log_score 0, per_word null. Null and repeated ids are documents of their own, and
    all copies of a text count. An empty table gives no rows; further columns are ignored. min_count 1 never backs off,
    since every bigram of the corpus is counted. With a vocabulary size, words beyond it are one unknown word. A text may be
    as long as a row can be. `docs` is read four times and has to give the same rows in the same order each time, as files
    and checkpoints do: a piece of texts is known by its place.

    `order` is the longest n-gram's number of words. Bigrams are packed as described above, unless `tables` is asked for; any
    other order has a table for each length of n-grams (ngram_tables.py), some 30 bytes for each distinct n-gram and row.
    """
    if order != 2 or tables:
        if vocabulary_size is not None or order < 1:
            raise ValueError("tables hold n-grams of 1 word or more, and every word")
        out = scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), order, backoff, min_count)
        return out.withColumn("per_word", F.expr("log_score / nullif(n_words, 0)"))
    if vocabulary_size is not None and vocabulary_size > VOCABULARY:
        raise ValueError(f"a vocabulary of more than {VOCABULARY} words")
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = saved(word_counts(rows))
    vocab = vocabulary(counts, VOCABULARY if vocabulary_size is None else vocabulary_size)
    held = sc.broadcast(vocab)
    head = min(HEAD, len(vocab.counts))
    #: the number that all rare words have
    rare = len(vocab.counts) if vocabulary_size is None and vocab.count[-1] else -1

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        c = np.zeros(head * head, np.int64)
        for b in batches:
            for _, _, h, at in words(b.column(0)):
                w, first, _ = _bigrams(v, h, at)
                x, y = w[first], w[first + 1]
                k = (x < head) & (y < head)
                c += np.bincount(x[k] * head + y[k], minlength=head * head)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["k", "c"])

    table = rows.select("text").mapInArrow(lean(dense), "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # HEAD x HEAD rows at most
    grid = np.zeros(max(1, head * head))
    grid[table["k"].to_numpy()] = table["c"].to_numpy()
    grid_held = sc.broadcast(grid)
    parts = max(1, -(-vocab.total // PART))

    def log_scores(x, y, c):
        """Logarithms of the scores of words y after words x, where c is how often they follow each other."""
        v = held.value
        with np.errstate(divide="ignore"):
            return np.where(c >= min_count, np.log(np.maximum(c, 1)) - np.log(v.count[x]), np.log(backoff) + np.log(v.count[y] / v.total))

    def dealt_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """The values in order of their keys' parts, and where each part begins."""
        part = (mix(keys) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return [*(x[order] for x in values), np.searchsorted(part[order], np.arange(parts + 1))]

    def rare_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, -1, null, hashes, counts, null) of the rare words."""
        v = held.value
        for b in batches:
            h, c = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            k = v.numbers(h) == rare
            h, c = h[k], c[k].astype(np.int64)
            h, c, cut = dealt_by(h, h, c)
            full = np.flatnonzero(np.diff(cut)).tolist()
            cols = [pa.array(full, pa.int64()), pa.array([-1] * len(full), pa.int64()), pa.nulls(len(full), pa.list_(pa.int64())), *(pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()) for x in (h, c)), pa.nulls(len(full), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, COLUMNS)

    def rare_scores(rec: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a part with the counts n of the words h adds for each of its occurrences of rare words."""
        v = held.value
        order = np.argsort(h)
        n = n[order][np.searchsorted(h[order], rec["word"])].astype(np.float64)
        s = np.log(n / v.total)
        for side in (SECOND, FIRST):
            at = np.flatnonzero(rec["side"] == side)
            _, to, c = np.unique(rec["gram"][at], return_inverse=True, return_counts=True)
            c, x, other = c[to], n[at], rec["other"][at].astype(np.int64)
            known, often = other != rare, c >= min_count
            with np.errstate(divide="ignore"):
                if side == SECOND:
                    s[at] = np.where(often, np.where(known, np.log(c) - np.log(v.count[other]), 0), np.log(backoff) + np.log(x / v.total))
                else:
                    s[at] = np.where(often, np.log(c) - np.log(x), np.where(known, np.log(backoff) + np.log(v.count[other] / v.total), 0))
        return s

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each piece of texts a row (any part, key, ids, word counts, sums of what the dense table tells, null), and a row
        (part, key, null, bigrams, places, occurrences of rare words) for each part that has some of its other bigrams.
        Document i has key + i."""
        v, grid = held.value, grid_held.value
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, h, at in words(b.column(1)):
                w, first, row = _bigrams(v, h, at)
                base = np.zeros(j - i)
                some = np.flatnonzero(np.diff(at))
                start = at[some]
                told = w[start] != rare
                base[some[told]] = np.log(v.count[w[start[told]]] / v.total)
                x, y, r = w[first], w[first + 1], row[first]
                k = (x < head) & (y < head)
                x_, y_ = x[k], y[k]
                base += np.bincount(r[k], log_scores(x_, y_, grid[x_ * head + y_]), j - i)
                k = ~(k | (x == rare) | (y == rare))
                gram = x[k].astype(np.uint32) << np.uint32(16) | y[k].astype(np.uint32)
                gram, r_, cut = dealt_by(gram.astype(np.uint64), gram, r[k].astype(np.int32))
                found = []
                for side, places, words_, others in ((SECOND, np.flatnonzero(y == rare), 1, x), (FIRST, np.flatnonzero(x == rare), 0, y)):
                    found.append(rec := np.zeros(len(places), RARE))
                    f = first[places]
                    rec["word"], rec["gram"], rec["other"], rec["side"], rec["place"] = h[f + words_], mix(h[f] * STEP + h[f + 1]), others[places], side, r[places]
                found.append(rec := np.zeros(int((~told).sum()), RARE))
                rec["word"], rec["place"] = h[start[~told]], some[~told]
                rec = np.concatenate(found)
                rec, rare_cut = dealt_by(rec["word"], rec)
                full = np.flatnonzero(np.diff(cut) + np.diff(rare_cut))
                m = len(full) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(full, key % parts)),
                        pa.array(np.full(m, key)),
                        pa.array([*[None] * len(full), b.column(0)[i:j].to_pylist()], pa.list_(pa.int64())),
                        pa.array([*[gram[cut[p] : cut[p + 1]].tobytes() for p in full.tolist()], np.diff(at).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([*[r_[cut[p] : cut[p + 1]].tobytes() for p in full.tolist()], base.tobytes()], pa.binary()),
                        pa.array([*[rec[rare_cut[p] : rare_cut[p + 1]].tobytes() for p in full.tolist()], None], pa.binary()),
                    ],
                    COLUMNS,
                )
                key += j - i

    def join_counts(t: pa.Table) -> pa.Table:
        """A part: its count tables joined to its occurrences, logarithms summed by document; a row for each piece of texts
        (places and sums). The pieces' own rows pass through."""
        keys, ids = t["key"].to_pylist(), t["ids"].to_pylist()
        own, tells = [i is not None for i in ids], [k < 0 for k in keys]
        xs, ys, zs = ([None if v is None else v.as_buffer() for v in t[c]] for c in ("x", "y", "z"))  # without copies
        some = [k for k in range(len(keys)) if not own[k] and not tells[k]]
        s, rare_s = np.zeros(0), np.zeros(0)
        if some:
            u, at, c = np.unique(np.concatenate([np.frombuffer(xs[k], np.uint32) for k in some]), return_inverse=True, return_counts=True)
            s = log_scores((u >> np.uint32(16)).astype(np.int64), (u & np.uint32(0xFFFF)).astype(np.int64), c)[at]
            del u, at, c
            rec = np.concatenate([np.frombuffer(zs[k], RARE) for k in some])
            if len(rec):
                h, n = (np.concatenate([np.frombuffer(x[k], kind) for k in range(len(keys)) if tells[k]]) for x, kind in ((xs, np.uint64), (ys, np.int64)))
                rare_s = rare_scores(rec, h, n)
            del rec
        done = rare_done = 0
        for k in some:
            r, z = np.frombuffer(ys[k], np.int32), np.frombuffer(zs[k], RARE)["place"]
            places, to = np.unique(np.concatenate([r, z]), return_inverse=True)
            xs[k], ys[k] = places.tobytes(), np.bincount(to, np.concatenate([s[done : done + len(r)], rare_s[rare_done : rare_done + len(z)]]), len(places)).tobytes()
            done, rare_done = done + len(r), rare_done + len(z)
        keep = [k for k in range(len(keys)) if not tells[k]]
        xs, ys = ([None if v is None else v if isinstance(v, bytes) else v.to_pybytes() for v in f] for f in (xs, ys))
        return pa.table([pa.array([f[k] for k in keep], kind) for f, kind in ((keys, pa.int64()), (ids, pa.list_(pa.int64())), (xs, pa.binary()), (ys, pa.binary()))], ["key", "ids", "x", "y"])

    def add_up(t: pa.Table) -> pa.Table:
        """A piece of texts: what its own row and all parts tell, by document."""
        ids, xs, ys = t["ids"].to_pylist(), t["x"].to_pylist(), t["y"].to_pylist()
        k = next(k for k, i in enumerate(ids) if i is not None)
        total = np.frombuffer(ys[k]).copy()
        for j, (x, y) in enumerate(zip(xs, ys, strict=True)):
            if j != k:
                total[np.frombuffer(x, np.int32)] += np.frombuffer(y)
        return pa.table([pa.array(ids[k], pa.int64()), pa.array(np.frombuffer(xs[k], np.int64)), pa.array(total)], ["doc_id", "n_words", "log_score"])

    schema = "part long, key long, ids array<long>, x binary, y binary, z binary"
    dealt = rows.mapInArrow(lean(occurrences), schema)
    if rare >= 0:
        dealt = dealt.union(counts.mapInArrow(lean(rare_counts), schema))
    sums = dealt.groupBy("part").applyInArrow(lean_group(join_counts), "key long, ids array<long>, x binary, y binary")
    out = sums.groupBy("key").applyInArrow(lean_group(add_up), "doc_id long, n_words long, log_score double")
    return out.select("doc_id", "n_words", "log_score", F.expr("log_score / nullif(n_words, 0)").alias("per_word"))
