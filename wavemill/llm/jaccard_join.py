"""N-gram Jaccard join with signature trees: which documents are linked, directly or over others.

1. Documents with equal shingle sets form a class. All further work is on classes, so copies cost nothing.
2. Classes that could be linked meet in groups: sets with Jaccard similarity of t or more share one of their first
   n - ceil(t n) + 1 shingles in any common order. The order is by hash, with frequent shingles last, so a passage that
   many documents share makes no large group. (Which shingles count as frequent affects the cost only.)
3. In a group, a signature tree: leaves and inner nodes hold OR-combined bitmaps of shingles and ranges of set sizes. Pairs
   of nodes are traversed together; a pair is dropped when its sizes differ too much, when bitmaps leave too little
   overlap, or when all below has one label already.
4. Surviving pairs are verified on the whole sets. A first round proposes a spanning forest of each group only, or of each
   chunk of a large group; its links are merged into labels. In large groups a few members of every label then meet, whose
   links merge the labels of the chunks, so that a group of near copies is settled without all its chunks meeting. The last
   round drops the groups of one label, finds in the others the classes that survive with a class of another label, and with
   finer bitmaps of these proposes all their surviving pairs of different labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U64, lean, lean_group, mix, shingles
from .shared import batches_of, components, saved

WORDS, PERCENT = 5, 80
#: Shingles held by at least so many classes come last in the order; the most frequent of them, 8 bytes each.
FREQUENT, MOST_FREQUENT = 24, 200_000
#: Members of a group that one task holds at once; larger groups are split in chunks that meet pairwise.
CHUNK = 4096
#: Bits of a bitmap a shingle: few tell texts apart that share a passage only; more are needed near the threshold.
COARSE, FINE = 2, 16
#: Rows of smaller groups that are worked on together.
UNIT = 10_000
LEAF, FANOUT = 16, 8
#: Members that stand for a label of a large group when its chunks' labels are merged.
STAND = 32
#: Sets that a task remembers to have passed on; beyond, it begins anew and repeats are taken out later.
SEEN = 100_000
#: Rows of an Arrow batch of texts, and of one of pairs of whole sets.
TEXTS, PAIRS = 2000, 200


def set_id(s: np.ndarray) -> int:
    """Hash of a set of shingles, as a signed long."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s + U64(0x51ED270B)).sum(dtype=np.uint64) + U64(len(s)) * U64(0x9E3779B97F4A7C15)], np.uint64))
    return int(h.view(np.int64)[0])


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a sorted set, of which every linked set has one among its own first."""
    n = len(s)
    m = n - -(-n * percent // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        late = frequent[at] == s
        if late.any():
            s = np.concatenate((s[~late], s[late]))
    return s[:m]


def bitmap(s: np.ndarray, per: int = COARSE) -> np.ndarray:
    """A set's bits in a power of two of at least `per` bits a shingle, within 128 and 65536 bits."""
    bits = 1 << int(min(16, max(7, (per * len(s) - 1).bit_length())))
    out = np.zeros(bits // 8, np.uint8)
    at = (s >> U64(20)) & U64(bits - 1)
    np.bitwise_or.at(out, (at >> U64(3)).astype(np.int64), (np.uint8(1) << (at & U64(7)).astype(np.uint8)))
    return out.view(np.uint64)


def _step(words: int) -> int:
    """Pairs of bitmaps of so many words that are compared at once: 8 MB of each side."""
    return max(64, min(1 << 14, (1 << 20) // max(1, words)))


def _fold(b: np.ndarray, words: int) -> np.ndarray:
    while b.shape[1] > words:
        b = b[:, : b.shape[1] // 2] | b[:, b.shape[1] // 2 :]
    return b


class _Level:
    """Nodes of one height: OR-combined bitmaps, size range, the most shingles that share bits, and the label if only one."""

    def __init__(self, bits, low, high, excess, label, same):
        self.bits, self.low, self.high, self.excess, self.label, self.same = bits, low, high, excess, label, same

    def up(self, fan: int) -> _Level:
        at = np.arange(0, len(self.low), fan)
        lo, hi = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        return _Level(np.bitwise_or.reduceat(self.bits, at, 0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.excess, at), lo, (lo == hi) & np.logical_and.reduceat(self.same, at))


def traverse(sizes: np.ndarray, bits: np.ndarray, labels: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of members that may be linked and have different labels, in blocks. Members are sorted by size."""
    excess = sizes - np.bitwise_count(bits).sum(1)
    tree = [_Level(bits, sizes, sizes, excess, labels, np.ones(len(sizes), bool))]
    fans = []
    while len(tree[-1].low) > 1:
        fans.append(LEAF if len(tree) == 1 else FANOUT)
        tree.append(tree[-1].up(fans[-1]))

    def survive(v: _Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # the larger of a linked pair has at most 100/percent times the smaller's size
        ok = (v.high[a] * 100 >= v.low[b] * percent) & (v.high[b] * 100 >= v.low[a] * percent) & ~(v.same[a] & v.same[b] & (v.label[a] == v.label[b]))
        step = _step(v.bits.shape[1])
        for i in range(0, len(a), step):
            k = np.flatnonzero(ok[i : i + step]) + i
            most = np.bitwise_count(v.bits[a[k]] & v.bits[b[k]]).sum(1) + np.minimum(v.excess[a[k]], v.excess[b[k]])
            ok[k] = most * (100 + percent) >= (v.low[a[k]] + v.low[b[k]]) * percent
        return ok

    # a node with itself always survives, unless it has one label and nothing to tell apart
    stack = [(len(tree) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), False)]
    while stack:
        h, a, b, tested = stack.pop()
        v = tree[h]
        if h == 0:
            keep = a < b
            a, b = a[keep], b[keep]
            ok = survive(v, a, b)
            if ok.any():
                yield a[ok], b[ok]
            continue
        if not tested:
            ok = survive(v, a, b) | ((a == b) & ~v.same[a])
            a, b = a[ok], b[ok]
        if not len(a):
            continue
        fan, n = fans[h - 1], len(tree[h - 1].low)
        # depth first: of each height the stack holds one block of node pairs
        step = max(1, (1 << 16) // (fan * fan))
        i = (len(a) - 1) // step * step
        if i:
            stack.append((h, a[:i], b[:i], True))
        x = (a[i:, None] * fan + np.repeat(np.arange(fan), fan)).ravel()
        y = (b[i:, None] * fan + np.tile(np.arange(fan), fan)).ravel()
        keep = (x < n) & (y < n) & (x <= y)
        stack.append((h - 1, x[keep], y[keep], False))


def group_pairs(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], labels: np.ndarray, forest: bool, side: np.ndarray | None = None, percent: int = PERCENT) -> set[tuple[int, int]]:
    """Pairs of ids of a group that may be linked; with `forest`, only a spanning forest of them. With `side` (0, 1), only
    pairs of both sides."""
    order = np.lexsort((ids, sizes))
    ids, sizes, labels = ids[order], sizes[order], labels[order]
    bits = [bits[k] for k in order]
    side = None if side is None else side[order]
    width = np.array([len(b) for b in bits])
    out: set[tuple[int, int]] = set()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        more = np.flatnonzero((width > w) & (sizes * percent <= 100 * sizes[own].max()))
        at = np.concatenate((own, more))  # still by size
        b = np.concatenate([np.stack([bits[k] for k in own]), *[_fold(bits[k][None], w) for k in more]])
        for x, y in traverse(sizes[at], b, labels[at], percent):
            keep = x < len(own)  # two wider ones meet at their own width
            x, y = at[x[keep]], at[y[keep]]
            if side is not None:
                keep = side[x] != side[y]
                x, y = x[keep], y[keep]
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                p, q = int(ids[i]), int(ids[j])
                if p == q:
                    continue
                if forest:
                    r, s = find(int(labels[i])), find(int(labels[j]))
                    if r == s:
                        continue
                    root[s] = r
                out.add((min(p, q), max(p, q)))
    return out


def unit_pairs(gid: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], labels: np.ndarray, forest: bool, percent: int = PERCENT) -> set[tuple[int, int]]:
    """What group_pairs gives for each of several groups; trees that are a single leaf are traversed all at once."""
    order = np.lexsort((ids, sizes, gid))
    gid, ids, sizes, labels = gid[order], ids[order], sizes[order], labels[order]
    bits = [bits[k] for k in order]
    at = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
    n = np.diff(np.append(at, len(gid)))
    out: set[tuple[int, int]] = set()
    for k in np.flatnonzero(n > LEAF).tolist():
        m = slice(at[k], at[k] + n[k])
        if (labels[m] != labels[at[k]]).any():
            out |= group_pairs(ids[m], sizes[m], bits[m], labels[m], forest, None, percent)
    leaf = np.repeat(n <= LEAF, n)
    width = np.array([len(b) for b in bits])
    place = np.zeros(len(bits), np.int64)
    tables = {}
    for w in np.unique(width[leaf]).tolist():
        rows = np.flatnonzero(leaf & (width == w))
        place[rows] = np.arange(len(rows))
        tables[w] = np.stack([bits[k] for k in rows])
    firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(LEAF, len(gid))):
        x = np.flatnonzero(leaf[:-d] & (gid[:-d] == gid[d:]) & (labels[:-d] != labels[d:]) & (sizes[:-d] * 100 >= sizes[d:] * percent))
        firsts.append(x), seconds.append(x + d)
    x, y = np.concatenate(firsts), np.concatenate(seconds)
    keep = np.zeros(len(x), bool)
    for v, w in {(int(p), int(q)) for p, q in zip(width[x], width[y], strict=True)}:
        folded = _fold(tables[w], v)
        full = np.bitwise_count(tables[v]).sum(1), np.bitwise_count(folded).sum(1)
        pick = np.flatnonzero((width[x] == v) & (width[y] == w))
        step = _step(v)
        for i in range(0, len(pick), step):
            k = pick[i : i + step]
            p, q = place[x[k]], place[y[k]]
            more = np.minimum(sizes[x[k]] - full[0][p], sizes[y[k]] - full[1][q])
            most = np.bitwise_count(tables[v][p] & folded[q]).sum(1) + more
            keep[k] = most * (100 + percent) >= (sizes[x[k]] + sizes[y[k]]) * percent
    root: dict[int, int] = {}

    def find(r: int) -> int:
        while root.setdefault(r, r) != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
        if forest:  # of all groups of the unit together
            r, q = find(int(labels[i])), find(int(labels[j]))
            if r == q:
                continue
            root[q] = r
        p, q = int(ids[i]), int(ids[j])
        out.add((min(p, q), max(p, q)))
    return out


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """Rows of kind 0: doc_id, n, sid and bitmap of every document; of kind 1: shingles frequent in a part of the table, with
    counts. Of the copies in a part one has the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0

        def counted():
            s = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            parts.clear()
            s.sort()
            u = np.unique(s[5:][s[5:] == s[:-5]])  # those held six times or more
            c = np.searchsorted(s, u, "right") - np.searchsorted(s, u)
            m = len(u)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(c.astype(np.int64)), pa.array(u.view(np.int64)), pa.nulls(m, pa.binary())], ["kind", "doc_id", "n", "sid", "bits"])

        for b in batches:
            n, sid, bits = [], [], []
            for s in shingles(b.column(1), words):
                n.append(len(s)), sid.append(set_id(s)), bits.append(None)
                if len(s) and sid[-1] not in seen:
                    seen.add(sid[-1])
                    bits[-1] = bitmap(s).tobytes()
                    parts.append(s)
                    held += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary())], ["kind", "doc_id", "n", "sid", "bits"])
            if held > 2_000_000:
                yield counted()
                seen.clear()
                held = 0
        yield counted()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(run), "kind int, doc_id long, n long, sid long, bits binary")


def _prefixes(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tokens, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in shingles(b.column(0), words):
                if len(s) and (sid := set_id(s)) not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(sid)
                    tokens.append(prefix(s, frequent.value, percent))
                    ids.append(np.full(len(tokens[-1]), sid, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], ["token", "sid"])

    return docs.select("text").mapInArrow(lean(run), "token long, sid long")


def _groups(prefixes: DataFrame) -> DataFrame:
    """(gid, sid) of the shingles that two classes or more have; groups of the same members get the same gid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tail: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        big: int | None = None  # the shingle of a group so large that its rows are passed on at once

        def out(gid, sid):
            return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(sid)], ["gid", "sid"])

        def emit(token, sid, last: bool):
            nonlocal tail, big
            gids, sids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid = token[new], sid[new]
            if big is not None:
                m = int(np.searchsorted(token, big, "right"))
                gids.append(token[:m]), sids.append(sid[:m])
                token, sid = token[m:], sid[m:]
                if len(token):
                    big = None
            at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            if not last and len(at):
                tail = token[at[-1] :], sid[at[-1] :]
                token, sid, at = token[: at[-1]], sid[: at[-1]], at[:-1]
                if len(tail[0]) > CHUNK:
                    big = int(tail[0][0])
                    gids.append(tail[0]), sids.append(tail[1])
                    tail = (token[:0], sid[:0])
            else:
                tail = (token[:0], sid[:0])
            if len(at):
                n = np.diff(np.append(at, len(token)))
                with np.errstate(over="ignore"):
                    lists = mix(np.add.reduceat(mix(sid.view(np.uint64) + U64(77)), at) + n.astype(np.uint64)).view(np.int64)
                for k in np.flatnonzero(n > 1).tolist():
                    g = int(lists[k])
                    if g not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(g)
                        sids.append(sid[at[k] : at[k] + n[k]])
                        gids.append(np.full(n[k], g))
            return out(np.concatenate(gids), np.concatenate(sids))

        for b in batches:
            t, s = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield emit(np.concatenate((tail[0], t)), np.concatenate((tail[1], s)), False)
        yield emit(*tail, True)

    return prefixes.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(lean(run), "gid long, sid long").distinct()


def _sets(docs: DataFrame, words: int, involved: DataFrame) -> DataFrame:
    """(sid, n, shingles, bits) of the classes in `involved` (sid); the bitmaps are fine ones. A bitset of hashed ids, 8 MB at most, spares the others;
    the join that follows makes it exact."""
    n = involved.count()
    bits = 1 << min(26, max(12, (16 * n).bit_length()))
    table = involved.select(F.expr(f"pmod(sid, {bits}) div 32").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(sid, {bits}) % 32 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    flags = np.zeros(bits // 32, np.int64)
    flags[table["w"].to_numpy()] = table["b"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = held.value, set()
        for b in batches:
            rows = []
            for s in shingles(b.column(0), words):
                sid = set_id(s)
                p = sid % bits
                if len(s) and sid not in seen and flags[p // 32] >> (p % 32) & 1:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(sid)
                    rows.append((sid, len(s), s.tobytes(), bitmap(s, FINE).tobytes()))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["sid", "n", "shingles", "bits"])

    rows = docs.select("text").mapInArrow(lean(run), "sid long, n long, shingles binary, bits binary")
    out = saved(rows.join(involved, "sid", "left_semi").dropDuplicates(["sid"]))
    held.unpersist()
    return out


def _labelled(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(gid, sid, label); without labels each class is its own."""
    if labels is None:
        return groups.withColumn("label", F.col("sid"))
    return groups.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("gid", "sid", F.coalesce("label", "sid").alias("label"))


def _open(groups: DataFrame) -> DataFrame:
    """(gid, chunks, near) of the groups (gid, sid, label) that have members of several labels."""
    sizes = groups.groupBy("gid").agg(F.count("*").alias("members"), F.min("sid").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return sizes.select("gid", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"), F.when(F.col("members") > LEAF, F.col("gid")).otherwise(F.col("least")).alias("near"))


def _proposed(groups: DataFrame, info: DataFrame, what: str, percent: int, across: bool = True) -> DataFrame:
    """(a, b), a < b: pairs of different labels that survive the traversal of their group's tree; of `what`, `pairs`, a `forest`
    of them, or only their `members` (a = b). `across`: chunks of large groups meet pairwise, else each by itself. `groups`:
    (gid, sid, label), `info`: (sid, n, bits)."""
    forest = what == "forest"
    x = groups.join(saved(_open(groups)), "gid")  # saved, so that a large group's rows can be split among tasks
    own = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    # chunk i meets chunk j in unit (gid, i, j); groups of one chunk share units
    units = max(1, groups.count() // UNIT)
    x = x.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)) if across else F.col("own"))
    # small groups with the same smallest member tend to hold the same pairs, which then are made once
    unit = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("near"), F.lit(units))).otherwise(F.col("gid"))
    x = x.select("gid", unit.alias("unit"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "chunks", "sid", "label").join(info, "sid")

    def run(t: pa.Table) -> pa.Table:
        gid, ids, n, labels, own = (t[c].to_numpy() for c in ("gid", "sid", "n", "label", "own"))
        bits = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        if t["chunks"][0].as_py() > 1:
            pairs = group_pairs(ids, n, bits, labels, forest, None if i == j else (own == j).astype(np.int8), percent) if len(np.unique(labels)) > 1 else set()
        else:
            pairs = unit_pairs(gid, ids, n, bits, labels, forest, percent)
        if what == "members":
            pairs = {(x, x) for p in pairs for x in p}
        a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return x.groupBy("chunks", "unit", "i", "j").applyInArrow(lean_group(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, s: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets (sid, shingles) are similar enough."""
    x = pairs.join(s.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(s.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate((p, q)))
                keep.append(int((both[1:] == both[:-1]).sum()) * (100 + percent) >= (len(p) + len(q)) * percent)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return x.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, the document's own included; null if all ids it
    could be are null. Null and empty texts have no shingles and no links: each row is its own component. Repeated rows and
    equal sets are linked. An empty table gives no rows; further columns are ignored. Sets are compared by 64-bit hashes of
    their shingles.
    """
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        first = saved(_classes(docs, words))
        rows = first.where("kind = 0").select("doc_id", "n", "sid")
        often = first.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "sid").limit(MOST_FREQUENT)
        frequent = spark.sparkContext.broadcast(np.sort(often.select("sid").toArrow()["sid"].to_numpy().view(np.uint64)))  # 1.6 MB at most
        groups = saved(_groups(_prefixes(docs, words, percent, frequent)))
        frequent.unpersist()
        links = _links(docs, first, groups, words, percent)
    if links is None:
        label = rows.select("sid").where("false").select(F.col("sid").alias("node"), F.col("sid").alias("label"))
    else:
        label = components(links)
    out = rows.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    lone = F.col("n") == 0
    # saved, so that the rows of a large component can be split among tasks
    smallest = saved(out.where(~lone).groupBy("label").agg(F.min("doc_id").alias("component_id")))
    some = out.where(~lone).join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(out.where(lone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _links(docs: DataFrame, first: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame | None:
    if groups.isEmpty():
        return None
    info = first.where("kind = 0 and bits is not null").select("sid", "n", "bits")
    info = saved(info.join(groups.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]))
    tried = saved(_proposed(_labelled(groups, None), info, "forest", percent, across=False))
    if tried.isEmpty():
        return None
    links = _checked(docs, tried, words, percent)
    labels = components(links)
    large = saved(_open(_labelled(groups, None)).where("chunks > 1").select("gid"))
    if not large.isEmpty():
        some = _labelled(groups.join(large, "gid", "left_semi"), labels)
        stand = F.row_number().over(Window.partitionBy("gid", "label").orderBy(F.xxhash64("sid"), "sid"))
        some = saved(some.withColumn("r", stand).where(F.col("r") <= STAND).drop("r"))
        more = saved(_proposed(some, info, "forest", percent).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            links, tried = saved(links.unionByName(_checked(docs, more, words, percent))), tried.unionByName(more)
            labels = components(links)
    known = saved(_labelled(groups, labels))
    left = saved(_proposed(known, info, "members", percent).select(F.col("a").alias("sid")))
    if left.isEmpty():
        return links
    sets = _sets(docs, words, left)
    rest = _proposed(saved(known.join(left, "sid", "left_semi")), sets.select("sid", "n", "bits"), "pairs", percent)
    return saved(links.unionByName(_saved_pairs(rest.join(tried, ["a", "b"], "left_anti"), sets, percent)))


def _checked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs that are links."""
    sets = _sets(docs, words, saved(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    return _saved_pairs(pairs, sets, percent)


def _saved_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    with batches_of(pairs.sparkSession, PAIRS):
        return saved(_verified(pairs, sets, percent))
