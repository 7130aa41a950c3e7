"""Language ID as a mixture: expectation-maximisation estimates each text's shares of languages.

A language is a distribution over hashed byte trigrams of lower-cased text, counted on labelled rows. For a text, EM finds
the mixture of languages that makes its trigrams likeliest; nested sets of its strongest languages are then compared by
likelihood less a penalty for each further language (BIC), and the best set's shares are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import lean, utf8
from .shared import clear_of

BITS = 16
GRAM = 3
#: Cells of a model, buckets x languages (32 MB). Beyond 2**(CELLS - BITS) languages there are fewer buckets for each.
CELLS = 23
#: Languages whose counts a training task holds at once (16 MB); more are passed on and begun anew.
HELD = 32
NO_LANGUAGE = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[: 0x21] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def buckets(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bucket of the trigram that begins at each byte but the last two; A-Z and two-byte Latin capitals in lower case,
    control characters as spaces."""
    x = _FOLD[data]
    x[_SPACE[x]] = 32
    if len(x) > 1:
        after = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] < 0x9F) & (x[1:] >= 0x80)) + 1
        x[after] += 32
    y = x.astype(np.uint32)
    if len(y) < GRAM:
        return np.zeros(0, np.uint32)
    v = y[:-2] << np.uint32(16) | y[1:-1] << np.uint32(8) | y[2:]
    return (v * np.uint32(2654435761)) >> np.uint32(32 - bits)


def bits_of(languages: int) -> int:
    """Bits of a bucket's number, so that a model of any number of languages up to 2**15 has 2**CELLS cells at most."""
    return max(8, min(BITS, CELLS - (max(1, languages) - 1).bit_length()))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_training_rows: int = 50_000, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """(languages, likelihood table of buckets x languages) from rows with a label.

    If there are more than `max_training_rows` rows, those whose hash of text and seed falls below the fitting threshold
    are taken; that bounds the work, and only this fit is sampled. Null labels and texts are left out; repeated rows count as
    often as they occur; an empty table gives a model of no language. Any number of languages is learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = sum(r["count"] for r in rows.groupBy("lang").count().collect())  # a row for each language
    if n > max_training_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * max_training_rows / n))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    bits = bits_of(len(langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted():
            for lang, c in seen.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])
            seen.clear()

        for b in batches:
            data, off = utf8(b.column(0))
            for r, lang in enumerate(b.column(1).to_pylist()):
                if lang not in seen and len(seen) >= HELD:
                    yield from counted()
                c = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                c += np.bincount(buckets(data[off[r] : off[r + 1]], bits), minlength=1 << bits)
        yield from counted()

    # at most 2**CELLS rows reach the driver, whatever the corpus
    table = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)))
    counts[table["bucket"].to_numpy(), table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = table["n"]
    # smoothed with the mean of the languages, so that rare trigrams tell little
    rest = (counts.sum(1, keepdims=True) + 0.5) / max(1.0, counts.sum() + 0.5 * len(counts))
    strength = 2000.0
    return langs, ((counts + strength * rest) / (counts.sum(0, keepdims=True) + strength)).astype(np.float32)


def _em(p: np.ndarray, c: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Shares of the columns of p, and the log-likelihood of counts c."""
    share, n = np.full(p.shape[1], 1 / p.shape[1], np.float32), np.float32(c.sum())
    for _ in range(steps if p.shape[1] > 1 else 0):
        new = share * (p.T @ (c / (p @ share))) / n
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(c @ np.log(p @ share))


def shares_of(data: np.ndarray, table: np.ndarray, steps: int = 25, least: float = 0.02) -> list[tuple[int, float]]:
    """The languages in a text (UTF-8 bytes) with their shares, largest first."""
    b = buckets(data, max(1, len(table)).bit_length() - 1)
    if not len(b) or not table.shape[1]:
        return []
    at, c = np.unique(b, return_counts=True)
    p, c = table[at], c.astype(np.float32)
    share, _ = _em(p, c, steps)
    order = [int(k) for k in np.argsort(-share, kind="stable") if share[k] >= least] or [int(share.argmax())]
    n = c.sum() / GRAM  # overlapping trigrams don't count fully
    best: tuple[float, list] | None = None
    for k in range(1, len(order) + 1):
        s, ll = _em(p[:, order[:k]], c, steps)
        value = ll / GRAM - 0.5 * (k - 1) * np.log(n + 1)
        if best is not None and value <= best[0]:
            break
        best = value, list(zip(order[:k], s.tolist(), strict=True))
    return sorted(best[1], key=lambda x: (-x[1], x[0]))


def has_letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data].any()) or (bool((data > 127).any()) and any(map(str.isalpha, data.tobytes().decode("utf-8", "replace"))))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of every row of `docs`, lang_pred, score and languages.

    lang_pred is the language with the largest share of the whole text and score that share; `languages` has the chosen
    set. A text that is null or without letters, or any if no language was learned, is `und` with score 0 and no
    languages; a text of fewer than three bytes gets the first language with score 1/languages. Nothing but the text
    decides, so equal texts and repeated rows get equal answers. An empty table gives no rows. Where `keep` has a column
    called lang_pred, score or languages, the new one is named with _ before.
    """
    langs, table = model
    kept = docs.select(*keep)
    text, pred_, score_, sets_ = clear_of(kept, "text_of_langid", "lang_pred", "score", "languages")
    x = kept if text_col in keep else docs.select(*keep, F.col(text_col).alias(text))
    at, m = (keep.index(text_col) if text_col in keep else len(keep)), len(keep)
    held = docs.sparkSession.sparkContext.broadcast(table)  # 2**CELLS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            data, off = utf8(b.column(at))
            pred, score, sets = [], [], []
            for r in range(b.num_rows):
                text = data[off[r] : off[r + 1]]
                if not langs or not has_letter(text):
                    pred.append(NO_LANGUAGE), score.append(0.0), sets.append([])
                    continue
                found = shares_of(text, table) or [(0, 1 / len(langs))]
                pred.append(langs[found[0][0]])
                score.append(min(1.0, max(0.0, found[0][1])))
                sets.append([{"lang": langs[k], "share": s} for k, s in found])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], [*b.schema.names[:m], pred_, score_, sets_])

    share = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    out = T.StructType([*kept.schema, T.StructField(pred_, T.StringType()), T.StructField(score_, T.DoubleType()), T.StructField(sets_, share)])
    return x.mapInArrow(lean(run), out)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id, so that it is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))
