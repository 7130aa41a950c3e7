"""Token ids by a public tokenizer of white-space separated words, and token counts of a table's texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import lean, pieces, prefix_hash, span_hash, utf8

#: Words whose ids a worker keeps (some 40 MB). Beyond, those seen in one piece of texts only are forgotten.
MOST_WORDS = 1_000_000


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_ASCII_REST = np.zeros(256, bool)
_ASCII_REST[0x21:0x7F] = True
_ASCII_REST &= ~_LETTERS


class WordTokenizer:
    """Ids of texts by a tokenizer that treats white-space separated words on their own and splits at the end of a run of
    letters (the pattern of word_bpe_49k.json): each distinct run is encoded once by the tokenizer, the rest is lookup.

    A run ends at ASCII white space, and between a letter (A-Z, a-z, U+00C0-U+00FF but the signs × and ÷) and an ASCII
    character that is none: there the tokenizer's own pattern always ends a match, and normalisation never joins the two.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: strings that are one id of their own wherever they stand in a text, as the tokenizer's file says
        self.marks = [(t.content.encode(), i) for i, t in self.tok.get_added_tokens_decoder().items()]
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used, self.pool = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > MOST_WORDS // 2:
            keep = keep[:0]
        n = self.n[keep].astype(np.int64)
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.at[keep] - (ends - n), n) + np.arange(int(n.sum()))]
        self.known, self.at, self.n, self.used = self.known[keep], ends - n, self.n[keep], np.ones(len(keep), np.uint8)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        plain = [k for k, w in enumerate(words) if w.isalpha()]  # ASCII letters only: one match each
        odd = [k for k, w in enumerate(words) if not w.isalpha()]
        counts, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)] * len(words)
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            x = np.array(self.tok.encode(" ".join(words[k].decode() for k in part), add_special_tokens=False).ids, np.uint32)
            for k, y in zip(part, np.split(x, np.flatnonzero(self.last[x])[:-1] + 1), strict=True):
                ids[k] = y
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            for k, e in zip(part, self.tok.encode_batch([words[k].decode("utf-8", "replace") for k in part], add_special_tokens=False), strict=True):
                ids[k] = np.array(e.ids, np.uint32)
        counts[:] = [len(x) for x in ids]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def encode(self, data: np.ndarray, off: np.ndarray, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes and offsets as of kernels.utf8), and where each text's begin. Without ids, only where they
        would begin."""
        raw = data.tobytes()
        found = []
        for mark, i in self.marks:
            at = raw.find(mark)
            while at >= 0:
                if np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(mark) - 1, "right"):  # in one text
                    found.append((at, at + len(mark), i))
                at = raw.find(mark, at + 1)
        if not found:
            return self._words(data, off, with_ids)
        # what stands before and after a mark is encoded on its own
        start, end, ids = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))
        cuts = np.unique(np.concatenate((off, start, end)))
        data = data.copy()
        for a, b in zip(start, end, strict=True):
            data[a:b] = 0x20
        got, before = self._words(data, cuts, with_ids)
        out = np.insert(got, before[np.searchsorted(cuts, start)], ids) if with_ids else got
        return out, before[np.searchsorted(cuts, off)] + np.searchsorted(start, off)

    def _words(self, data: np.ndarray, off: np.ndarray, with_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        gap = _GAP[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        letter = _LETTERS[data]
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) + 1
        letter[wide] = True
        cut = first[:n].copy()
        cut[1:] |= gap[:-1] | (letter[:-1] & _ASCII_REST[data[1:]])
        start = np.flatnonzero(cut & ~gap)
        end_at = np.zeros(n, bool)
        end_at[-1] = True
        end_at[:-1] = gap[1:] | cut[1:]
        end = np.flatnonzero(end_at & ~gap) + 1
        h = span_hash(prefix_hash(data), start, end)
        u, where, inv = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, u)
        new = np.ones(len(u), bool)
        inside = pos < len(self.known)
        new[inside] = self.known[pos[inside]] != u[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > MOST_WORDS and len(self.known):
                self._forget()
                pos = np.searchsorted(self.known, u)
                inside = pos < len(self.known)
                new = np.ones(len(u), bool)
                new[inside] = self.known[pos[inside]] != u[inside]
            ids, counts = self._encode([data[start[k] : end[k]].tobytes() for k in where[new]])
            ends = np.cumsum(counts)
            self.at = np.insert(self.at, pos[new], len(self.pool) + ends - counts)
            self.n = np.insert(self.n, pos[new], counts.astype(np.int32))
            self.used = np.insert(self.used, pos[new], np.uint8(0))
            self.known = np.insert(self.known, pos[new], u[new])
            self.pool = np.concatenate((self.pool, ids))
            pos = np.searchsorted(self.known, u)
        self.used[pos] = np.minimum(self.used[pos], 250) + 1
        slot = pos[inv]
        n_ids = self.n[slot].astype(np.int64)
        ends = np.cumsum(n_ids)
        if not with_ids:
            return np.zeros(0, np.uint32), np.concatenate(([0], ends))[np.searchsorted(start, off)]
        total = int(ends[-1]) if len(ends) else 0
        gather = np.repeat(self.at[slot] - (ends - n_ids), n_ids) + np.arange(total)
        before = np.concatenate(([0], ends))[np.searchsorted(start, off)]
        return self.pool[gather], before


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str | None) -> WordTokenizer:
    """The worker's tokenizer for a file; by default public_tokenizers' word_bpe_49k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def with_token_counts(docs: DataFrame, name: str, tokenizer_path: str | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with a column `name`: how many ids the tokenizer gives each whole text; 0 for a null or empty one."""
    schema = T.StructType([*docs.schema, T.StructField(name, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        for b in batches:
            data, off = utf8(b.column(at))
            n = [np.diff(tok.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], False)[1]) for i, j in pieces(off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n) if n else [], pa.int64())], [*b.schema.names, name])

    return docs.mapInArrow(lean(run), schema)
