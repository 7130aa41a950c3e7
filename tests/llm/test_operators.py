"""The ten operators against brute force on small and odd tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import ann, chat, jaccard_join, kernels, langid, lm_score, mixing, packing, queries, shard, shared, sql, token_rollup, tokens, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, sid long, label string, copies int, share long, key string, part int, bucket int"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "sh", "é", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def odd_rows(seed=0):
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies, columns with clashing names."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), " ".join([*near[:100], "x", "y"]), "", None, " \t\n", "one", "One", "two words", "one two three four", "ä ß ÑÉ 12 !?", "a <|endoftext|> b <|ENDOFTEXT|>", prose(rng, 6000), base.upper(), *[prose(rng, rng.randint(1, 90)) for _ in range(20)]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), None, 1, 2, "x", 3, 4, "k", 5, 6) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base, "en", "src0", 0, 0, 0, "", 0, 0, "", 0, 0), (None, None, None, None, None, None, None, None, None, None, None, None, None), (0, "same id", "en", "src0", 0, 0, 0, "", 0, 0, "", 0, 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(map(repr, rows))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# op 1


def brute_scores(rows, most=65535, backoff=0.4, min_count=2):
    all_words = [split(t) for _, t in rows]
    c = Counter(w for ws in all_words for w in ws)
    total = sum(c.values())
    levels, kept = Counter(c.values()), 0
    low = math.inf
    for n in sorted(levels, reverse=True):
        if kept + levels[n] > most:
            break
        kept += levels[n]
        low = n
    known = {w for w in c if c[w] >= low}
    all_words = [[w if w in known else None for w in ws] for ws in all_words]
    c = Counter(w for ws in all_words for w in ws)
    pairs = Counter(p for ws in all_words for p in zip(ws, ws[1:]))
    out = []
    for (i, _), ws in zip(rows, all_words):
        s = math.log(c[ws[0]] / total) if ws else 0.0
        for v, w in zip(ws, ws[1:]):
            s += math.log(pairs[v, w] / c[v]) if pairs[v, w] >= min_count else math.log(backoff * c[w] / total)
        out.append((i, len(ws), round(s, 6)))
    return out


@pytest.mark.parametrize("most", [65535, 40])
def test_lm_scores(docs, most):
    got = lm_score.score_documents(docs, vocabulary_size=most).collect()
    want = brute_scores([(r.doc_id, r.text) for r in docs.collect()], most)
    assert bag((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == bag(want)
    assert all((r.per_word is None) == (r.n_words == 0) for r in got)


def test_lm_scores_parts(docs, monkeypatch):
    """Many parts and a small dense table give the same scores."""
    want = bag((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.score_documents(docs).collect())
    monkeypatch.setattr(lm_score, "PART", 200)
    monkeypatch.setattr(lm_score, "HEAD", 5)
    assert bag((r.doc_id, r.n_words, round(r.log_score, 6)) for r in lm_score.score_documents(docs).collect()) == want


def test_lm_whole_vocabulary(spark):
    """More distinct words than every task holds counts of: rare words keep their own counts, alone, first, second and in pairs."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(70_000)]
    rows = [(i, " ".join(names[i * 700 : (i + 1) * 700])) for i in range(100)]
    rows += [(100 + i, " ".join(names[s : s + 9] + ["w7", "w7"])) for i, s in enumerate(rng.sample(range(60_000), 200))]
    rows += [(300, "w69999 w69999 w69999"), (301, "w1 w69000 w2 w69001 w1 w69000"), (302, "w68000"), (303, "w68001 w68001"), (304, None)]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert bag((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got) == bag((i, n, round(s, 5)) for i, n, s in brute_scores(rows, math.inf))


def test_lm_rare_in_parts(spark, docs, monkeypatch):
    """Few frequent words and many parts: most bigrams are those of two rare words."""
    monkeypatch.setattr(lm_score, "PART", 200)
    monkeypatch.setattr(lm_score, "HEAD", 3)
    monkeypatch.setattr(lm_score, "VOCABULARY", 9)
    for min_count in (1, 2):
        got = lm_score.score_documents(docs, min_count=min_count).collect()
        want = brute_scores([(r.doc_id, r.text) for r in docs.collect()], min_count=min_count)
        assert bag((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == bag(want)


def test_lm_empty(empty):
    assert lm_score.score_documents(empty).collect() == []


# op 2


def brute_shares(children, goal):
    """Water-filling by repeated passes: {name: share} of {name: (weight, stock)}."""
    share, open_ = {}, dict(children)
    goal = min(goal, sum(s for _, s in children.values()))
    while open_:
        w = sum(x for x, _ in open_.values())
        full = [k for k, (x, s) in open_.items() if s * w <= goal * x]
        if not full:
            order = sorted(open_, key=lambda k: (open_[k][1] / open_[k][0], k))
            part = {k: goal * open_[k][0] // w for k in order}
            part[order[0]] += goal - sum(part.values())
            return share | part
        k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
        share[k] = open_[k][1]
        goal -= open_.pop(k)[1]
    return share


def brute_mix(rows, budget, weights, epochs, seed):
    """(copies of each row, share by leaf) for rows (id, source, lang, tokens)."""
    rows = [(i, s or "(none)", l or "(none)", t) for i, s, l, t in rows]
    leaves = Counter()
    for _, s, l, t in rows:
        leaves[(s if s == "(none)" else s[-1]), l, s] += t
    leaves = {k: v for k, v in leaves.items() if v}
    goal = int(sum(leaves.values()) * budget) if isinstance(budget, float) else budget
    stock = lambda *p: sum(epochs * v for k, v in leaves.items() if k[: len(p)] == p)
    share = {}
    top = brute_shares({d: (weights["domain"].get(d, 1), stock(d)) for d in {k[0] for k in leaves}}, goal)
    for d, g in top.items():
        mid = brute_shares({l: (weights["lang"].get(l, 1), stock(d, l)) for l in {k[1] for k in leaves if k[0] == d}}, g)
        for l, h in mid.items():
            for s, x in brute_shares({s: (weights["source"].get(s, 1), stock(d, l, s)) for s in {k[2] for k in leaves if k[:2] == (d, l)}}, h).items():
                share[d, l, s] = x
    assert sum(share.values()) == min(goal, epochs * sum(leaves.values()))
    by_leaf = defaultdict(list)
    for r in rows:
        by_leaf[r[1:3]].append(r)
    out = []
    for i, s, l, t in rows:
        k = ((s if s == "(none)" else s[-1]), l, s)
        if not t:
            out.append(0)
            continue
        whole, rest = divmod(share[k], leaves[k])
        key = lambda j: hashlib.md5(f"{seed}|{whole}|{'' if j is None else j}".encode()).hexdigest()
        before = sum(u for j, _, _, u in by_leaf[s, l] if key(j) < key(i))
        out.append(whole + (before < rest))
    return out


@pytest.mark.parametrize("budget", [0.3, 1.0, 700, 10**9])
@pytest.mark.parametrize("leaves", [10_000, 0])
def test_mixing(docs, budget, leaves, monkeypatch):
    """Also where the leaves are too many to be broadcast."""
    monkeypatch.setattr(mixing, "MOST_LEAVES", leaves)
    weights = {"domain": {"0": 3, "1": 1}, "lang": {"en": 2, "fr": 5}, "source": {}}
    got = mixing.mix(docs, budget, F.expr("right(source, 1)"), token_rollup.quarter_count(), weights, 1, 3, 5).collect()
    rows = [(r.doc_id, r.source, r.lang, (len((r.text or "").encode()) + 3) // 4) for r in docs.collect()]
    copies = brute_mix(rows, budget, weights, 3, 5)
    assert bag((r.doc_id, (len((r.text or "").encode()) + 3) // 4, r._copies) for r in got) == bag((i, t, c) for (i, _, _, t), c in zip(rows, copies))
    assert {"copies", "share", "_copies", "_share"} <= set(got[0].asDict())


SF = "/root/testdata/sf0.001"


def test_mix_query(spark, tokenizer):
    """The registered query, its tokens by the tokenizer itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs]
    copies = brute_mix([(r.doc_id, r.source, r.lang, t) for r, t in zip(docs, n)], queries.MIX_BUDGET, queries.MIX_WEIGHTS, queries.MIX_EPOCHS, queries.MIX_SEED)
    got = queries.op2_mix(spark, SF).collect()
    assert bag((r.doc_id, r.tokens, r.copies) for r in got) == bag((r.doc_id, t, c) for r, t, c in zip(docs, n, copies))


def test_mix_sql(spark):
    """With tokens of four bytes the mixture equals that of DuckDB, on a larger table."""
    import duckdb

    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = con.execute(sql.mix_by_bytes(queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS, queries.MIX_SEED)).fetchall()
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("tokens", token_rollup.quarter_count())
    got = queries.mixed(docs).select("doc_id", "lang", "source", "copies", "share").collect()
    assert bag(map(tuple, got)) == bag(want)


def test_mixing_empty(empty):
    assert mixing.mix(empty, 0.5, F.col("source"), token_rollup.quarter_count()).collect() == []


# op 3


@pytest.mark.parametrize("n", [1, 2, 3, 24, 100, 1000, 4097])
def test_permutation(n):
    p = shard.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert shard.permute(p, n, 7, inverse=True).tolist() == list(range(n))
    assert n < 100 or (p != np.arange(n)).mean() > 0.9


def test_sharding(docs, empty):
    got = shard.feistel_shard(docs, 5, 3).collect()
    rows = docs.collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.row_number)
    assert [r.doc_id is None for r in order[:2]] == [True, True]
    assert [r.doc_id for r in order[2:]] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    for r in got:
        assert (r.shard, r.slot) == shard.locate(r.row_number, len(rows), 5, 3)
        assert shard.row_at(r.shard, r.slot, len(rows), 5, 3) == r.row_number
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert bag((r.doc_id, r.size, r.text_crc32) for r in got) == bag((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    again = shard.feistel_shard(docs.repartition(7), 5, 3).collect()
    assert bag((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again) == bag((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got)
    assert shard.feistel_shard(empty).collect() == []


# op 4


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold(F.col("doc_id")) == 0
    model = langid.train(d.where(~held))
    got = langid.identify(d.where(held), model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    sample = langid.train(d.where(~held), max_training_rows=200)
    few = langid.identify(d.where(held), sample, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in few]) > 0.95
    # a text of two languages in known parts
    en, fr = (" ".join(r.text for r in d.where(F.col("lang") == x).limit(40).collect())[:20000].encode() for x in ("en", "fr"))
    mixed = np.frombuffer(en[:14000] + b" " + fr[:6000], np.uint8)
    shares = dict((model[0][k], s) for k, s in langid.shares_of(mixed, model[1]))
    assert set(shares) == {"en", "fr"} and abs(shares["en"] - 0.7) < 0.06


def brute_shares_of(text, table, steps=25, least=0.02):
    """The same estimate with dictionaries: EM over all languages, then over nested sets of the strongest, by BIC."""
    x = [c + 32 if 65 <= c <= 90 else c for c in text]
    x = [32 if c < 0x21 else c for c in x]
    x = [c + 32 if k and x[k - 1] == 0xC3 and 0x80 <= c < 0x9F else c for k, c in enumerate(x)]
    count = Counter(((x[k] << 16 | x[k + 1] << 8 | x[k + 2]) * 2654435761 % 2**32) >> 16 for k in range(len(x) - 2))
    total = sum(count.values())

    def em(langs):
        share = dict.fromkeys(langs, 1 / len(langs))
        for _ in range(steps if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g, c in count.items():
                p = sum(share[k] * float(table[g, k]) for k in langs)
                for k in langs:
                    new[k] += c * share[k] * float(table[g, k]) / p
            new = {k: v / total for k, v in new.items()}
            done = max(abs(new[k] - share[k]) for k in langs) < 1e-3
            share = new
            if done:
                break
        return share, sum(c * math.log(sum(share[k] * float(table[g, k]) for k in langs)) for g, c in count.items())

    share, _ = em(range(table.shape[1]))
    order = [k for k in sorted(share, key=lambda k: -share[k]) if share[k] >= least]
    best = None
    for m in range(1, len(order) + 1):
        s, ll = em(order[:m])
        value = ll / 3 - 0.5 * (m - 1) * math.log(total / 3 + 1)
        if best is not None and value <= best[0]:
            break
        best = value, s
    return best[1]


def test_language_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = langid.train(d)
    texts = [r.text for r in d.where("length(text) between 3 and 600").orderBy("doc_id").limit(40).collect()]
    texts += [a[:200] + " " + b[:150] for a, b in zip(texts, texts[7:])] + ["ÀÉ ñandú", "abc", "zz zz zz zz"]
    for t in texts:
        want = brute_shares_of(t.encode(), table)
        got = dict(langid.shares_of(np.frombuffer(t.encode(), np.uint8), table))
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-3 for k in want), t


def test_language_many(spark):
    """Hundreds of languages are all learned, in a table of the same size."""
    rng = random.Random(6)
    own = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(300)}
    rows = [(k, " ".join(rng.choice(w) for _ in range(60)), lang) for k, (lang, w) in enumerate(own.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    model = langid.train(docs)
    assert len(model[0]) == 300 and model[1].size <= 1 << langid.CELLS and langid.bits_of(4) == langid.BITS
    got = langid.identify(docs, model, ["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_language_names(docs):
    model = langid.train(docs)
    got = langid.identify(docs.select("doc_id", "text", F.lit(7).alias("score"), F.lit("x").alias("languages")), model, ["doc_id", "score", "languages"])
    assert got.columns == ["doc_id", "score", "languages", "lang_pred", "_score", "_languages"]
    assert {(r.score, r.languages) for r in got.collect()} == {(7, "x")} and got.count() == docs.count()


def test_language_odd(docs, empty):
    model = langid.train(docs)
    got = langid.identify(docs, model, docs.columns).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (r.score == 0 or letters)
        assert r.lang_pred in ("en", "fr", "und") and abs(sum(x.share for x in r.languages) - letters) < 1e-3 or len(r.text.encode()) < 3 or r.score
    assert langid.identify(empty, model, ["doc_id"]).collect() == []
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}


# op 5


def test_rollup(spark, docs, tmp_path):
    r = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert r.totals().collect() == []
    v = {"words-1": token_rollup.word_count(), "bytes4-1": token_rollup.quarter_count()}
    insert, gone = token_rollup.change_log(docs, "insert", v), token_rollup.change_log(docs.where("doc_id < 10"), "delete", v)
    fresh = token_rollup.change_log(docs, "revise", {"words-1": F.lit(1).cast("long")}, {"words-1": token_rollup.word_count()}, old_text="text")
    want = Counter()
    for x in docs.collect():
        for t, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))), ("bytes4-1", (len((x.text or "").encode()) + 3) // 4)):
            k = (x.source, x.lang, t)
            b = len((x.text or "").encode())
            want[k, "docs"] += 1
            want[k, "tokens"] += 1 if t == "words-1" else n
            want[k, "bytes"] += b
            if x.doc_id is not None and x.doc_id < 10:
                want[k, "docs"] -= 1
                want[k, "tokens"] -= n
                want[k, "bytes"] -= b
    for k, batch in enumerate((("a", insert), ("b", gone), ("a", insert), ("c", fresh), ("b", gone), ("c", fresh))):
        assert r.commit(*batch) == (k in (0, 1, 3))
        if k == 2:
            r.compact()
            assert r.batches() == ["base-000000001"] and r.committed("a")
    r.compact()
    got = {((x.source, x.lang, x.tokenizer), c): x[c] for x in r.totals().collect() for c in ("docs", "tokens", "bytes")}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    with pytest.raises(Exception, match="unknown op"):
        r.commit("d", token_rollup.change_log(docs, "upsert", v))
    assert not r.committed("d")
    with pytest.raises(ValueError):
        r.commit("base-1", insert)


def test_rollup_query(spark, tokenizer):
    """The registered query against counts by the tokenizer itself of the texts as they are in the end."""
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id % 11 == 5 and r.doc_id % 7 != 3:
            continue
        text = re.sub("[0-9]", "", r.text) if r.doc_id % 7 == 3 and r.text is not None else r.text or ""
        for version, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), ("word-bpe-49k", len(tokenizer.encode(text, add_special_tokens=False).ids))):
            for c, v in (("docs", 1), ("tokens", n), ("bytes", len(text.encode()))):
                want[r.source, r.lang, version, c] += v
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in queries.op5_token_rollup(spark, SF).collect() for c in ("docs", "tokens", "bytes")}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


# op 6

TRICKY = ["", "\\", "\\\\", "### user: x </turn>\n", r"\### Assistant: </turn> ok", "a </turn>\n### assistant: b", ":<#\\:", "\n\n", "é  😀", " "]


def test_chat_round_trip():
    for a in TRICKY:
        for b in TRICKY:
            turns = [("system", a), ("assistant", b), ("us:er <#\\", b), ("assistant", a)]
            text, loss = chat.render(turns)
            assert chat.parse(text) == turns
            assert [chat.unescape(text[x:y]) for x, y in loss] == [b, a]


def test_chat_layouts(spark):
    import json

    cases = [({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]), ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]), ({"prompt": "p", "response": None}, [("user", "p"), ("assistant", "")]), ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]), ({"messages": []}, [])]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(None, None), (8, "not json"), (9, '{"other": 1}'), (10, ""), (1, json.dumps(cases[0][0]))]
    got = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string"))
    by = {r.conv_id: r for r in got.collect() if r.conv_id != 1}
    for k, (_, turns) in enumerate(cases):
        if k != 1:
            assert [tuple(t) for t in by[k].turns] == turns
    assert by[None].layout is None and by[None].turns == [] and by[10].turns == []
    assert by[8].layout is None and [tuple(t) for t in by[8].turns] == [("record", "not json")] and not by[8].mapped
    assert by[9].layout and [tuple(t) for t in by[9].turns] == [("record", '{"other": 1}')] and not by[9].mapped and by[0].mapped
    assert chat.fingerprint({"a": [{"b": 1}, {"c": 2}]}) == chat.fingerprint({"a": [{"c": 5}, {"b": None}, {"b": 1}]}) != chat.fingerprint({"a": {"b": 1}})
    assert [(r.n_turns, r.loss_chars) for r in chat.read_back(got.where("conv_id = 9")).collect()] == [(1, 0)]


def test_chat_unregistered():
    """Layouts of other fingerprints are mapped by the paths that a mapping requires."""
    known = chat.common_layouts()
    for record, turns in (
        ({"id": 3, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"instruction": "i", "input": "x", "output": "o", "meta": {"a": [1]}}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "r", "score": 1}, [("user", "p"), ("assistant", "r")]),
        ({"messages": [{"role": "user", "content": ["a", 1]}]}, [("user", '["a", 1]')]),
    ):
        assert known.turns(record) == (turns, True)
    for record in ({"messages": [{"role": "user"}]}, {"prompt": "p"}, [1, 2], 5):
        (turn,), mapped = known.turns(record)
        assert not mapped and turn[0] == "record"


def test_chat_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 0, None, "x"), (None, 0, "user", "u"), (3, 0, "system", "s"), (3, 1, "user", "q"), (3, 2, "assistant", "r <"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    got = chat.read_back(chat.format_records(chat.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1))))).collect()
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert len(got) == len(by)
    for r in got:
        said = "".join(x for role, x in by[r.conv_id] if role == "assistant")
        assert r.n_turns == len(by[r.conv_id]) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in by[r.conv_id]).encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_records(chat.records_of_turns(none))).collect() == []
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    assert bag(chat.read_back_turns(chat.format_turns(table), in_order=True).collect()) == bag(got)
    assert chat.read_back_turns(chat.format_turns(none)).collect() == []


def test_chat_streams(spark):
    """A long conversation among short ones, over many batches, and its parts put in order again."""
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", None]), rng.choice([*TRICKY, None, "x" * 50])) for t in range(700)]
    rows += [(c, t, "assistant" if t % 2 else "user", rng.choice(TRICKY)) for c in range(20) if c != 5 for t in range(4)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    with shared.batches_of(spark, 16):
        parts = chat.format_turns(turns)
        one = chat.read_back_turns(parts, in_order=True).collect()
        two = chat.read_back_turns(parts.repartition(5)).collect()
        whole = {}
        for r in parts.collect():
            whole.setdefault(r.conv_id, {})[r.seq] = r
    assert bag(one) == bag(two) and len(one) == 20
    for r in one:
        mine = [x for x in rows if x[0] == r.conv_id]
        turns_ = [(x[2] or "", x[3] or "") for x in sorted(mine, key=lambda x: x[1])]
        text, spans = chat.render(turns_)
        got = [whole[r.conv_id][k] for k in range(len(turns_))]
        assert "".join(x.formatted for x in got) == text and [(x.start, x.stop) for x in got if x.start is not None] == spans
        said = "".join(t for role, t in turns_ if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns_), len(said), len(text)) and chat.parse(text) == turns_
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()


# op 7


def brute_winnow(text, k, w):
    p = winnow.code_points(text)
    if not len(p):
        return []
    k = min(k, len(p))
    h = [int(winnow.winnow(p[i : i + k], k, 1)[1][0]) for i in range(len(p) - k + 1)]
    w = min(w, len(h))
    kept = set()
    for i in range(len(h) - w + 1):
        m = min(h[i : i + w])
        kept.add(max(j for j in range(i, i + w) if h[j] == m))
    return [(j, h[j]) for j in sorted(kept)]


def test_winnow_windows():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 12, 40, 300):
        for w in (1, 2, 7, 16, 33):
            text = "".join(rng.choice("abé😀") for _ in range(n))
            got = winnow.winnow(winnow.code_points(text), 4, w)
            assert list(zip(*map(np.ndarray.tolist, got))) == brute_winnow(text, 4, w)
            assert [x.tolist() for x in winnow.decode(winnow.encode(*got))] == [x.tolist() for x in got]
    shared_part = prose(rng, 60)[:127]
    a, b = (winnow.winnow(winnow.code_points(prose(rng, 80) + shared_part + prose(rng, 80))) for _ in range(2))
    assert set(a[1].tolist()) & set(b[1].tolist())


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_winnow_compare(spark, docs, buckets):
    got = winnow.compare_edited(docs, 8, 4, buckets).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), r[1]))
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        sets = [set(winnow.winnow(winnow.code_points(x), 8, 4)[1].tolist()) for x in (a, e, b)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    assert bag((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == bag(want)
    by_text = defaultdict(set)
    for r in winnow.fingerprints(docs, k=8, window=4).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect():
        by_text[r.text].add(r.fingerprint)
    lone = spark.createDataFrame([(1, "lonely text of one row")], "doc_id long, text string")
    assert winnow.compare_edited(lone).first().near_next == 1.0
    assert winnow.compare_edited(lone.where("false")).collect() == []


def test_winnow_query_short_texts(spark, tmp_path):
    """The registered query finds the kept half of texts of 64 code points or more."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    rows = [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate([*range(64, 127), 160, 200, 253])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_winnow(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.near_edited > r.near_next + 0.05 for r in got)


def test_winnow_large_ids(spark):
    """Ids that a double cannot tell apart: every row still meets its next."""
    base = 2**62
    docs = spark.createDataFrame([(base + i, f"text {i} of many rows") for i in range(200)], "doc_id long, text string")
    assert sorted(r.doc_id - base for r in winnow.compare_edited(docs, 8, 4, 20).collect()) == list(range(200))
    wide = spark.createDataFrame([(base + 1025 * i + 1, f"text {i} of many rows") for i in range(200)], "doc_id long, text string")
    assert wide.count() == winnow.compare_edited(wide, 8, 4, 20).count()


# op 8


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 24))
    x[100:130] = x[0]
    rows = [(i, [float(v) for v in np.float32(r)], 1) for i, r in enumerate(x)]
    rows += [(3000, None, 1), (3050, [], 1), (3100, [0.0] * 24, 1), (3150, [float("nan")] * 24, 1), (3200, [1.0, None] * 12, 1), (3250, [float("inf")] + [1.0] * 23, 1), (None, rows[5][1], 1), (3300, [1.0, 2.0], 1), (3301, [2.0, 4.5], 1), rows[7]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int").repartition(3)
    got = ann.nearest(v, v.where("vec_id % 50 = 0")).collect()
    y = np.array([r[1] for r in rows[:2000]], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = r
    assert set(by) == {*range(0, 2000, 50), 3300}
    for q in range(0, 2000, 50):
        s = y @ y[q]
        best = [k for k in sorted(range(2000), key=lambda k: (-round(s[k], 12), k)) if k != q][:5]
        assert sorted(by[q]) == [1, 2, 3, 4, 5]
        hits += len({by[q][k].vec_id for k in by[q]} & set(best))
        assert all(abs(by[q][k].score - s[by[q][k].vec_id]) < 1e-12 for k in by[q])
    assert hits / 200 >= 0.95
    assert [by[0][k].vec_id for k in range(1, 6)] == [100, 101, 102, 103, 104]
    assert [r.vec_id for r in by[3300].values()] == [3301]
    assert ann.nearest(v.where("false"), v.where("false")).collect() == []


def test_nearest_cells(spark, monkeypatch):
    """Many small cells, each dealt to several tasks, and more neighbours wanted than there are."""
    for name, n in (("CELL_ROWS", 40), ("BLOCK", 16), ("QUERIES", 8)):
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((20, 16)), 50, 0) + 0.2 * rng.standard_normal((1000, 16))
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = defaultdict(list)
    for r in ann.nearest(v, v.where("vec_id % 50 = 0")).collect():
        by[r.query_id].append(r.vec_id)
    best = lambda q: [k for k in np.argsort(-(u @ u[q])).tolist() if k != q]
    assert len(by) == 20 and np.mean([len(set(by[q]) & set(best(q)[:5])) / 5 for q in by]) > 0.9
    got = ann.nearest(v.where("vec_id < 200"), v.where("vec_id = 0"), top=300).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [k for k in best(0) if k < 200] and [r["rank"] for r in got] == list(range(1, 200))


def test_nearest_lengths(spark):
    """Any number of lengths, and a fixed choice among rows of one id."""
    rows = [(100 * d + k, [float(1 + (k * j) % 5) for j in range(d)]) for d in range(1, 21) for k in range(3)]
    rows += [(5000, [3.0, 1.0]), (5000, [1.0, 0.0]), (5000, [9.0, 9.0, 9.0]), (5001, [1.0, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 4):
        got = ann.nearest(v.repartition(parts), v.where("vec_id % 100 = 0 or vec_id > 4999").repartition(parts), top=1).collect()
        assert len(got) == 22
        by = {r.query_id: r for r in got}
        assert by[5001].vec_id == 5000 and abs(by[5001].score - 1 / math.sqrt(1.01)) < 1e-12


def test_parallel_residuals():
    """The anisotropic loss leaves less parallel residual than the plain one."""
    rng = np.random.default_rng(1)
    x = ann._pairs(ann._unit(rng.standard_normal((3000, 32))))
    err = {}
    for eta in (1.0, ann.parallel_weight(32, 0.5)):
        books = ann.fit(x, eta)
        code = ann.encode(x, books, eta)
        err[eta] = (((x - books[np.arange(x.shape[1]), code]) * x).sum((1, 2)) ** 2).mean()
    assert min(err, key=err.get) > 1


# op 9


def test_best_fit_rule():
    rng = random.Random(2)
    for open_bins in (1, 3, 50):
        bins, model, n = packing.BestFit(20, open_bins), {}, 0
        for _ in range(3000):
            length = rng.randint(1, 20)
            fits = [f for f in model.values() if f >= length]
            at, offset = bins.put(length)
            if fits:
                assert model[at] == min(fits) and offset == 20 - min(fits)
            else:
                assert at == n and offset == 0
                if len(model) == open_bins:
                    low = min(model.values())
                    still_open = {y for z in bins.by_free for y in z}
                    closed = next(k for k, f in model.items() if f == low and k not in still_open)
                    del model[closed]
                model[at] = 20
                n += 1
            model[at] -= length
            if not model[at]:
                del model[at]
    with pytest.raises(ValueError):
        packing.BestFit(5).put(6)


@pytest.mark.parametrize("most,open_bins", [(16, 3), (16, 64), (2048, 64)])
def test_packing(spark, docs, empty, tokenizer, most, open_bins):
    got = packing.pack_documents(docs, most, with_ids=True, open_bins=open_bins).collect()
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), most)):
            part = ids[s : s + most]
            want.append((r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert any(49407 in w[5] for w in want)
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in got) == bag(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for x in seqs.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= most
    # the same order, packed with a list of bins
    keys = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")).distinct()
    order = {(r[0], r[1]): r[2] for r in keys.select("doc_id", "text_crc32", F.xxhash64("doc_id", "text_crc32", F.lit(0x5EED))).collect()}
    free, closed = {}, 0
    stream = sorted(got, key=lambda r: (order[r.doc_id, r.text_crc32], r.doc_id is not None, r.doc_id or 0, r.piece))
    count = 0
    for r in stream:
        fits = [(f, b) for b, f in free.items() if f >= r.length]
        if fits:
            f, b = min(fits, key=lambda x: x[0])
        else:
            if len(free) == open_bins:
                del free[min(free, key=free.get)]
                closed += 1
            f, b = most, count
            count += 1
        free[b] = f - r.length
        if not free[b]:
            del free[b]
    assert len(seqs) == count and (open_bins > 3 or closed > 10)
    assert packing.pack_documents(empty).collect() == []


def test_packing_names(docs):
    x = packing.token_pieces(docs, 16).withColumns({"order": F.lit(1), "group": F.lit(2), "offset": F.lit(3), "a b": F.lit("c")})
    got = packing.pack(x, 3, 16)
    assert got.columns == [*x.columns, "sequence_id", "_offset"] and got.count() == x.count() and {(r.order, r.group, r.offset, r["a b"]) for r in got.collect()} == {(1, 2, 3, "c")}


def test_bound_binds(spark):
    """With the registered parameters bins are closed for the bound, and the sequences stay within 2 % of the least number."""
    lengths = [r.length for r in packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()]
    random.Random(1).shuffle(lengths)
    bins, closed = packing.BestFit(2048, packing.OPEN_BINS), 0
    for n in lengths:
        full, before = bins.open == bins.most, bins.next
        bins.put(n)
        closed += full and bins.next > before
    assert closed > 100 and bins.next <= 1.03 * sum(lengths) / 2048 + packing.OPEN_BINS


@pytest.mark.parametrize("most", [1_000_000, 6, 30])
def test_word_tokenizer_is_exact(tokenizer, most, monkeypatch):
    """Also where it forgets words all the time."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MOST_WORDS", most)

    tok = tokens.WordTokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))
    texts = ["éa.b Don't DON'T 'tis rock'n'roll it's's", "ÜnÏ×a÷b 12ab34 x—y <|endoftext|> a.b,c!?", "é. é ́a ﬁ İstanbul ΣΑΣ ς", " x y　z 日本語テキスト。 naïve", "a" * 5000, "".join(map(chr, range(32, 1200))), "<|endoftext|>", "don<|startoftext|>'t<|endoftext|><|endoftext|>", "é<|endoftext|>\u0301 a<|end", "oftext|>"]
    for _ in range(3):
        for t in texts:
            one, ends = tok.encode(*kernels.utf8(pa.array([t, t])))
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            assert one.tolist() == 2 * ids and tok.encode(*kernels.utf8(pa.array([t, t])), False)[1].tolist() == ends.tolist() == [0, len(ids), 2 * len(ids)]
    got, at = tok.encode(*kernels.utf8(pa.array([*texts, None, ""])))
    for k, t in enumerate(texts):
        assert got[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


# op 10


def brute_components(rows, words=5, percent=80):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group)]


def test_jaccard_odd(docs, empty):
    got = jaccard_join.jaccard_components(docs).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(brute_components([(r.doc_id, r.text) for r in docs.collect()]))
    assert jaccard_join.jaccard_components(empty).collect() == []


def cluster(seed=3):
    """Near copies of all degrees around the threshold, and texts that share a passage only."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    rows, passage = [], rng.choices(vocab, k=40)
    for c in range(4):
        base = rng.choices(vocab, k=rng.choice([8, 60, 150]))
        for _ in range(40):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(" ".join(x[: len(x) - rng.choice([0, 0, 0, 3, len(x) // 4])]))
    for _ in range(60):
        rows.append(" ".join([*rng.choices(vocab, k=30), *passage, *rng.choices(vocab, k=30)]))
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_jaccard_cluster(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rows = cluster()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == bag(brute_components(rows))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    group = {}
    for a, b in edges:
        for x in (a, b):
            group.setdefault(x, x)
    for _ in range(100):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.node: r.label for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in group.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("part"), F.lit(1).alias("pos"))
    got = shared.numbered(df, [F.col("part")], "place", 5).collect()
    assert [r.part for r in sorted(got, key=lambda r: r.place)] == sorted(r.part for r in got)
    assert sorted(r.place for r in got) == list(range(1000))


def test_very_long_text(spark, tokenizer):
    """One text of 9 MB among short ones, through every operator of texts: whole, and like the pure functions."""
    rng = random.Random(12)
    base = prose(rng, 40_000)
    long = " ".join([base] * 45 + ["the end"])
    assert len(long.encode()) > 9_000_000
    rows = [(1, long, "en", "src0"), (2, base, "en", "src0"), (3, "short", "fr", "src1"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    n_words = len(split(long))
    scores = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    assert scores[1].n_words == n_words
    sizes = {r.doc_id: r.size for r in shard.feistel_shard(docs, 3).collect()}
    assert sizes[1] == len(long.encode()) + 8
    model = langid.train(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model, ["doc_id"]).collect()}[1] == "en"
    prints = {r.doc_id: r for r in winnow.compare_edited(docs, 8, 16).collect()}
    assert prints[1].n_chars == len(long) and prints[1].fingerprint == winnow.encode(*winnow.winnow(winnow.code_points(long), 8, 16))
    pieces = defaultdict(int)
    for r in packing.pack_documents(docs).collect():
        pieces[r.doc_id] += r.length
    n_ids = len(tokenizer.encode(long, add_special_tokens=False).ids)
    assert pieces[1] == n_ids + 1 and pieces[4] == 1
    assert {r.doc_id: r.n for r in tokens.with_token_counts(docs, "n").collect()}[1] == n_ids
    found = {r.doc_id: r for r in jaccard_join.jaccard_components(docs).collect()}
    w = split(long)
    assert found[1].n_shingles == len(set(zip(*(w[k:] for k in range(5))))) and found[1].component_id == 1 and found[4].n_shingles == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("min_count", [1, 2])
def test_lm_orders(docs, empty, order, min_count):
    """N-gram tables of any order; with two words they agree with the packed bigrams."""
    rows = [(r.doc_id, split(r.text)) for r in docs.collect()]
    counts = Counter(tuple(w[i : i + k]) for _, w in rows for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def score(g):
        if len(g) == 1:
            return math.log(counts[g] / total)
        return math.log(counts[g] / counts[g[:-1]]) if counts[g] >= min_count else math.log(0.4) + score(g[1:])

    want = [(i, len(w), round(sum(score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))), 6)) for i, w in rows]
    got = lm_score.score_documents(docs, min_count=min_count, order=order, tables=True).collect()
    assert bag((r.doc_id, r.n_words, round(r.log_score, 6) + 0.0) for r in got) == bag((i, n, s + 0.0) for i, n, s in want)
    if order == 2:
        packed = lm_score.score_documents(docs, min_count=min_count).collect()
        assert bag((r.doc_id, r.n_words, round(r.log_score, 5) + 0.0) for r in got) == bag((r.doc_id, r.n_words, round(r.log_score, 5) + 0.0) for r in packed)
    assert lm_score.score_documents(empty, order=order, tables=True).collect() == []
