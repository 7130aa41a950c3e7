"""The pipeline's stages, each against what it was given."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import jaccard_join, langid, packing, queries, tokens
from wavemill.llm.queries import mixed

from .test_operators import bag, brute_components, brute_mix, brute_shares_of, odd_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.count(), out.count()
        if name != "pack":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "language":
            assert after >= 0.97 * before
        elif name == "near_duplicates":
            found = jaccard_join.jaccard_components(docs)
            kept = {r.doc_id for r in out.collect()}
            assert kept == {r.doc_id for r in found.collect() if r.n_shingles == 0 or r.component_id == r.doc_id} and len(kept) == after < before
        elif name == "mixture":
            want = {r.doc_id: r.copies for r in mixed(tokens.with_token_counts(docs, "tokens")).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
        else:
            pieces = packing.token_pieces(docs).agg(F.sum("length"), F.count("*")).first()
            seqs = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
            assert after == pieces[1] and seqs.agg(F.sum("n")).first()[0] == pieces[0]
            assert seqs.where("n > 2048 or n <> end").count() == 0
        docs = out


def test_several_languages(spark):
    """A document of three languages in even shares is kept, and so is a text of two letters."""
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(model[0]) >= 3
    parts = [spark.read.parquet(f"{SF}/documents.parquet").where((F.col("lang") == name) & (F.length("text") > 300)).orderBy("doc_id").first().text[:300] for name in model[0][:3]]
    rows = [(1, " ".join(parts), "en", "src0", 1), (2, "ab", "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert found[1].score < 0.4 and len(found[1].languages) >= 3 and found[2].score < 0.4
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(docs.columns).where("doc_id > 2")), SF).collect()} >= {1, 2}


def test_near_duplicates_of_odd_ids(spark):
    """One row of each component stays, whatever its id: repeated and null ids, and rows that are repeated whole."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    texts = [(1, a), (1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (7, d), (None, d), (3, ""), (3, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (7, d), (3, ""), (3, None), (None, " ")], key=repr)


def test_rejects(spark):
    rows = [(1, "the of and with that this", "en", "src0", 1), (2, "12 34 !!", "en", "src0", 1), (3, None, "en", "src0", 1), (4, "le la les des pour que", "fr", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 4}
    assert langid.NO_LANGUAGE == "und"


def brute_pipeline(rows, model, tokenizer):
    """What each stage keeps of rows (doc_id, text, lang, source, n_chars), and the pieces of the last, with plain loops."""
    langs, table = model

    def recognised(text):
        data = (text or "").encode()
        if not any(map(str.isalpha, text or "")):
            return False
        return len(data) < 3 or max(brute_shares_of(data, table).values()) > 0

    kept = [[r for r in rows if langs and recognised(r[1])]]
    groups: dict = {}
    found = brute_components([(k, r[1]) for k, r in enumerate(kept[0])])
    for (k, n, component), r in zip(found, kept[0]):
        groups.setdefault((component, k if not n else -1), []).append((r[0] is None, r[0] or 0, k))
    kept.append([kept[0][min(g)[2]] for g in groups.values()])
    n = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in kept[1]]
    copies = brute_mix([(r[0], r[3], r[2], t) for r, t in zip(kept[1], n)], queries.MIX_BUDGET, queries.MIX_WEIGHTS, queries.MIX_EPOCHS, queries.MIX_SEED) if kept[1] else []
    kept.append([r for r, c in zip(kept[1], copies) for _ in range(c)])
    pieces = []
    for r in kept[2]:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        pieces += [(r[0], p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    return [*kept, pieces]


def test_brute_force(spark, tokenizer, tmp_path):
    """All stages, each on what the one before kept, on an odd table: nulls in any column, repeated ids and rows, empty and long
    texts, near copies, further columns with names that the stages use themselves."""
    rows = [(*r[:4], None) for r in odd_rows(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "tokens", "copies", "share", "copy", "component_id", "score", "lang_pred", "order", "offset", "first", "none"):
        docs = docs.withColumn(c, F.lit(7))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 0))
    assert model[0] == ["en", "fr"]
    *kept, pieces = brute_pipeline([tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()], model, tokenizer)
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        # of rows that are equal but for lang or source any may stay
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == len(want)
        if name != "mixture":
            assert bag((r.doc_id, r.text) for r in docs.collect()) == bag(r[:2] for r in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == bag(pieces)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).collect() == []
