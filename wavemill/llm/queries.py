"""The subpackage's registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, jaccard_join, langid, lm_score, mixing, packing, shard, token_rollup, tokens, winnow
from .shared import saved, shared_path
from .sql import ORACLE_SQL

#: Weights of the mixture: by the last character of the source's name (its domain), and by language; other names weigh 1.
MIX_WEIGHTS = {"domain": {"0": 6, "1": 2, "2": 2, "3": 3, "7": 4}, "lang": {"en": 5, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 3, "src7": 2}}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.5, 4, 17
SHARDS, SHARD_SEED = 24, 20240229
#: Dense enough that a kept half of a text of 46 code points has a fingerprint.
WINNOW_K, WINNOW_WINDOW = 8, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark, sf_dir):
    """Every document's stupid-backoff score under the corpus' bigrams."""
    out = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 6).alias("per_word"))


def mixed(counted: DataFrame) -> DataFrame:
    """The mixture of rows (doc_id, lang, source, tokens, ...)."""
    return mixing.mix(counted, MIX_BUDGET, F.expr("right(source, 1)"), F.col("tokens"), MIX_WEIGHTS, 1, MIX_EPOCHS, MIX_SEED)


def op2_mix(spark, sf_dir):
    """How often each document is read, for half of the corpus' tokens in all; tokens are those of word_bpe_49k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = saved(tokens.with_token_counts(docs, "tokens").drop("text"))
    return mixed(counted).select("doc_id", "lang", "source", "tokens", "copies", "share")


def op3_feistel_shard(spark, sf_dir):
    """All documents in 24 shards; the law is `rows`."""
    out = shard.feistel_shard(table(spark, sf_dir, "documents"), SHARDS, SHARD_SEED)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op4_language(spark, sf_dir):
    """Each document's language and mixture, by a model of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold(F.col("doc_id")) == 0
    model = langid.train(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op5_token_rollup(spark, sf_dir):
    """Totals by source, language and tokenizer version after three batches: all documents, then new texts (without digits)
    and so new counts of some, and the deletion of others, the last two sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "token-rollup"))

    def counts(text="text", bpe="bpe"):
        return {"words-1": token_rollup.word_count(text), "word-bpe-49k": F.col(bpe)}

    def counted(rows):
        return tokens.with_token_counts(rows, "bpe")

    cleaned = tokens.with_token_counts(counted(docs.where("doc_id % 7 = 3").withColumn("new", F.translate("text", "0123456789", ""))), "new_bpe", text_col="new")
    batches = {
        "b1-load": token_rollup.change_log(counted(docs), "insert", counts()),
        "b2-clean": token_rollup.change_log(cleaned, "revise", counts("new", "new_bpe"), counts(), "new", "text"),
        "b3-remove": token_rollup.change_log(counted(docs.where("doc_id % 11 = 5 and doc_id % 7 <> 3")), "delete", counts()),
    }
    for name in ("b1-load", "b2-clean", "b2-clean", "b3-remove", "b1-load", "b3-remove"):
        rollup.commit(name, batches[name])
        if name == "b2-clean":
            rollup.compact()
    return rollup.totals()


def op6_chat(spark, sf_dir):
    """Digests of all conversations and conversation -7, read back from their formatted texts part by part."""
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back_turns(chat.format_turns(turns), in_order=True)


def op7_winnow(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return winnow.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"), WINNOW_K, WINNOW_WINDOW)


def op8_anisotropic_ann(spark, sf_dir):
    """The 5 nearest of every 50th vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(v, v.where("vec_id % 50 = 0"), 5)


def op9_best_fit_pack(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    out = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_jaccard_join(spark, sf_dir):
    """Every document's near-duplicate component: five words, similarity 0.8 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_mix, op3_feistel_shard, op4_language, op5_token_rollup, op6_chat, op7_winnow, op8_anisotropic_ann, op9_best_fit_pack, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
