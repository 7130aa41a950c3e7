"""A corpus pipeline of the llm operators: run(spark, sf_dir) applies STAGES to the documents in turn.

Every stage takes the columns of documents by name and ignores others, whatever they are called; all but the last return
them. An empty table gives an empty one. Rows are told apart by their places, not their ids: ids may be null or repeated, rows
may be repeated whole, and any column may be null. A text may be as long as a row can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import jaccard_join, langid, packing, tokens
from wavemill.llm.queries import mixed
from wavemill.llm.shared import dropped, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognisable language; the model learns from the labelled ones that aren't held out. Null texts and
    those without a letter go, and all if no language was learned; repeated rows stay or go together."""
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 0))
    out = langid.identify(docs, model, list(COLUMNS))
    return out.where(F.col("lang_pred") != langid.NO_LANGUAGE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the one with the smallest id, null ids last, and the first of equal ones. Rows without
    words are all kept. Rows are told apart by a number of their own, which is written with them, not by their ids."""
    docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()).write.parquet(at := shared_path(spark, "rows"))
    rows = spark.read.parquet(at)
    found = jaccard_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    found = found.join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = found.where("n_shingles > 0").groupBy("component_id").agg(first).select("first.row").union(found.where("n_shingles = 0").select("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to meet the target weights, counted in tokens. Copies are rows like any repeated ones;
    documents without tokens are left out, repeated ids are read alike."""
    tokens.with_token_counts(docs.select(*COLUMNS), "tokens").write.parquet(at := shared_path(spark, "counted"))
    out = mixed(spark.read.parquet(at)).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens. Copies that the mixture made are documents of their own: equal
    pieces in places of their own, which nothing else tells apart."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pack", pack)]
#: Mixture models, tokenizers and best-fit have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of stages are dropped once the next stage is written, but for the one that it reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(at := shared_path(spark, f"stage-{k}"))
        docs = spark.read.schema(out.schema).parquet(at)
        if before:
            dropped(spark, before)
        before = at
    return docs
