"""What several operators need from Spark besides the shared folder: small Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import clear_of, dropped, numbered, saved, shared_dir, shared_path

__all__ = ["batches_of", "clear_of", "components", "dropped", "numbered", "saved", "shared_dir", "shared_path"]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches have so many rows at most: for frames of wide rows that are run (saved) within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it is connected with.

    Alternates large-star and small-star steps: every round links each node to the smallest of its neighbours, until
    nothing changes. Each step groups by node with partial aggregation; the frames are written between rounds.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = saved(e)
    last = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # saved, so that the rows of a node with very many neighbours can be split among tasks where they are joined
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: each node's smaller neighbours are linked to the smallest of them
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
        e = saved(small.select("x.a", "x.b").where("a < b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges.sparkSession.sparkContext._jvm.System.gc()  # past rounds' shuffle files go when the driver collects its garbage
        if state == last:
            break
        last = state
    return e.select(F.col("b").alias("node"), F.col("a").alias("label")).union(e.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
