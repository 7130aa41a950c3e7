"""The folder that driver and executors share, frames saved in it, and gapless numbering by ranges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and all is on one machine (tests) a new temporary folder is set; on a cluster
    that is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def saved(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_of(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the frame's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds the row's place (from 0) in the given order. The frame should be narrow: it is range-partitioned, sorted and
    written once. No task sees more than its range; rows equal in all of `order` get neighbouring places in any order."""
    spark = df.sparkSession
    uid, part, pos, base, n = clear_of(df, "uid", "part", "pos", "base", "n")
    tagged = df.withColumn(uid, F.monotonically_increasing_id())  # splits equal rows among ranges
    keys = [*order, F.col(uid)]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = tagged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(uid)
    at = F.monotonically_increasing_id()
    ranged = saved(ranged.withColumn(part, F.shiftright(at, 33)).withColumn(pos, at.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))  # a row for each partition
    before = counts.withColumn(base, F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(part, F.coalesce(base, F.lit(0)).alias(base))
    return ranged.join(F.broadcast(before), part).withColumn(name, (F.col(base) + F.col(pos)).cast("long")).drop(part, pos, base)
