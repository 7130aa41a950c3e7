"""Delta-maintained token totals by source, language and tokenizer version.

A batch of signed changes is summed by key and written as one Parquet table named after the batch; a finished table
(Spark's _SUCCESS marker) is the commit. Committing the same batch again does nothing, and a batch that was cut off is
written anew, so retries can't count twice. Totals are the sum over all committed tables; compact() folds them into one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"


def word_count(text="text"):
    """Tokens of version `words-1`: runs of bytes other than 0x20 and 0x09-0x0D; null for a null text."""
    return F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quarter_count(text="text"):
    """Tokens of version `bytes4-1`: UTF-8 bytes divided by 4, rounded up."""
    return F.expr(f"(octet_length({text}) + 3) div 4")


class TokenRollup:
    """Totals kept under `path` (a folder that driver and executors share).

    Changes are rows (source, lang, tokenizer, op, tokens, bytes, old_tokens, old_bytes) with op `insert` (+1 document,
    +tokens), `delete` (-1, -tokens) or `revise` (0, tokens - old_tokens). Null keys form groups of their own, null
    counts are 0, another op is an error. Repeated rows count as often as they occur: a change has no identity but its
    batch's. Further columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        """Names of the committed batches and compactions that count, in order."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1]))
        bases = [x for x in names if x.startswith("base-")]
        if not bases:
            return names
        folded = {r[0] for r in self.spark.read.text(f"{self.path}/{bases[-1]}/_folded").collect()}  # names of batches only
        return [bases[-1], *(x for x in names if x not in folded and not x.startswith("base-"))]

    def committed(self, batch: str) -> bool:
        if batch in (have := self.batches()):
            return True
        return bool(have and have[0].startswith("base-") and batch in {r[0] for r in self.spark.read.text(f"{self.path}/{have[0]}/_folded").collect()})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already."""
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", batch) or batch.startswith("base-"):
            raise ValueError(f"a batch is named by a-z, 0-9 and -: {batch!r}")
        if self.committed(batch):
            return False
        zero = F.lit(0).cast("long")
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))

        def amount(c):
            new, old = F.coalesce(F.col(c).cast("long"), zero), F.coalesce(F.col(f"old_{c}").cast("long"), zero)
            return F.when(F.col("op") == "revise", new - old).otherwise(sign * new)

        delta = changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(amount("tokens")).cast("long").alias("tokens"), F.sum(amount("bytes")).cast("long").alias("bytes"))
        delta.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Totals by key; keys without documents and tokens are left out."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        read = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{x}" for x in names))
        out = read.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "bytes")))
        return out.where("docs <> 0 or tokens <> 0 or bytes <> 0")

    def compact(self) -> None:
        """Folds all committed batches into one table; a batch folded this way still counts as committed."""
        names = self.batches()
        if len(names) < 2:
            return
        done = {x for x in names if not x.startswith("base-")}
        if names[0].startswith("base-"):
            done |= {r[0] for r in self.spark.read.text(f"{self.path}/{names[0]}/_folded").collect()}
        last = int(names[0][5:]) if names[0].startswith("base-") else 0
        at = f"{self.path}/base-{last + 1:09d}"
        self.totals().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(at)
        self.spark.createDataFrame([(x,) for x in sorted(done)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/_folded")
        fs, p = self._fs(f"{at}/_SUCCESS")  # last: without it the folder doesn't count
        fs.create(p, True).close()


def change_log(docs: DataFrame, op, versions: dict, old_versions: dict | None = None, text: str = "text", old_text: str | None = None) -> DataFrame:
    """A change for every document and tokenizer version. `versions` names each version's count column; where op is `revise`,
    `old_versions` and `old_text` name the counts and the text that were inserted before."""
    none = F.lit(None).cast("long")
    rows = [F.struct(F.lit(v).alias("tokenizer"), c.alias("tokens"), (old_versions or {}).get(v, none).alias("old_tokens")) for v, c in versions.items()]
    size, old = F.octet_length(text).cast("long"), F.octet_length(old_text).cast("long") if old_text else none
    return docs.select("source", "lang", (F.lit(op) if isinstance(op, str) else op).alias("op"), size.alias("bytes"), old.alias("old_bytes"), F.explode(F.array(*rows)).alias("v")).select("source", "lang", "op", "bytes", "old_bytes", "v.*")
