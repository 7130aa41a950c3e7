"""Mixing sources to target weights down a tree domain > language > source.

The budget goes from the root to the leaves in proportion to weights. A child that has less than its share gives what
it lacks to its siblings (again by weight); only what a whole family lacks goes back to its ancestors' other children.
A child's stock is its leaves' tokens times the number of epochs that may be read. Each leaf then reads whole epochs and a
prefix of one more; every epoch has its own seeded order. All sums are of integers, so results don't depend on
partitioning; the two tables that decide are one row per node and one row per (leaf, bucket of the order).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import clear_of, saved

#: Hex digits of the order's key that make a bucket; of each leaf one bucket only is ever sorted row by row.
BUCKET_DIGITS = 3
#: Leaf tables of so many rows at most are broadcast (about 100 bytes a row); larger ones are joined by shuffling.
MOST_LEAVES = 10_000


def _shares(children: DataFrame, family: list[str]) -> DataFrame:
    """Water-filling: children (family, weight, stock, goal of the family) get `share`, with sums of min(goal, stocks).

    By stock/weight ascending, a child is filled up if its stock is at most its part of what is left then; the first that
    is not, and all after it, share the rest by weight, rounded down, what rounding leaves going to the first of them.
    """
    ratio = F.col("stock") / F.col("weight")
    w = Window.partitionBy(*family).orderBy(ratio, "node").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    x = children.where("weight > 0 and stock > 0")
    x = x.withColumn("stock_before", F.coalesce(F.sum("stock").over(w), F.lit(0)))
    x = x.withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(w), F.lit(0)))
    big = "decimal(38,0)"
    x = x.withColumn("full", F.col("stock").cast(big) * F.col("weight_left") <= (F.col("goal") - F.col("stock_before")).cast(big) * F.col("weight"))
    # the first that isn't filled decides for all after it
    upto = Window.partitionBy(*family).orderBy(ratio, "node").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("full", F.min(F.col("full").cast("int")).over(upto))
    x = x.withColumn("rest", F.max(F.when(F.col("full") == 0, F.col("goal") - F.col("stock_before"))).over(whole))
    x = x.withColumn("open", F.sum(F.when(F.col("full") == 0, F.col("weight")).otherwise(0)).over(whole))
    part = F.expr("cast((cast(rest as decimal(38,0)) * cast(weight as decimal(10,0))) div open as long)")
    x = x.withColumn("share", F.when(F.col("full") == 1, F.col("stock")).otherwise(F.greatest(F.lit(0), part)))
    given = F.sum(F.when(F.col("full") == 0, F.col("share")).otherwise(0)).over(whole)
    first = (F.col("full") == 0) & (F.coalesce(F.lag("full").over(Window.partitionBy(*family).orderBy(ratio, "node")), F.lit(1)) == 1)
    return x.withColumn("share", F.when(first, F.least("stock", F.col("share") + F.col("rest") - given)).otherwise(F.col("share")))


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]], default_weight: int = 1, epochs: int = 4, small: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> the same with `share`, tokens to read of each leaf.

    `weights` gives integer weights by level (`domain`, `lang`, `source`) and name; other names (and null, as `(none)`)
    have `default_weight`; weight 0 leaves a node out. Shares never exceed tokens x epochs. `small` is applied to the tables
    of domains and of languages by domain before they are joined to the leaves (F.broadcast, where their size is checked).
    """
    def weight(level):
        pairs = [F.lit(y) for kv in weights.get(level, {}).items() for y in kv]
        w = F.create_map(*pairs)[F.col(level)] if pairs else F.lit(None)
        return F.coalesce(w.cast("long"), F.lit(default_weight).cast("long"))

    x = leaves.withColumns({"w_domain": weight("domain"), "w_lang": weight("lang"), "w_source": weight("source")})
    x = x.where("w_domain > 0 and w_lang > 0 and w_source > 0 and tokens > 0").withColumn("stock", F.col("tokens") * epochs)
    top = x.groupBy("domain").agg(F.max("w_domain").alias("weight"), F.sum("stock").alias("stock"))
    total = F.sum("stock").over(Window.partitionBy("root"))
    top = top.withColumn("root", F.lit(0)).withColumn("goal", F.least(F.lit(budget).cast("long"), total))
    a = _shares(top.withColumn("node", F.col("domain")), ["root"]).select("domain", F.col("share").alias("goal"))
    mid = x.groupBy("domain", "lang").agg(F.max("w_lang").alias("weight"), F.sum("stock").alias("stock")).join(small(a), "domain")
    b = _shares(mid.withColumn("node", F.col("lang")), ["domain"]).select("domain", "lang", F.col("share").alias("goal"))
    low = x.select("domain", "lang", "source", "tokens", F.col("w_source").alias("weight"), "stock").join(small(b), ["domain", "lang"])
    return _shares(low.withColumn("node", F.col("source")), ["domain", "lang"]).select("domain", "lang", "source", "tokens", "share")


def mix(docs: DataFrame, budget: int | float, domain: Column, tokens: Column, weights: dict[str, dict[str, int]] | None = None, default_weight: int = 1, epochs: int = 4, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """`docs` with `copies`, how often each row is read (0 included), and `share`, its leaf's tokens to read.

    `budget` is in tokens, or as a float up to 1 that part of all tokens. In each epoch a leaf's documents come in the order
    of md5(seed|epoch|id), and are read while the tokens before them fall short of what the leaf still has to read: a leaf
    reads its share, and less than one document (or group of equal ids) more. A null source, language or domain is
    `(none)`; null ids order as the empty string, null token counts are 0, documents without tokens are never read, rows
    with equal ids in a leaf are read alike. No row of `docs` is moved: only (leaf, bucket) sums and the rows of one
    bucket of each leaf are. If `docs` has columns `copies` or `share`, the new ones are named with _ before.
    """
    def name(c):
        return F.coalesce(c.cast("string"), F.lit("(none)"))

    copies, share, d, l, s, tok, whole, rest, cut = clear_of(docs, "copies", "share", "domain_", "lang_", "source_", "tok_", "whole_", "rest_", "cut_")
    x = docs.withColumns({d: name(domain), l: name(F.col("lang")), s: name(F.col("source")), tok: F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))})
    leaf = ["domain", "lang", "source"]
    y = x.select(F.col(d).alias("domain"), F.col(l).alias("lang"), F.col(s).alias("source"), F.col(id_col).alias("id"), F.col(tok).alias("tok")).where("tok > 0")
    stock = saved(y.groupBy(*leaf).agg(F.sum("tok").alias("tokens")))
    if isinstance(budget, float):
        budget = int((stock.agg(F.sum("tokens")).first()[0] or 0) * budget)
    small = F.broadcast if stock.count() <= MOST_LEAVES else lambda t: t  # no table by node has more rows
    shares = budgets(stock, budget, weights or {}, default_weight, epochs, small)
    shares = saved(shares.withColumn("whole", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")))

    def key(epoch, row_id):
        return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"))

    y = y.join(small(shares.where("rest > 0").select(*leaf, "whole", "rest")), leaf).withColumn("key", key(F.col("whole"), F.col("id")))
    y = y.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # the bucket in which a leaf's share ends: first by one digit, then by the others within it
    sums = saved(y.groupBy(*leaf, "rest", "bucket").agg(F.sum("tok").alias("t")))  # 16**BUCKET_DIGITS rows a leaf at most
    digit = F.substring("bucket", 1, 1)

    def ends(t: DataFrame, by: str, start) -> DataFrame:
        before = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start
        return t.withColumn("before", before).where("before < rest and before + t >= rest").select(*leaf, by, "before")

    coarse = saved(ends(sums.groupBy(*leaf, "rest", digit.alias("digit")).agg(F.sum("t").alias("t")), "digit", F.lit(0)))
    fine = sums.withColumn("digit", digit).join(small(coarse.withColumnRenamed("before", "start")), [*leaf, "digit"])
    edge = saved(ends(fine, "bucket", F.col("start")))
    inside = y.join(small(edge), [*leaf, "bucket"])
    tied = inside.groupBy(*leaf, "rest", "before", "key").agg(F.sum("tok").alias("t"))
    run = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = tied.withColumn("run", run + F.col("before")).where("run < rest").groupBy(*leaf).agg(F.max("key").alias("cut"))
    table = saved(shares.join(last, leaf, "left").select(F.col("domain").alias(d), F.col("lang").alias(l), F.col("source").alias(s), F.col("share").alias(share), F.col("whole").alias(whole), F.col("cut").alias(cut)))
    out = x.join(small(table), [d, l, s], "left")
    n = F.coalesce(whole, F.lit(0)) + F.when(key(F.col(whole), F.col(id_col)) <= F.col(cut), 1).otherwise(0)
    return out.withColumn(copies, F.when(F.col(tok) > 0, n).otherwise(0).cast("int")).withColumn(share, F.coalesce(share, F.lit(0).cast("long"))).select(*docs.columns, copies, share)
