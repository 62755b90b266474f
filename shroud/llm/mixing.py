"""Mixing sources to target weights (9): a multivariate-hypergeometric splitting tree.

DataFrame operations only.

1. Size of a document: its number of words.  Sources in code-point order (null
   last) get the weights in turn; together they share ``share`` times all words.
   A target stops at ``max_repeat`` times its source's size, the excess goes to
   the others by weight: one level ``lam`` with target = min(cap, lam * weight).
2. Each source's documents fall into blocks by a hash of their id, about
   ``block_words`` words each.  A source gets whole epochs while they fit; the
   rest is drawn from its permuted blocks, the last of them document by document.
3. The exact block quotas are split over the shards by a binary tree: each node
   sends a random sample of its blocks, of the size its left side needs, to the
   left.  The source counts of a side are then a multivariate-hypergeometric draw,
   and no block is given away twice.
4. Inside a shard rows are ordered by a hash.

All randomness is a hash of ids and ``seed``, so reruns agree.  Null text has
size 0; null sources are one source; null ids are hashed as null.  Repeated rows
share a block, and identical rows may stand for each other at a cut.  An empty
table gives no rows.  Documents of size 0 come with the block that holds them
but count no words.  Input columns named ``mix_shard``, ``mix_epoch`` or
``mix_order`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import WORD_RE, Scratch, project, read_table


def n_words(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD_RE)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 2.0) -> DataFrame:
    """(source, sid, source_size, target) from rows (source, size); windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("sid", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.select("source", "sid", "source_size", w.alias("w"), (F.col("source_size") * F.lit(max_repeat)).alias("cap"))
    fill = W.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = W.partitionBy(F.lit(0))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    lam = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("lam", lam).withColumn("at", F.row_number().over(fill))
    fits = F.when(F.col("cap") / F.col("w") >= F.col("lam"), F.struct("at", "lam"))
    # where nothing fits (share above max_repeat) every source stands at its cap
    level = F.min(fits).over(everything)["lam"]
    target = F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))
    return per.select("source", "sid", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _block_of(rows: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """rows (source, doc_id, size, ...) with their source's figures, block and key."""
    s = sources.withColumnRenamed("source", "s_source")
    rows = rows.join(s, rows["source"].eqNullSafe(s["s_source"])).drop("s_source")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    return rows.withColumn("block", F.pmod("key", blocks).cast("long"))


def block_quotas(placed: DataFrame, seed: int) -> DataFrame:
    """Per (sid, block): full epochs, words still wanted of it, and the draws it takes part in."""
    per = placed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    order = W.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("full", full)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    per = per.withColumn("want", F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), rest - before)))
    cut = (F.col("want") > 0) & (F.col("want") < F.col("words"))
    draws = F.col("full") + (F.col("want") > 0).cast("int")
    return per.select("sid", "block", "words", "full", "want", cut.alias("cut"), draws.alias("draws"))


def _in_cut(rows: DataFrame) -> DataFrame:
    """Which documents of the one cut block of each source the partial epoch takes.

    In key order up to the middle of the document at the limit; then the one
    document whose change brings the sum nearest to the limit is switched.
    """
    by_key = W.partitionBy("sid", "block").orderBy("key", "doc_id", "size")
    whole = W.partitionBy("sid", "block")
    run = F.coalesce(F.sum("size").over(by_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("taken0", run + F.col("size") / 2 <= F.col("want"))
    rows = rows.withColumn("gap", F.col("want") - F.sum(F.when(F.col("taken0"), F.col("size")).otherwise(0)).over(whole))
    change = F.when(F.col("taken0"), -F.col("size")).otherwise(F.col("size"))
    rows = rows.withColumn("left", F.abs(F.col("gap") - change))
    nearest = F.row_number().over(whole.orderBy("left", "key", "doc_id", "size"))
    switch = (nearest == 1) & (F.col("left") < F.abs("gap"))
    return rows.withColumn("switch", switch).withColumn("partial", F.col("taken0") != F.col("switch")).drop("taken0", "gap", "left", "switch")


def split_tree(draws: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(sid, block, epoch, shard): the quotas of every node are split exactly, level by level.

    The rank inside a node is taken over 1,024 hash ranges, so that no node, the
    root included, is sorted in one task.
    """
    level, rows = 0, draws.select("sid", "block", "epoch", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    width = shards
    while width > 1:
        h = F.xxhash64(F.lit(seed), F.lit(level), "sid", "block", "epoch")
        rows = rows.withColumn("h", h).withColumn("cell", F.shiftrightunsigned("h", 54))
        cells = rows.groupBy("lo", "hi", "cell").agg(F.count("*").alias("n"))
        node = W.partitionBy("lo", "hi")
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(node.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        cells = cells.withColumn("total", F.sum("n").over(node)).drop("n")
        rows = rows.join(cells, ["lo", "hi", "cell"])
        rank = F.col("before") + F.row_number().over(W.partitionBy("lo", "hi", "cell").orderBy("h", "sid", "block", "epoch"))
        mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        quota = F.floor(F.col("total") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        leaf = F.col("hi") - F.col("lo") <= 1
        rows = rows.withColumn("mid", mid).withColumn("left", rank <= quota)
        rows = rows.select(
            "sid", "block", "epoch",
            F.when(leaf | F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"),
            F.when(leaf | ~F.col("left"), F.col("hi")).otherwise(F.col("mid")).alias("hi"),
        )
        rows = scratch.write(rows, f"level-{level}")
        level, width = level + 1, (width + 1) // 2
    return rows.select("sid", "block", "epoch", F.col("lo").alias("shard"))


def plan_mix(slim: DataFrame, rows: DataFrame, scratch: Scratch, share: float, weights: tuple[float, ...], max_repeat: float, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """``rows`` (source, doc_id, size, and any payload) with target, copies and the shard of each copy.

    ``slim`` holds the same rows without payload; all counts come from it.
    """
    sources = scratch.write(source_targets(slim, share, weights, max_repeat), "sources")
    quotas = scratch.write(block_quotas(_block_of(slim, sources, block_words, seed), seed), "quotas")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(total / shard_words))
    draws = quotas.select("sid", "block", F.explode(F.expr("sequence(0, draws)")).alias("epoch"), "draws").where("epoch < draws").drop("draws")
    tree = split_tree(draws, shards, seed, scratch)
    homes = tree.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("homes"))  # one entry an epoch
    blocks = quotas.join(homes, ["sid", "block"], "left").select("sid", "block", "full", "want", "cut", "homes")
    blocks = scratch.write(blocks, "blocks")
    placed = _block_of(rows, sources, block_words, seed).join(blocks, ["sid", "block"])
    whole = placed.where(~F.col("cut")).withColumn("partial", F.col("want") > 0)
    out = whole.unionByName(_in_cut(placed.where("cut")))
    copies = F.col("full") + F.col("partial").cast("int")
    out = out.withColumn("copies", copies)
    return out.withColumn("homes", F.expr("slice(coalesce(homes, array()), 1, copies)"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 2.0, block_words: int = 1 << 20, shard_words: int = 1 << 25, seed: int = 42) -> DataFrame:
    """The mixed documents: all columns, once a copy, with ``mix_shard``, ``mix_epoch`` and ``mix_order``."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.drop("mix_shard", "mix_epoch", "mix_order")
    base = project(docs, doc_id="doc_id", source="source", size=n_words("text"))
    slim = scratch.write(base, "sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), n_words(F.col("doc.text")).alias("size"))
    plan = plan_mix(slim, rows, scratch, share, weights, max_repeat, block_words, shard_words, seed)
    order = F.xxhash64(F.lit(seed), "doc_id", "home.epoch")
    out = plan.select("doc", "doc_id", F.explode("homes").alias("home"))
    out = out.select("doc.*", F.col("home.shard").alias("mix_shard"), F.col("home.epoch").alias("mix_epoch"), order.alias("mix_order"))
    return out.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")


def op9_mix(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "mix")
    slim = scratch.write(project(docs, doc_id="doc_id", source="source", size=n_words("text")), "sizes")
    plan = plan_mix(slim, slim, scratch, 1.5, (5.0, 2.0, 1.0), 2.0, 1 << 20, 1 << 25, 42)
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, F.col("homes.shard").alias("shards"))
