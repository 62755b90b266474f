"""Embedding near-dedup by NN-descent (3).

1. Equal vectors are one class; null, zero, non-finite or partly null vectors,
   and rows without an id, link with nothing.  Vectors of different length are
   never compared.
2. Seed graph: for each of ``tables`` random hyperplane orders the classes are
   sorted by signature and cut into blocks of ``leaf`` rows; every class takes its
   nearest of the block as first neighbours.
3. NN-descent: every node introduces its neighbours and the nodes that name it to
   each other (neighbours of neighbours, only pairs with a new member); each keeps
   its ``k`` nearest.  Nodes named by very many are split into bounded groups,
   each with the node's own neighbours.  Rounds end when no new link appears.
4. Edges at or above the threshold give components.  Lists that are saturated
   (all k at or above the threshold) are enlarged: first to their whole component,
   compared in blocks that emit only counts per vector, never pairs; then the
   search is repeated for neighbours outside the component, until no link joins
   two components any more.
5. Audit: vectors drawn by a hash (``audit``, or 16 * sqrt(n) where that is more)
   against all vectors in blocks give each one's share of its links that was found.
   The shares are averaged a vector, so a large group counts by its vectors, not by
   its links, and apart for vectors of at most ``k`` links and of more, so neither
   hides the other.  While the lower average is below ``recall`` the search goes on
   with new hyperplanes.  That average is a column of the result.

Cosines are computed in double precision.  Work grows with n * k * rounds, that of
the audit with n * sqrt(n).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table
from shroud.llm.components import connected_components

EDGE = "src long, dst long, sim double"
_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, ok): vec is the embedding as doubles, null where it links with nothing."""
    rows = project(vectors, vec_id="vec_id", vec="embedding").withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("vec", F.col("vec").cast("array<double>"))
    big = float("inf")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(big))) & F.exists("vec", lambda x: x != 0)
    ok = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    return rows.select("vec_id", F.when(ok, F.col("vec")).alias("vec"))


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors; scaled by the largest part first, so that squares stay finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _edges(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(src, dtype=np.int64)), pa.array(np.asarray(dst, dtype=np.int64)), pa.array(np.asarray(sim, dtype=np.float64))], schema=_EDGE)


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` (at most ``most`` together) of a sorted partition."""
    held: pa.Table | None = None

    def cuts(t: pa.Table) -> list[int]:
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        out: list[int] = []
        heads = [*np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(heads, heads[1:]):
            out += range(a, b, most or b - a)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        heads = cuts(held)
        for a, b in zip(heads, heads[1:]):
            yield held.slice(a, b - a)
        held = held.slice(heads[-1])
    if held is not None and held.num_rows:
        yield held


def _placed(nodes: DataFrame, dim: int, tables: int, seed: int) -> DataFrame:
    """Each node once a table with its place in that table's hyperplane order."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((tables, dim, 33))
        for batch in batches:
            x = unit(batch.column("vec"))
            for t in range(tables):
                p = x @ planes[t]
                sig = np.packbits(p[:, :32] > 0, axis=1).view(">u4").ravel().astype(np.int64)
                extra = [pa.array(np.full(len(x), t)), pa.array(sig), pa.array(p[:, 32])]
                yield pa.RecordBatch.from_arrays([*extra, batch.column("node"), batch.column("component"), batch.column("vec")], names=["t", "sig", "side", "node", "component", "vec"])

    schema = "t long, sig long, side double, node long, component long, vec array<double>"
    return nodes.select("node", "component", "vec").mapInArrow(place, schema)


def _seed_edges(nodes: DataFrame, dim: int, tables: int, leaf: int, take: int, seed: int) -> DataFrame:
    """The ``take`` nearest of each node in its block of every table, outside its own component."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _sorted_groups(batches, ["t"], leaf):
            ids, comp = block.column("node").to_numpy(), block.column("component").to_numpy()
            x = unit(block.column("vec"))
            sim = x @ x.T
            sim[comp[:, None] == comp[None, :]] = -2
            n = min(take, len(ids) - 1)
            if n < 1:
                continue
            best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            got = np.take_along_axis(sim, best, axis=1).ravel()
            src, dst = np.repeat(ids, n), ids[best].ravel()
            keep = got > -2
            yield _edges(src[keep], dst[keep], got[keep])

    order = ["t", "sig", "side"]
    placed = _placed(nodes, dim, tables, seed)
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(nearest, EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; ``new`` only if the pair was not there before."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _introduced(edges: DataFrame, nodes: DataFrame, k: int, group: int, turn: int) -> DataFrame:
    """Updates (src, dst, sim) from one round of introductions."""
    kth = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    kth = kth.select(F.col("src").alias("node"), F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("floor"))
    named = edges.groupBy("dst").agg(F.count("*").alias("n")).select(F.col("dst").alias("v"), F.ceil(F.col("n") / group).alias("parts"))
    ahead = edges.select(F.col("src").alias("v"), F.col("dst").alias("node"), "new")
    ahead = ahead.join(named, "v", "left").withColumn("part", F.explode(F.expr("sequence(0, cast(coalesce(parts, 1) as int) - 1)")))
    back = edges.select(F.col("dst").alias("v"), F.col("src").alias("node"), "new").join(named, "v")
    back = back.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "node"), "parts").cast("int"))
    met = ahead.select("v", "part", "node", "new").unionByName(back.select("v", "part", "node", "new"))
    met = met.groupBy("v", "part", "node").agg(F.max("new").alias("new"))
    fresh = met.groupBy("v", "part").agg(F.max("new").alias("any")).where("any").select("v", "part")
    met = met.join(fresh, ["v", "part"])
    met = met.join(nodes.join(kth, "node", "left").select("node", "component", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "node")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, sims, size = [], [], [], 0
        for g in _sorted_groups(batches, ["v", "part"]):
            ids, comp, low = g.column("node").to_numpy(), g.column("component").to_numpy(), g.column("floor").to_numpy()
            new = g.column("new").to_numpy(zero_copy_only=False).astype(bool)
            x = unit(g.column("vec"))
            sim = x @ x.T
            good = (new[:, None] | new[None, :]) & (comp[:, None] != comp[None, :]) & (sim > low[:, None])
            a, b = np.nonzero(good)
            src.append(ids[a])
            dst.append(ids[b])
            sims.append(sim[a, b])
            size += len(a)
            if size > 100_000:
                yield _edges(np.concatenate(src), np.concatenate(dst), np.concatenate(sims))
                src, dst, sims, size = [], [], [], 0
        if size:
            yield _edges(np.concatenate(src), np.concatenate(dst), np.concatenate(sims))

    met = met.select("v", "part", "node", "component", "new", "floor", "vec")
    return met.repartition("v", "part").sortWithinPartitions("v", "part", "node").mapInArrow(introduce, EDGE)


def descend(nodes: DataFrame, dim: int, scratch: Scratch, name: str, threshold: float, k: int, tables: int, leaf: int, group: int, seed: int) -> DataFrame:
    """The neighbour graph (src, dst, sim, new) of pairs in different components."""
    first = _seed_edges(nodes, dim, tables, leaf, max(2, k // 2), seed).withColumn("new", F.lit(True))
    edges, turn = scratch.write(_best(first, k), f"{name}-0"), 0
    while True:
        turn += 1
        more = _introduced(edges, nodes, k, group, turn).withColumn("new", F.lit(True))
        edges = scratch.write(_best(edges.withColumn("new", F.lit(False)).unionByName(more), k), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        scratch.release()
        # a round that finds no new link, or changes hardly any list, ends the search
        got = edges.agg(F.count_if(F.col("new") & (F.col("sim") >= threshold)).alias("links"), F.count_if("new").alias("new"), F.count("*").alias("n")).first()
        if not got["links"] or got["new"] <= 0.001 * got["n"]:
            return edges


def count_links(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, n): vectors linked to each, compared block by block inside its component; no pair is emitted."""
    sizes = nodes.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    rows = nodes.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = rows.select("component", "node", "weight", "vec", "own", F.explode(pairs).alias("p"))
    rows = rows.select("component", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "own", "node", "weight", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _sorted_groups(batches, ["component", "i", "j"]):
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            own, ids, weight = (g.column(c).to_numpy() for c in ("own", "node", "weight"))
            x = unit(g.column("vec"))
            near = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
            if i != j:
                near &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near * weight[None, :]).sum(axis=1).astype(np.int64))], names=["node", "n"])

    keys = ["component", "i", "j"]
    parts = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, n long")
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def audit_truth(nodes: DataFrame, threshold: float, audit: int) -> DataFrame:
    """(node, n): links of ``audit`` nodes, or 16 * sqrt(n) if more, counted against all vectors."""
    audit = max(audit, math.ceil(16 * math.sqrt(nodes.count())))
    sample = nodes.select("node", "vec").orderBy(F.xxhash64(F.lit(7), "node"), "node").limit(audit).toPandas()
    q = unit(pa.array(sample["vec"].tolist(), type=pa.list_(pa.float64()))) if len(sample) else np.zeros((0, 1))
    asked = nodes.sparkSession.sparkContext.broadcast((sample["node"].to_numpy(dtype=np.int64), q))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        n = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own, weight = unit(batch.column("vec")), batch.column("node").to_numpy(), batch.column("weight").to_numpy()
                for a in range(0, len(ids), 256):
                    near = (q[a : a + 256] @ x.T >= threshold) & (ids[a : a + 256, None] != own[None, :])
                    n[a : a + 256] += near @ weight
        yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(n)], names=["node", "n"])

    return nodes.select("node", "vec", "weight").mapInArrow(against, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audited_recall(truth: DataFrame, counts: DataFrame, k: int) -> float:
    """The mean share of links found a vector, over vectors of at most ``k`` links and over those of more: the lower one."""
    seen = truth.where("n > 0").join(counts.select("node", F.col("n").alias("have")), "node", "left")
    share = F.coalesce("have", F.lit(0)) / F.col("n")
    return min((r["r"] for r in seen.groupBy((F.col("n") > k).alias("many")).agg(F.avg(share).alias("r")).collect()), default=1.0)


def _relabel(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return nodes.drop("component").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link_vectors(classes: DataFrame, dim: int, scratch: Scratch, threshold: float, k: int, tables: int, leaf: int, group: int, block: int, audit: int, recall: float, seed: int) -> tuple[DataFrame, float]:
    """(node, component, n) of classes (node, vec, weight) of one length, and the audited recall."""
    nodes, links, truth, turn, name = classes.withColumn("component", F.col("node")), None, None, 0, f"d{dim}"
    while True:
        # search for links between components until there are none
        found = descend(nodes, dim, scratch, f"{name}-graph-{turn}", threshold, k, tables, leaf, group, seed + turn)
        new = scratch.write(found.where(F.col("sim") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b")), f"{name}-links-{turn}")
        links = new if links is None else links.unionByName(new)
        saturated = found.where(F.col("sim") >= threshold).groupBy("src").count().where(F.col("count") >= k)
        if new.head(1):
            comp = connected_components(links, scratch, f"{name}-cc-{turn}")
            nodes = scratch.write(_relabel(classes, comp), f"{name}-nodes-{turn}")
            turn += 1
            if saturated.head(1):
                continue  # enlarged lists: the component is taken as known, neighbours outside it are sought
        else:
            turn += 1
        counts = scratch.write(count_links(nodes, threshold, block), f"{name}-counts-{turn}")
        truth = scratch.write(audit_truth(classes, threshold, audit), f"{name}-truth") if truth is None else truth
        got = audited_recall(truth, counts, k)
        if got >= recall:
            return nodes.select("node", "component").join(counts, "node", "left").select("node", "component", F.coalesce("n", F.lit(0)).alias("n")), got


def near_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 8, tables: int = 8, leaf: int = 64, group: int = 48, block: int = 512, audit: int = 256, recall: float = 0.99, seed: int = 42) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall of every row."""
    scratch = Scratch(vectors.sparkSession, "nndescent")
    rows = scratch.write(usable(vectors), "rows")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    classes = scratch.write(classes.select("node", "weight", "vec", F.size("vec").alias("dim")), "classes")
    out = None
    for r in classes.select("dim").distinct().orderBy("dim").collect():
        own = scratch.write(classes.where(F.col("dim") == r["dim"]).drop("dim"), f"classes-{r['dim']}")
        got, rate = link_vectors(own, r["dim"], scratch, threshold, k, tables, leaf, group, block, audit, recall, seed)
        got = own.join(got, "node").select("vec", "component", (F.col("n") + F.col("weight") - 1).alias("n_links"), F.lit(rate).alias("audit_recall"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "vec array<double>, component long, n_links long, audit_recall double")
    # one row a class; equal vectors share it
    full = rows.join(scratch.write(out, "out"), "vec", "left")
    comp = F.coalesce("component", "vec_id")
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"), "audit_recall")


def op3_nndescent(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
