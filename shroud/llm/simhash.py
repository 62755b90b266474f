"""SimHash near-dedup (10): generalised pigeonhole search over fingerprints.

1. Fingerprint: words, shingles of ``k`` words with repeats, XXH64 of each; a
   bit is set if it is set in over half of the hashes.
2. Equal fingerprints are one class.  Bits are grouped into partitions so that
   bits that vary together (correlated over all classes) lie in one partition.
3. Generalised pigeonhole: a pair within ``max_bits`` differs in at most
   ``t_i`` bits of partition i for some i whenever sum(t_i + 1) = max_bits + 1.
   A dynamic program allots these unequal ``t_i`` (-1: not probed) to the
   partitions by the candidate counts of their value histograms.
4. Each class is indexed by its partition values and probes all values within
   ``t_i`` bits.  Posting lists longer than ``block_rows`` are split by the
   same principle: all bits are cut anew into pieces, one of which must agree, so
   no pair is lost, while splitting lessens the work.
5. Every candidate is verified by its bit distance; links give components.

Null or empty texts and texts without a word have fingerprint zero and link as
any other.  Rows with null ``doc_id`` keep their fingerprint; their component
is the smallest non-null id reachable, null if none is.  Repeated rows come
out as often as they went in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table
from shroud.llm.components import connected_components

BITS = 64
_CHUNK = 1 << 15


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """SimHash of one text; memory is bounded by blocks of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        if len(words) < k:
            hashes = [digest(join(words), seed)]
        elif k == 3:
            part = zip(words[lo:hi], words[lo + 1 : hi + 1], words[lo + 2 : hi + 2])
            hashes = [digest(b"%b %b %b" % w, seed) for w in part]
        else:
            hashes = [digest(join(words[i : i + k]), seed) for i in range(lo, hi)]
        h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, k, seed) for t in s], dtype=np.uint64).view(np.int64))

    return project(docs, doc_id="doc_id", text="text").select("doc_id", fp("text").alias("fp"))


def _piece(bits: list[int], col: str = "fp") -> Column:
    """The chosen bits of ``col`` packed into a long, runs of neighbours at a time."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - i + 1
        mask = (1 << width) - 1
        part = F.shiftrightunsigned(col, bits[i])
        if width < BITS:
            part = part.bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at)) if at or i else part
        at, i = at + width, j + 1
    return out


def _bit_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: counts of set bits and of pairs of set bits, with the row count in the last corner."""
    total = np.zeros((BITS + 1, BITS + 1))
    for pdf in batches:
        raw = pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64)
        bits = np.hstack([bits, np.ones((len(bits), 1))])
        total += bits.T @ bits
    yield pd.DataFrame({"at": np.arange(total.size), "n": total.ravel()})


def bit_correlation(classes: DataFrame) -> np.ndarray:
    """|correlation| of all bit pairs over all classes; 65 x 65 sums reach the driver."""
    sums = classes.select("fp").mapInPandas(_bit_moments, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    flat = np.zeros((BITS + 1) ** 2)
    for r in sums.collect():
        flat[r["at"]] = r["n"]
    moments = flat.reshape(BITS + 1, BITS + 1)
    n = max(1.0, moments[BITS, BITS])
    mean = moments[BITS, :BITS] / n
    cov = moments[:BITS, :BITS] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def correlated_partitions(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of even width, correlated bits together, greedily."""
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        seed = max(left, key=lambda i: (corr[i, list(left)].sum(), -i))
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(left, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allot_thresholds(cost: list[list[float]], budget: int) -> list[int]:
    """t_i >= -1 with sum(t_i + 1) = budget and the least total cost; cost[i][t] for t = 0, 1, ..."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * budget
    for row in cost:
        new: list[tuple[float, list[int]] | None] = [None] * (budget + 1)
        for used, have in enumerate(best):
            if have is None:
                continue
            for t in range(-1, min(len(row), budget - used)):
                c = have[0] + (row[t] if t >= 0 else 0.0)
                if new[used + t + 1] is None or c < new[used + t + 1][0]:
                    new[used + t + 1] = (c, have[1] + [t])
        best = new
    return best[budget][1]


def _flips(width: int, t: int) -> list[int]:
    """All masks of at most t set bits."""
    return [sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(width), k)]


def _plan(classes: DataFrame, corr: np.ndarray, m: int, budget: int) -> tuple[float, list[list[int]], list[int]]:
    """Partitions, thresholds and their estimated work: list entries met by all probes, and the probes."""
    parts = correlated_partitions(corr, m)
    lists = classes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _piece(p).alias("v")) for i, p in enumerate(parts)])).alias("k"))
    lists = lists.groupBy("k").agg(F.count("*").cast("double").alias("c")).groupBy("k.part").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    stat = {r["part"]: r for r in lists.collect()}
    cost = []
    for i, p in enumerate(parts):
        n, sq = (stat[i]["n"], stat[i]["sq"]) if i in stat else (0.0, 0.0)
        rings = [sum(comb(len(p), j) for j in range(t + 1)) for t in range(budget)]
        cost.append([n * r + sq + n * (r - 1) * n / 2.0 ** len(p) for r in rings])
    t = allot_thresholds(cost, budget)
    return sum(cost[i][x] for i, x in enumerate(t) if x >= 0), parts, t


def _tagged(part: int):
    return lambda v: F.struct(F.lit(part).alias("part"), v.alias("v"))


def fingerprint_links(classes: DataFrame, scratch: Scratch, max_bits: int = 2, m: int | None = None, block_rows: int = 256) -> DataFrame:
    """Pairs (a, b) of class nodes within ``max_bits``; ``classes`` has long ``node`` and distinct ``fp``."""
    corr, budget = bit_correlation(classes), max_bits + 1
    _, parts, t = min((_plan(classes, corr, k, budget) for k in ([m] if m else range(2, max_bits + 3))), key=lambda p: p[0])

    def keyed(side: str) -> DataFrame:
        rows = []
        for i, p in enumerate(parts):
            if t[i] < 0:
                continue
            flips = _flips(len(p), t[i]) if side == "probe" else [0]
            value = _piece(p)
            keys = F.array(*[value.bitwiseXOR(F.lit(f).cast("long")) for f in flips]) if len(flips) > 1 else F.array(value)
            rows.append(F.transform(keys, _tagged(i)))
        key = F.explode(F.concat(*rows))
        return classes.select("node", "fp", key.alias("k")).select("node", "fp", F.xxhash64("k.part", "k.v").alias("key"))

    return _join_lists(keyed("index"), keyed("probe"), scratch, max_bits, block_rows)


def _join_lists(index: DataFrame, probe: DataFrame, scratch: Scratch, max_bits: int, block_rows: int) -> DataFrame:
    """Verified pairs of two keyed sides.

    Lists of over ``block_rows`` entries are split: all bits are cut anew into
    max_bits + 1 pieces, of which a pair within ``max_bits`` shares at least one.
    Splitting goes on while it lessens the work of the long lists."""
    found, level, before = None, 0, None
    while True:
        sizes = index.groupBy("key").agg(F.count("*").alias("n"))
        long_keys = scratch.write(sizes.where(F.col("n") > block_rows), f"long-{level}")
        work = long_keys.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        more = work > 0 and (before is None or work < before)
        near = F.bit_count(F.col("i.fp").bitwiseXOR(F.col("p.fp"))) <= max_bits
        i, p = index, probe
        if more:
            i, p = i.join(long_keys, "key", "left_anti"), p.join(long_keys, "key", "left_anti")
        on = (F.col("i.key") == F.col("p.key")) & (F.col("i.node") != F.col("p.node")) & near
        pairs = i.alias("i").join(p.alias("p"), on).select(F.least("i.node", "p.node").alias("a"), F.greatest("i.node", "p.node").alias("b")).distinct()
        pairs = scratch.write(pairs, f"pairs-{level}")
        found = pairs if found is None else found.union(pairs)
        if not more:
            return found.distinct()
        level, before = level + 1, work
        order = np.random.default_rng(level).permutation(BITS).tolist()
        cut = [sorted(order[j :: max_bits + 1]) for j in range(max_bits + 1)]

        def finer(side: DataFrame, cut=cut, long_keys=long_keys) -> DataFrame:
            pieces = F.array(*[F.struct(F.lit(j).alias("j"), _piece(c).alias("v")) for j, c in enumerate(cut)])
            side = side.join(long_keys, "key", "left_semi").select("node", "fp", "key", F.explode(pieces).alias("s"))
            return side.select("node", "fp", F.xxhash64("key", "s.j", "s.v").alias("key"))

        index, probe = scratch.write(finer(index), f"index-{level}"), scratch.write(finer(probe), f"probe-{level}")


def simhash_groups(docs: DataFrame, k: int = 3, max_bits: int = 2, block_rows: int = 256, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp long, component_id)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, k, seed), "fp")
    classes = scratch.write(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "classes")
    links = fingerprint_links(classes, scratch, max_bits, block_rows=block_rows)
    comp = connected_components(links, scratch)
    label = classes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(scratch.write(label, "label"), "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their group; all columns.

    Only ids are moved: the texts are filtered by the written id lists, which
    Spark broadcasts where their files are small.  Of rows with the same id one
    stays; rows with null id all stay.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = scratch.write(simhash_groups(docs, k, max_bits).where("doc_id is not null"), "groups")
    gone = scratch.write(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    repeated = scratch.write(groups.groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "again")
    rest = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    once = rest.join(repeated, rest["doc_id"] == repeated["__again"], "left_anti")
    again = rest.join(repeated, rest["doc_id"] == repeated["__again"], "left_semi").dropDuplicates(["doc_id"])
    return once.select(*columns).unionByName(again.select(*columns))
