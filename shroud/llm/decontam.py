"""Benchmark decontamination (1): greedy string tiling.

Texts become lower-case word tokens.  A document and a benchmark item that share
a seed of ``seed`` consecutive tokens are compared: the longest common run of
unmarked tokens is marked as a tile, again and again, until no run of ``seed``
tokens is left (greedy string tiling).  Runs are found by running Karp-Rabin
hashes of the token numbers and confirmed token by token.  Tiles never overlap,
and they may lie in any order, so reordered passages count.  The pair is reported
when its tiles cover ``coverage`` or more of the item's tokens.

The benchmark is taken in blocks of at most ``block_tokens`` tokens; each block
is broadcast (that bound is its proven size) and joined with all documents in
one map-side pass, so texts are never shuffled and a benchmark of any size works.

Null or empty texts match nothing; items without a token match nothing; items of
fewer than ``seed`` tokens are one seed of their own length.  Repeated rows are
reported as often as they occur.  Rows with null ids are reported with null ids.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import project, read_table

TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` numbers (modulo 2**64)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = h * _BASE + ids[j : n + j].astype(np.uint64)
    return h


class Tiler:
    """One block of benchmark items, ready to be compared with documents."""

    def __init__(self, items: list[tuple[int | None, list[str]]], seed: int):
        self.seed = seed
        self.vocab: dict[str, int] = {}
        self.items = []
        places = defaultdict(lambda: defaultdict(list))  # seed width -> hash -> [(item, position)]
        for number, (item_id, words) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64)
            self.items.append((item_id, ids))
            width = min(seed, len(ids))
            for pos, h in enumerate(rolling(ids, width).tolist() if width else []):
                places[width][h].append((number, pos))
        self.places = {w: dict(p) for w, p in places.items()}
        self.sieve = {}
        for w, p in self.places.items():  # a bit table of hash prefixes, asked before the sorted hashes
            keys = np.sort(np.fromiter(p, dtype=np.uint64, count=len(p)))
            shift = np.uint64(64 - max(12, min(26, len(keys).bit_length() + 4)))
            table = np.zeros(1 << int(64 - shift), dtype=bool)
            table[keys >> shift] = True
            self.sieve[w] = (keys, shift, table)

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item number -> [(document position, item position)] of the shared seeds."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for width, (keys, shift, table) in self.sieve.items():
            h = rolling(ids, width)
            at = np.flatnonzero(table[h >> shift])
            if not len(at):
                continue
            got = h[at]
            there = keys[np.minimum(np.searchsorted(keys, got), len(keys) - 1)] == got
            for pos, key in zip(at[there].tolist(), got[there].tolist()):
                for number, item_pos in self.places[width][key]:
                    if np.array_equal(ids[pos : pos + width], self.items[number][1][item_pos : item_pos + width]):
                        found[number].append((pos, item_pos))
        return found

    def tile(self, doc: np.ndarray, number: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Tiles (document position, item position, length), longest first."""
        item = self.items[number][1]
        least = min(self.seed, len(item))
        runs: dict[int, list[list[int]]] = defaultdict(list)  # diagonal -> maximal runs of seeds
        for pos, item_pos in sorted(hits):
            row = runs[pos - item_pos]
            if row and row[-1][0] + row[-1][1] - least + 1 == pos:
                row[-1][1] += 1
            else:
                row.append([pos, least])
        heap = [(-n, pos, pos - diagonal) for diagonal, row in runs.items() for pos, n in row]
        heapify(heap)
        in_doc: set[int] = set()
        in_item = np.zeros(len(item), dtype=bool)
        tiles = []
        while heap:
            n, pos, item_pos = heappop(heap)
            n = -n
            free = [not in_item[item_pos + k] and pos + k not in in_doc for k in range(n)]
            if all(free):
                tiles.append((pos, item_pos, n))
                in_item[item_pos : item_pos + n] = True
                in_doc.update(range(pos, pos + n))
                continue
            k = 0
            while k < n:  # what is left of the run competes again with its own length
                if free[k]:
                    end = k
                    while end < n and free[end]:
                        end += 1
                    if end - k >= least:
                        heappush(heap, (k - end, pos + k, item_pos + k))
                    k = end
                k += 1
        return tiles

    def compare(self, text: str | None, coverage: float) -> list[tuple]:
        words = tokens(text)
        if not words:
            return []
        ids = np.array([self.vocab.get(w, 0) for w in words], dtype=np.int64)
        out = []
        for number, hits in self.hits(ids).items():
            item_id, item = self.items[number]
            if self._reach(hits, len(item), min(self.seed, len(item))) < coverage * len(item):
                continue
            tiles = self.tile(ids, number, hits)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                out.append((item_id, len(item), covered, covered / len(item), len(tiles), ",".join(f"{p}:{p + n}" for p, _, n in sorted(tiles))))
        return out

    @staticmethod
    def _reach(hits: list[tuple[int, int]], n: int, width: int) -> int:
        """Item tokens under any seed: no tiling covers more."""
        edge = np.zeros(n + 1, dtype=np.int64)
        for i in {i for _, i in hits}:
            edge[i] += 1
            edge[i + width] -= 1
        return int((np.cumsum(edge)[:n] > 0).sum())


SCHEMA = "doc_id long, item_id long, item_tokens long, covered_tokens long, coverage double, n_tiles long, doc_token_spans string"


def _compare_block(docs: DataFrame, items: list[tuple[int | None, str]], seed: int, coverage: float) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiler = Tiler([(i, tokens(t)) for i, t in block.value], seed)
        for pdf in batches:
            rows = [(d, *r) for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for r in tiler.compare(t, coverage)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return docs.mapInPandas(run, SCHEMA)


def benchmark_blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks; one block at a time is on the driver."""
    items = project(benchmark, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("long")).where(F.length("text") > 0)
    # running length inside hash ranges of the items, so that the order of all items is never needed
    size = F.length("text").cast("long")
    total = items.agg(F.sum(size)).first()[0] or 0
    items = items.withColumn("cell", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // (2 * block_tokens))))))
    run = W.partitionBy("cell").orderBy("item_id", F.xxhash64("text"))
    items = items.withColumn("part", F.floor(F.sum(size).over(run) / (4 * block_tokens)))
    for b in items.select("cell", "part").distinct().orderBy("cell", "part").collect():
        rows = items.where((F.col("cell") == b["cell"]) & (F.col("part") == b["part"])).orderBy("item_id").select("item_id", "text").collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_tokens: int = 1 << 21) -> DataFrame:
    """One row per document and benchmark item that it contains (columns of ``SCHEMA``)."""
    docs = project(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in benchmark_blocks(benchmark, block_tokens):
        out = out.unionByName(_compare_block(docs, block, seed, coverage))
    return out


def op1_decontam(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _holds(items: list[tuple[int | None, str]], spark, seed: int, coverage: float):
    block = spark.sparkContext.broadcast(items)

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tiler = Tiler([(i, tokens(t)) for i, t in block.value], seed)
        for s in batches:
            yield pd.Series([bool(tiler.compare(t, coverage)) for t in s], dtype=bool)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_tokens: int = 1 << 21) -> DataFrame:
    """``docs`` without the rows whose text contains an item: one map-side filter a block, no join."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for items in benchmark_blocks(benchmark, block_tokens):
        holds = _holds(items, docs.sparkSession, seed, coverage)
        docs = docs.withColumn("__holds", holds("text")).where(~F.col("__holds")).select(*columns)
    return docs
