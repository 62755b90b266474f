"""Exact dedup (12): Grace hash deduplication.

1. Map side, a table of bounded bytes collapses equal texts of a task: every row
   goes to the spill files as a member (its number, its group), every text once as
   a leader (whole content, copies, the row to keep).  A text that fills a third of
   all rows so leaves each task once.
2. A round partitions the leaders by a hash of their content.  A task deals its
   bucket to 16 sub-buckets, each an open-addressing table that compares complete
   contents.  When the tables outgrow ``table_bytes``, the largest sub-bucket is
   sent to the spill files of the next round, with all that still comes for it;
   sub-buckets that fit are settled.  The next round hashes with another seed.  A
   text that is alone in its sub-bucket can't be partitioned further and stays.
3. Where more than ``fan_in`` leaders share a hash, a round with salted buckets
   merges them first, so no task reads all leaders of a hot text.
4. Members get the group of their leader by a join on its number.

Two texts are equal when all their bytes are; null counts as empty; nothing is
normalised.  Of equal texts the row with the largest id stays, a null id being
smaller than any; of rows that share text and id, one stays, the first read.
``keep_id`` is null where all ids of the group are.  Rows of any length are
compared whole; a table holds at least one text however long.  Other columns are
not read, so names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table

SUB_BUCKETS = 16
#: bytes that an entry or a link counts beside its content
OVERHEAD = 200

SPILL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("g", pa.int64()), ("content", pa.binary()), ("copies", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])
SPILL_DDL = "row long, doc_id long, g long, content binary, copies long, keep_id long, keep_row long"
ROUND = pa.schema([("g", pa.int64()), ("to", pa.int64()), ("content", pa.binary()), ("copies", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("sha", pa.string())])
ROUND_DDL = "g long, to long, content binary, copies long, keep_id long, keep_row long, sha string"


class ContentTable:
    """Open addressing with linear probing; a slot names an entry, entries hold whole contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.groups: list[int] = []
        self.copies: list[int] = []
        self.keep: list[tuple[int | None, int]] = []
        self.links: list[list[int]] = []
        self.n_links = 0
        self.bytes = 0

    def _probe(self, h: int, content: bytes | None) -> int:
        """The slot of ``content``, or the free one where it would go (with None, the first free one)."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if content is not None and self.hashes[e] == h and self.contents[e] == content:
                break
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for e, h in enumerate(self.hashes):
            self.slots[self._probe(h, None)] = e

    def add(self, h: int, content: bytes, g: int, copies: int, keep: tuple[int | None, int]) -> int:
        """The entry of ``content``, to which the copies are counted."""
        at = self._probe(h, content)
        e = self.slots[at]
        if e >= 0:
            self.copies[e] += copies
            if _before(self.keep[e], keep):
                self.keep[e] = keep
            return e
        e = self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.groups.append(g)
        self.copies.append(copies)
        self.keep.append(keep)
        self.links.append([])
        self.bytes += len(content) + OVERHEAD
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        return e

    def link(self, e: int, g: int) -> None:
        self.links[e].append(g)
        self.n_links += 1
        self.bytes += OVERHEAD


def _before(a: tuple[int | None, int], b: tuple[int | None, int]) -> bool:
    """Whether (id, row) ``b`` stays rather than ``a``: the larger id, then the smaller row."""
    if a[0] != b[0]:
        return b[0] is not None and (a[0] is None or b[0] > a[0])
    return b[1] < a[1]


class _Rows:
    """Rows gathered to record batches of bounded bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit, self.rows, self.size = schema, limit, [], 0

    def put(self, *row) -> None:
        self.rows.append(row)
        self.size += 64 + sum(len(x) for x in row if isinstance(x, bytes))

    def full(self) -> bool:
        return self.size >= self.limit

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [[]] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def _collapse(table_bytes: int):
    """Documents (doc_id, h, content) to members and leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        table, out = ContentTable(), _Rows(SPILL)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal table
            for e, content in enumerate(table.contents):
                out.put(None, None, table.groups[e], content, table.copies[e], *table.keep[e])
                if out.full():
                    yield out.take()
            table = ContentTable()

        for batch in batches:
            for doc_id, h, content in zip(batch["doc_id"].to_pylist(), batch["h"].to_pylist(), batch["content"]):
                e = table.add(h, content.as_py(), row, 1, (doc_id, row))
                out.put(row, doc_id, table.groups[e], None, None, None, None)
                row += 1
                if out.full():
                    yield out.take()
                if table.bytes > table_bytes:
                    yield from flush()
        yield from flush()
        yield out.take()

    return run


def _dedup(table_bytes: int, merge_only: bool):
    """Leaders (g, h, content, copies, keep_id, keep_row) of one bucket to settled, linked and spilled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[ContentTable | None] = [ContentTable() for _ in range(SUB_BUCKETS)]
        out = _Rows(ROUND)

        def spill(t: ContentTable) -> Iterator[pa.RecordBatch]:
            for e, content in enumerate(t.contents):
                g = t.groups[e]
                out.put(g, g, content, t.copies[e], *t.keep[e], None)
                for x in t.links[e]:
                    out.put(x, g, None, None, None, None, None)
                if out.full():
                    yield out.take()

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("g", "h", "copies", "keep_id", "keep_row")]
            for g, h, copies, keep_id, keep_row, content in zip(*cols, batch["content"]):
                sub = (h >> 32) % SUB_BUCKETS
                if (table := tables[sub]) is None:
                    out.put(g, g, content.as_py(), copies, keep_id, keep_row, None)
                else:
                    e = table.add(h, content.as_py(), g, copies, (keep_id, keep_row))
                    if table.groups[e] != g:
                        table.link(e, g)
                    if sum(t.bytes for t in tables if t) > table_bytes:
                        # one text without links cannot be partitioned further
                        largest = max((k for k, t in enumerate(tables) if t and len(t.hashes) + t.n_links > 1), key=lambda k: tables[k].bytes, default=None)
                        if largest is not None:
                            yield from spill(tables[largest])
                            tables[largest] = None
                if out.full():
                    yield out.take()
        for t in tables:
            if t and merge_only:
                yield from spill(t)
            elif t:
                for e, content in enumerate(t.contents):
                    sha = hashlib.sha256(content).hexdigest()
                    for g in [t.groups[e], *t.links[e]]:
                        out.put(g, g, None, t.copies[e], *t.keep[e], sha)
                        if out.full():
                            yield out.take()
        yield out.take()

    return run


def _round(leaders: DataFrame, k: int, scratch: Scratch, table_bytes: int, fan_in: int) -> DataFrame:
    """One partitioning of the leaders by a hash of seed ``k``, written as the next spill files."""
    leaders = leaders.withColumn("h", F.xxhash64(F.lit(k), "content"))
    hottest = leaders.groupBy("h").count().agg(F.max("count")).first()[0] or 0
    total = leaders.agg(F.sum(F.octet_length("content") + OVERHEAD)).first()[0] or 0
    n = max(1, -(-2 * int(total) // table_bytes))  # buckets of half a table's size
    keys = [F.col("h")]
    if hottest > fan_in:
        keys.append(F.pmod(F.xxhash64(F.lit(k), "g"), F.lit(-(-hottest // fan_in))))
    dealt = leaders.select("g", "h", "content", "copies", "keep_id", "keep_row").repartition(n, *keys)
    return scratch.write(dealt.mapInArrow(_dedup(table_bytes, hottest > fan_in), ROUND_DDL), f"round-{k}")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = 64 << 20, fan_in: int = 2048) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per input row."""
    scratch = Scratch(docs.sparkSession, "exactdup")
    rows = project(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), content=F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    rows = rows.select("doc_id", F.xxhash64("content").alias("h"), "content")
    spill = scratch.write(rows.mapInArrow(_collapse(table_bytes), SPILL_DDL), "spill")
    members = spill.where("row IS NOT NULL").select("row", "doc_id", "g")
    done: list[DataFrame] = []
    linked: list[DataFrame] = []
    leaders, k = spill.where("row IS NULL"), 0
    while True:
        k += 1
        out = _round(leaders, k, scratch, table_bytes, fan_in)
        done.append(out.where("sha IS NOT NULL").select("g", "copies", "keep_id", "keep_row", "sha"))
        linked.append(out.where("sha IS NULL AND content IS NULL").select("g", "to"))
        leaders = out.where("content IS NOT NULL")
        if leaders.isEmpty():
            break
    groups = done[-1]
    for settled, links in zip(done[-2::-1], linked[-2::-1]):
        later = groups.withColumnRenamed("g", "to")
        groups = settled.unionByName(groups).unionByName(links.join(later, "to").drop("to"))
    return members.join(groups, "g").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
