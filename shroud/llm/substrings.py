"""Exact substring dedup by bucket-pointer refinement (7).

Every byte covered by a ``window``-byte string that also starts earlier (smaller
document id, or the same document and an earlier start) is removed; strings are
judged on the input and never cross documents.

Positions with equal prefixes share a bucket.  A bucket identifier of depth 2d is
made from the identifier of depth d at the position and the one d bytes later, so
each refinement reuses the identifiers of the last (8, 16, 32, 64, then the full
window from two overlapping 64s).  Not every suffix is moved:

1. Map side, the initial buckets are 32-byte q-grams.  Every window belongs to
   the q-gram of least identifier in it (leftmost on ties), a rule of its content
   alone, so equal windows have the same q-gram at the same offset.  Neighbouring
   windows of one q-gram occurrence form a run; runs with equal identifiers of
   their whole text are pre-aggregated in each block of documents: later ones are
   removed at once and only the first travels.
2. Runs are exchanged by q-gram bucket.  Equal runs leave the first; a bucket
   with one distinct run is settled.  A bucket with several is refined.
3. Runs of unsettled buckets fetch their bytes and are refined by sorting their
   windows on the identifiers at the window and at the later offset, down to the
   full window; of each final bucket all but the first place are removed.
4. Removed stretches are merged per document and the rest is hashed.

Identifiers are 64-bit mixes compared only inside one q-gram bucket.

Null text counts as empty.  Rows without an id have no place in the order: they
lose nothing and nothing is lost because of them.  Rows that repeat an id are the
same document (no string of one starts before the same string of the other).
Texts shorter than the window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table, text_bytes

WINDOW = 100
Q = 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BLOCK = 1 << 19  # bytes taken at once; places in a block have 20 bits
_PLACE = np.uint64((1 << 20) - 1)
LOST, RUN = 0, 1  # kinds of rows: a removed stretch, a run of windows

ROW = "kind long, anchor long, ctx long, doc long, start long, n long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in ROW.split(", ")])


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of the deeper buckets."""
    x = a * _A + b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _depth8(data: np.ndarray) -> np.ndarray:
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,)).copy()
    return _join(words, words >> np.uint64(32))


def _deeper(ids: np.ndarray, depth: int) -> np.ndarray:
    return _join(ids[:-depth], ids[depth:]) if len(ids) > depth else np.zeros(0, dtype=np.uint64)


def identifiers(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of depth 32 at every position."""
    return _deeper(_deeper(_depth8(data), 8), 16)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of a block: (anchor bucket, run identifier, first window, windows).

    ``valid`` marks the windows that lie in one document.
    """
    ids = identifiers(data)
    span = window - Q + 1
    if len(ids) < span:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    place = np.arange(len(ids), dtype=np.uint64)
    least = _sliding_min((ids & ~_PLACE) | place, span)
    at = (least & _PLACE).astype(np.int64)
    at = np.where(valid[: len(at)], at, -1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    keep = at[first] >= 0
    first, n = first[keep], n[keep]
    anchor = at[first]
    last = first + n - 1 + window - 64  # the last 64 bytes of the run's text
    sixty_four = lambda p: _join(ids[p], ids[p + 32])
    ctx = _join(_join(sixty_four(first), sixty_four(np.minimum(first + 64, last))), sixty_four(last))
    ctx = _join(ctx, (n * 128 + anchor - first).astype(np.uint64))
    return ids[anchor], ctx, first, n


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of documents as (bytes, start of each piece in them, (doc, offset) of each piece)."""
    docs, texts = batch.column(0), batch.column(1)
    parts, starts, owner, size = [], [], [], 0
    for i in range(batch.num_rows):
        if not docs[i].is_valid or not texts[i].is_valid:
            continue
        raw, doc = texts[i].as_py(), docs[i].as_py()
        at = 0
        while len(raw) - at >= WINDOW:
            piece = raw[at : at + _BLOCK - size]
            if len(piece) < WINDOW:  # the block is full
                yield _packed(parts, starts, owner)
                parts, starts, owner, size = [], [], [], 0
                continue
            parts.append(piece)
            starts.append(size)
            owner.append((doc, at))
            size += len(piece)
            if at + len(piece) == len(raw):
                break
            at += len(piece) - WINDOW + 1
    if parts:
        yield _packed(parts, starts, owner)


def _packed(parts, starts, owner):
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64).reshape(-1, 2)


def _rows(kind, anchor, ctx, doc, start, n) -> pa.RecordBatch:
    size = len(doc)
    full = lambda x: pa.array(np.full(size, x, dtype=np.int64) if np.isscalar(x) else np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([full(kind), full(anchor), full(ctx), full(doc), full(start), full(n)], schema=_ARROW)


def _first_places(anchor, ctx, doc, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, ctx, place); which are the first place of their (anchor, ctx); which begin a bucket."""
    order = np.lexsort((start, doc, ctx, anchor))
    a, c, d, s = anchor[order], ctx[order], doc[order], start[order]
    new_bucket = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=bool)
    new_class = new_bucket.copy()
    new_class[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new_class)
    owner = np.repeat(head, np.diff(np.append(head, len(a))))
    first = (d == d[owner]) & (s == s[owner])  # rows that repeat an id stand at the same place
    return order, first, new_bucket


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [begin, end) merged where they touch, per document."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new_doc)
    shift = group * (int(end.max()) + 1)  # running maximum per document in one pass
    reach = np.maximum.accumulate(end + shift) - shift
    new = new_doc.copy()
    new[1:] |= begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return doc[head], begin[head], reach[np.append(head[1:] - 1, len(doc) - 1)]


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 over (doc_id, bytes): the first of equal runs of a block, and the stretches of the others."""
    with np.errstate(over="ignore"):
        for batch in batches:
            found = []
            for data, starts, owner in _blocks(batch):
                valid = np.ones(len(data), dtype=bool)
                ends = np.append(starts[1:], len(data))
                for e in ends.tolist():
                    valid[max(0, e - WINDOW + 1) : e] = False
                anchor, ctx, first, n = runs_of(data, valid, WINDOW)
                piece = np.searchsorted(starts, first, side="right") - 1
                found.append((anchor, ctx, owner[piece, 0], owner[piece, 1] + first - starts[piece], n))
            if not found:
                continue
            anchor, ctx, doc, start, n = (np.concatenate(x) for x in zip(*found))
            order, is_first, _ = _first_places(anchor, ctx, doc, start)
            keep, lost = order[is_first], order[~is_first]
            yield _rows(RUN, anchor[keep], ctx[keep], doc[keep], start[keep], n[keep])
            if len(lost):
                d, b, e = _merged(doc[lost], start[lost], start[lost] + n[lost] - 1 + WINDOW)
                yield _rows(LOST, _join(d.astype(np.uint64), b.astype(np.uint64)), 0, d, b, e - b)


def settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over whole buckets: removed stretches, and the distinct runs of buckets that need refinement."""
    got = list(batches)
    if not any(b.num_rows for b in got):
        return
    table = pa.Table.from_batches(got)
    kind, anchor, ctx, doc, start, n = (c.to_numpy() for c in table.columns)
    old = kind == LOST
    gone = [(doc[old], start[old], start[old] + n[old])]
    anchor, ctx, doc, start, n = (x[~old] for x in (anchor, ctx, doc, start, n))
    order, is_first, new_bucket = _first_places(anchor, ctx, doc, start)
    lost = order[~is_first]
    gone.append((doc[lost], start[lost], start[lost] + n[lost] - 1 + WINDOW))
    d, b, e = _merged(*(np.concatenate(x) for x in zip(*gone)))
    yield _rows(LOST, 0, 0, d, b, e - b)
    if len(order):
        bucket = np.cumsum(new_bucket) - 1
        c = ctx[order]
        distinct = np.bincount(bucket, weights=np.concatenate([[1.0], (c[1:] != c[:-1]) | new_bucket[1:]]))
        open_ = order[is_first & (distinct[bucket] > 1)]
        yield _rows(RUN, anchor[open_], 0, doc[open_], start[open_], n[open_])


def refine(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 3 for runs of whole buckets: the removed stretches."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(size) - size
    ids = identifiers(data)
    owner = np.repeat(np.arange(len(texts)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    p = base[owner] + step
    deep = _join(ids[p], ids[p + 32])  # depth 64
    later = p + WINDOW - 64
    full = _join(_join(deep, _join(ids[later], ids[later + 32])), anchor[owner].view(np.uint64))
    place = start[owner] + step
    order = np.lexsort((place, doc[owner], full))
    f, d, s = full[order], doc[owner][order], place[order]
    head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    lead = np.repeat(head, np.diff(np.append(head, len(f))))
    lost = (d != d[lead]) | (s != s[lead])
    return _merged(d[lost], s[lost], s[lost] + WINDOW)


def refine_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over rows (anchor, doc, start, n, bytes) of whole buckets, about 50,000 runs at a time."""
    got = list(batches)
    if not any(b.num_rows for b in got):
        return
    table = pa.Table.from_batches(got)
    anchor, doc, start, n = (table.column(i).to_numpy() for i in range(4))
    texts = table.column(4)
    order = np.argsort(anchor, kind="stable")
    at = 0
    with np.errstate(over="ignore"):
        while at < len(order):
            end = min(len(order), at + 50_000)
            while end < len(order) and anchor[order[end]] == anchor[order[end - 1]]:
                end += 1
            pick = order[at:end]
            own = texts.take(pa.array(pick)).to_pylist()
            d, b, e = refine(anchor[pick], doc[pick], start[pick], n[pick], own)
            if len(d):
                yield _rows(LOST, 0, 0, d, b, e - b)
            at = end


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each unsettled run of (doc, text, runs)."""
    for batch in batches:
        out = {"anchor": [], "doc": [], "start": [], "n": [], "bytes": []}
        for row in batch.to_pylist():
            raw = row["text"] or b""
            for r in row["runs"]:
                text = raw[r["start"] : r["start"] + r["n"] - 1 + WINDOW]
                if len(text) == r["n"] - 1 + WINDOW:  # else another row that repeats the id had the run
                    for k, v in (("anchor", r["anchor"]), ("doc", row["doc"]), ("start", r["start"]), ("n", r["n"]), ("bytes", text)):
                        out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k], type=pa.binary() if k == "bytes" else pa.int64()) for k in out], names=list(out))


def _finish(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, lost in texts:
        rows = []
        for raw, spans in zip(text, lost):
            raw = raw or b""
            spans = [] if spans is None else [(int(s["start"]), min(len(raw), int(s["start"] + s["n"]))) for s in spans if s["start"] < len(raw)]
            if not spans:
                rows.append((0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            b, e = np.array(spans, dtype=np.int64).T
            _, b, e = _merged(np.zeros(len(b), dtype=np.int64), b, e)
            kept, at = hashlib.sha256(), 0
            for x, y in zip(b.tolist(), e.tolist()):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((int((e - b).sum()), len(b), kept.hexdigest()))
        yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])


def removed_stretches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, start, n): stretches of bytes to remove; they may touch or overlap."""
    rows = project(docs, doc="doc_id", text=text_bytes("text")).withColumn("doc", F.col("doc").cast("long"))
    runs = rows.where("doc is not null").select("doc", "text").mapInArrow(find_runs, ROW)
    settled = scratch.write(runs.repartition("anchor").mapInArrow(settle_runs, ROW), "settled")
    scratch.release()  # the exchange of all runs is no longer needed
    todo = settled.where(F.col("kind") == RUN).groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("runs"))
    cut = rows.join(todo, "doc").select("doc", "text", "runs").mapInArrow(_cut_runs, "anchor long, doc long, start long, n long, bytes binary")
    refined = scratch.write(cut.repartition("anchor").mapInArrow(refine_buckets, ROW), "refined")
    scratch.release()
    return settled.where(F.col("kind") == LOST).select("doc", "start", "n").unionByName(refined.select("doc", "start", "n"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession, "substrings")
    lost = removed_stretches(docs, scratch).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("lost"))
    rows = project(docs, doc="doc_id", text=text_bytes("text")).withColumn("doc", F.col("doc").cast("long"))
    finish = F.pandas_udf(_finish, "n_removed long, n_spans long, kept_sha256 string")
    out = rows.join(lost, "doc", "left").withColumn("r", finish("text", "lost"))
    return out.select(F.col("doc").alias("doc_id"), F.length("text").cast("long").alias("n_bytes"), "r.n_removed", "r.n_spans", "r.kept_sha256")


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))
