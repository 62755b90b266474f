"""Substring dedup by paragraph MinHash banding (5).

A paragraph is a piece of text that ends with a line or a sentence, as a set of
``k``-word shingles (fewer words: the whole piece), lower-cased.  Short pieces
keep passages findable that were pasted into the middle of other lines.

1. Equal paragraphs are one class (64-bit sum and number of the distinct shingles);
   each task shows bands for the first of a class in a block only.
2. MinHash bands of ``rows`` values each; ``tune`` takes the fewest bands that
   reach ``recall`` at the similarity limit.  Two sets of fewer than
   sim / (1 - sim) shingles can only be that similar if they are equal, so such
   paragraphs need no bands.
3. Paragraphs that share a band are compared: the sets are read again from one place
   of each class, and the sets of a cell are joined by their exact Jaccard similarity
   over rare shingles.  A cell gives out a spanning set of links, no pairs.  A band of
   more than ``cell_shingles`` shingles is cut into chunks, each two of which are a
   cell, so a hot band goes to many tasks and none holds more than two chunks.
4. Components of links and equal paragraphs; all but the first paragraph (smallest
   document, then place) of a component are marked.  Neighbouring marked
   paragraphs of a document form a removal if they have ``min_words`` words or more.

Texts that are null or without words have no paragraphs.  Rows without an id are
left as they are.  Rows that repeat an id are the same document.  Texts are read
whole, one at a time, however long.  Ties do not arise: places are distinct.  Only
``doc_id`` and ``text`` are read, so extra columns cannot clash.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table
from shroud.llm.components import connected_components

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE = ("key", "doc", "no", "begin", "end", "n")


def tune(sim: float, recall: float, background: float = 0.05) -> tuple[int, int]:
    """(bands, rows) that reach ``recall`` at ``sim`` with the least work: rows sent, and chance collisions at ``background``."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - sim**rows))
        work = bands + 100 * (1 - (1 - background**rows) ** bands)
        if best is None or work < best[0]:
            best = (work, bands, rows)
    return best[1], best[2]


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def pieces(text: str | None) -> tuple[list[str], np.ndarray]:
    """Words of a text, and the end (in words) of each paragraph."""
    words: list[str] = []
    ends: list[int] = []
    for line in (text or "").lower().split("\n"):
        own = line.split()
        if not own:
            continue
        at = len(words)
        words += own
        ends += [at + i + 1 for i, w in enumerate(own) if w[-1] in ".!?"]
        if not ends or ends[-1] != len(words):
            ends.append(len(words))
    return words, np.array(ends, dtype=np.int64)


def shingle_sets(words: list[str], ends: np.ndarray, k: int, look: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all paragraphs, ordered by paragraph, and the paragraph of each."""
    h = np.array(list(map(look.__getitem__, words)), dtype=np.uint64)
    starts = np.append(0, ends[:-1])
    n = ends - starts
    width = np.minimum(n, k)
    count = n - width + 1
    owner = np.repeat(np.arange(len(ends)), count)
    first = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    wide = width[owner]
    out = np.zeros(len(owner), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            on = j < wide
            out[on] = out[on] * _BASE + h[first[on] + j]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])]) if len(out) else np.zeros(0, dtype=bool)
    return out[new], owner[new]


def band_values(sets: np.ndarray, heads: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) band hashes of the sets that begin at ``heads``."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, size=bands * rows, dtype=np.uint64)
    out = np.zeros((len(heads), bands), dtype=np.uint64)
    if not len(heads):
        return out.view(np.int64)
    with np.errstate(over="ignore"):
        for i in range(bands * rows):
            x = sets * a[i] + b[i]
            x ^= x >> np.uint64(32)
            x *= _MIX
            least = np.minimum.reduceat(x, heads)
            out[:, i // rows] = out[:, i // rows] * _BASE + least + np.uint64(i // rows)
    return np.where(out == 0, np.uint64(1), out).view(np.int64)


def _find(k: int, bands: int, rows: int, least: int, block: int = 400_000):
    """Step 1 over (doc, text): rows (key, doc, no, begin, end, n, bands), worked out for about ``block`` words at once.

    ``bands`` is empty where not needed: in small sets, and in all but the first of a class in a block."""

    def table(docs: list[int], texts: list[np.ndarray], words: list[str], look: _Words) -> pa.RecordBatch:
        many = np.array([len(e) for e in texts])
        last = np.array([e[-1] for e in texts])
        base = np.repeat(np.cumsum(last) - last, many)  # words before the document in this block
        end = np.concatenate(texts)
        begin = np.append(0, end[:-1])
        place = np.arange(len(end)) - np.repeat(np.cumsum(many) - many, many)
        begin[place == 0] = 0
        sets, owner = shingle_sets(words, base + end, k, look)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        n = np.diff(np.append(heads, len(sets)))
        with np.errstate(over="ignore"):
            key = (np.add.reduceat(sets, heads) * _BASE + n.astype(np.uint64)).view(np.int64)
        shown = np.zeros(len(key), dtype=bool)
        shown[np.unique(key, return_index=True)[1]] = True
        shown &= n >= least
        width = n[shown]
        hashes = band_values(sets[np.repeat(shown, n)], np.cumsum(width) - width, bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(shown, bands, 0))), type=pa.int32()), pa.array(hashes.ravel()))
        flat = (key, np.repeat(np.array(docs, dtype=np.int64), many), place, begin, end, n)
        return pa.RecordBatch.from_arrays([*map(pa.array, flat), lists], names=[*PLACE, "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Words()
        docs, texts, words = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                own, ends = pieces(text.as_py())
                if not own:
                    continue
                docs.append(doc.as_py())
                texts.append(ends)
                words += own
                if len(words) >= block:
                    yield table(docs, texts, words, look)
                    docs, texts, words = [], [], []
        if docs:
            yield table(docs, texts, words, look)

    return run


def _read_sets(k: int):
    """(key, shingles) of asked paragraphs of (text, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Words()
        for batch in batches:
            keys, sets = [], []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, _ = pieces(text)
                for a in asked:
                    own = words[a["begin"] : a["end"]]
                    if own:
                        keys.append(a["key"])
                        sets.append(shingle_sets(own, np.array([len(own)]), k, look)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(sets, type=pa.list_(pa.int64()))], names=["key", "shingles"])

    return run


def span_links(keys: np.ndarray, sets: list[np.ndarray], sim: float) -> list[tuple[int, int]]:
    """Links of Jaccard similarity ``sim`` or more that span the components of all such links between ``sets``.

    Exact: shingles are ordered by how many sets have them, the rarest first, and two
    sets that similar share one of their first n - ceil(sim * n) + 1.  Sets already in
    one component are not compared."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    start = np.cumsum(size) - size
    order = np.lexsort((ids, count[ids], owner))
    ids = ids[order]  # of each set, the rarest first
    prefix = size - np.ceil(sim * size - 1e-9).astype(np.int64) + 1
    lead = np.flatnonzero(np.arange(len(ids)) - start[owner] < prefix[owner])
    by = lead[np.lexsort((owner[lead], ids[lead]))]
    holders, first = owner[by], np.searchsorted(ids[by], np.arange(len(token) + 1))
    label, members = np.arange(len(sets)), {i: [i] for i in range(len(sets))}
    mark = np.zeros(len(token), dtype=bool)
    links = []
    for i in range(len(sets)):
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = True
        for t in own[: prefix[i]].tolist():
            near = holders[first[t] : first[t + 1]]
            near = near[(near < i) & (label[near] != label[i])]
            near = near[(size[near] >= sim * size[i]) & (size[i] >= sim * size[near])]
            while len(near):
                now, near = near[-64:], near[:-64]
                width = size[now]
                at = np.repeat(start[now] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                both = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(width) - width)
                for j in now[both >= sim * (size[i] + width - both) - 1e-9].tolist():
                    a, b = label[i], label[j]
                    if a == b:
                        continue
                    links.append((int(keys[i]), int(keys[j])))
                    if len(members[a]) > len(members[b]):
                        a, b = b, a
                    label[members[a]] = b  # the smaller one is renamed
                    members[b] += members.pop(a)
                near = near[label[near] != label[i]]
        mark[own] = False
    return links


def _verify(sim: float):
    """Spanning links of each cell of rows (band, low, high, key, shingles) sorted by cell; one cell is held at a time."""

    def table(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        out = np.array(span_links(np.array(keys), sets, sim) if len(keys) > 1 else [], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []
        for batch in batches:
            for band, low, high, key, s in zip(*(batch.column(i).to_numpy() for i in range(4)), batch.column(4)):
                if (band, low, high) != cell:
                    if len(keys) > 1:
                        yield table(keys, sets)
                    cell, keys, sets = (band, low, high), [], []
                keys.append(key)
                sets.append(s.values.to_numpy().copy())
        if len(keys) > 1:
            yield table(keys, sets)

    return run


def cells(shared: DataFrame, cell_shingles: int) -> DataFrame:
    """Rows (band, low, high, key): who is compared with whom, from distinct (band, key, n).

    A band of up to ``cell_shingles`` shingles is one cell.  A larger one is cut into
    chunks by the key, and every two chunks meet in a cell: any two sets of a band are
    in one cell, and no cell grows with the band."""
    total = shared.groupBy("band").agg(F.ceil(F.sum("n") / cell_shingles).alias("chunks"))
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks"))
    cut = shared.join(total, "band").select("band", "key", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return cut.select("band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "key")


def repeated_passages(docs: DataFrame, k: int = 5, sim: float = 0.8, recall: float = 0.995, min_words: int = 20, cell_shingles: int = 1 << 19) -> DataFrame:
    """Removals (doc_id, begin, end in words, n_paragraphs, kept_in: the documents that keep the text)."""
    scratch = Scratch(docs.sparkSession, "paragraphs")
    bands, rows = tune(sim, recall)
    least = math.ceil(sim / (1 - sim) - 1e-9)
    base = project(docs, doc="doc_id", text="text").withColumn("doc", F.col("doc").cast("long")).where("doc is not null and text is not null")
    schema = "key long, doc long, no long, begin long, end long, n long, bands array<long>"
    found = scratch.write(base.mapInArrow(_find(k, bands, rows, least), schema), "found")
    # 2: bands that several classes share
    sent = found.where("size(bands) > 0").select(F.explode("bands").alias("band"), "key", "n")
    hit = sent.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("band")
    hit = scratch.write(hit, "hit")  # few; Spark measures them before it chooses the join
    shared = scratch.write(sent.join(hit, "band", "left_semi").distinct(), "shared")
    del sent, hit  # plans that are still referenced keep their shuffle files
    scratch.release()
    # 3: one place of each class in them is read again
    wanted = found.where("size(bands) > 0").join(shared.select("key").distinct(), "key", "left_semi")
    wanted = wanted.groupBy("key").agg(F.min(F.struct("doc", "no", "begin", "end")).alias("at")).select("key", "at.*")
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "begin", "end")).alias("asked"))
    sets = base.join(asked, "doc").select("text", "asked").mapInArrow(_read_sets(k), "key long, shingles array<long>")
    sets = scratch.write(sets.dropDuplicates(["key"]), "sets")
    del wanted, asked
    scratch.release()
    grouped = cells(shared, cell_shingles).join(sets, "key").select("band", "low", "high", "key", "shingles")
    grouped = grouped.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    links = scratch.write(grouped.mapInArrow(_verify(sim), "a long, b long").distinct(), "links")
    del shared, sets, grouped
    for name in ("hit", "shared", "sets"):
        scratch.drop(name)
    scratch.release()
    # 4: classes with several places, or with a link
    comp = connected_components(links, scratch).withColumnRenamed("node", "key")
    ends = [F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.min("no").alias("least_no"), F.max("no").alias("most_no")]
    classes = found.groupBy("key").agg(*ends).join(comp, "key", "left")
    classes = classes.where("component is not null or first_doc <> last_doc or least_no <> most_no").select("key", "component", "first_doc")
    classes = scratch.write(classes, "classes")
    del comp, links
    scratch.release()
    joined = classes.where("component is not null")
    joined = joined.join(joined.groupBy("component").agg(F.min("first_doc").alias("keeper")), "component").select("key", "component", "keeper")
    alone = classes.where("component is null").select("key", F.col("key").alias("component"), F.col("first_doc").alias("keeper"))
    places = found.select("key", "doc", "no", "begin", "end").join(alone.union(joined), "key")
    # by document from here: the component's first place in the document that keeps it stays
    places = places.select("doc", "no", "begin", "end", "component", "keeper").repartition("doc").distinct()
    nth = F.dense_rank().over(W.partitionBy("doc", "component").orderBy("no"))
    marked = places.withColumn("nth", nth).where("doc <> keeper or nth > 1")
    marked = marked.groupBy("doc", "no", "begin", "end").agg(F.min("keeper").alias("keeper"))
    island = F.col("no") - F.row_number().over(W.partitionBy("doc").orderBy("no", "end"))
    runs = marked.withColumn("island", island).groupBy("doc", "island")
    runs = runs.agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_paragraphs"), F.array_sort(F.collect_set("keeper")).alias("kept_in"))
    return runs.where(F.col("end") - F.col("begin") >= min_words).select(F.col("doc").alias("doc_id"), "begin", "end", "n_paragraphs", "kept_in")


def op5_paragraphs(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
