"""Language identification by cross-parsing entropy (2).

For each language a suffix automaton of labelled text is built.  A text is
parsed against it: each phrase is the longest match that starts where the last
one ended.  The parse is a walk from the root that starts again where no edge
leads on, because the automaton accepts every substring of its text.  With c
phrases of a text of n characters and N training characters, c * log2(N) / n
estimates the cross-entropy; the language with the least of it wins.

The training text is a bounded sample: documents in hash order up to
``sample_chars`` characters a language, however many documents that takes, from
rows with a language that are not held out.  Every letter of the sample has a class
of its own in all automata; the commonest have a column in the table of edges, the
others are looked up in a sorted list.  Predictions use the text only, and all of it: texts are cut into
segments of ``SEGMENT`` characters, all parsed side by side, each from a fresh
phrase.  Language, source and id are never inputs of a prediction.

Repeated rows are predicted each, and learned from each.  An empty table gives an
empty result.  Columns named ``lang_pred`` and ``lang_score`` are replaced.

Null text, or text without a letter, is ``und`` with score 0.  Without any
training row every text is ``und``.  Ties go to the first language by name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import project, read_table

SEGMENT = 256
_MAX_CODE = 0x110000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, sample_chars: int, seed: int = 42) -> dict[str, str]:
    """At most ``sample_chars`` characters a language, in hash order of the documents; the bound holds on the driver too."""
    rows = project(docs, doc_id="doc_id", text="text", lang="lang")
    rows = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)
    # level: binary digits of the hash, so each level holds half of the documents above it
    rows = rows.select("lang", "doc_id", h.alias("h"), F.length(F.bin(h)).alias("level"), F.substring("text", 1, sample_chars).alias("text"))
    rows = rows.withColumn("n", F.length("text"))
    chars: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", "level").agg(F.sum("n").alias("n")).collect():  # at most 64 rows a language
        chars.setdefault(r["lang"], {})[r["level"]] = r["n"]
    enough = []
    for lang, by_level in chars.items():
        total = 0
        for level in sorted(by_level):
            total += by_level[level]
            if total >= sample_chars:
                break
        enough.append((lang, level))
    if not enough:
        return {}
    # the lowest levels that hold the sample: about twice its size, however large the corpus
    limits = docs.sparkSession.createDataFrame(enough, "lang string, most int")
    rows = rows.join(F.broadcast(limits), "lang").where("level <= most")
    order = W.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    run = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", run).where(F.col("before") < sample_chars)
    rows = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("before", "rank", "text"))).alias("parts"))
    return {r["lang"]: "\x00".join(p["text"] for p in r["parts"])[:sample_chars] for r in rows.collect()}


class Edges(NamedTuple):
    """Edges of an automaton: a flat table (states, width) of the classes below ``width``, 0 for none, and the others sorted by state and class."""

    table: np.ndarray
    rare: np.ndarray  # state * _MAX_CODE + class
    rare_to: np.ndarray

    def go(self, state: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
        common = c < width
        to = self.table[state * width + np.where(common, c, 0)]
        if not common.all():
            at = np.flatnonzero(~common)
            want = state[at] * _MAX_CODE + c[at]
            found = np.minimum(np.searchsorted(self.rare, want), max(0, len(self.rare) - 1))
            to[at] = np.where(self.rare[found] == want, self.rare_to[found], 0) if len(self.rare) else 0
        return to


def automaton(text: list[int], width: int, stop: int) -> Edges:
    """The suffix automaton: all substrings; state 0: no edge, the root is state 1.

    ``stop`` parts the documents: no edge carries it, so no match crosses it.
    """
    nxt: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text:
        if c == stop:
            last = 1
            continue
        p = last
        q = nxt[p].get(c)
        if q is not None and length[q] == length[p] + 1:
            last = q  # known from an earlier document
            continue
        cur = None
        if q is None:
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if not p:
                link[cur] = 1
                last = cur
                continue
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
                last = cur
                continue
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        if cur is None:
            last = clone
        else:
            link[cur] = clone
            last = cur
    table = np.zeros((len(nxt), width), dtype=np.int32)
    rare = []
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            if c < width:
                table[s, c] = t
            else:
                rare.append((s * _MAX_CODE + c, t))
    rare.sort()
    return Edges(table.ravel(), np.array([k for k, _ in rare], dtype=np.int64), np.array([t for _, t in rare], dtype=np.int32))


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...], width: int):
    """Character classes and one automaton a language, made once a Python worker."""
    counts = Counter(ch for _, t in samples for ch in t.lower() if ch.isalpha())
    classes = np.zeros(_MAX_CODE, dtype=np.int32)  # 0: no edge of any automaton carries it
    letter = np.fromiter((chr(i).isalpha() for i in range(_MAX_CODE)), dtype=bool, count=_MAX_CODE)
    classes[~letter] = 1  # everything but letters is one class
    stop = width - 1
    for i, (ch, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        classes[ord(ch)] = i + 2 if i + 2 < stop else i + 3
    tables, sizes = [], []
    for _, text in samples:
        low = text.lower()
        codes = classes[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")].tolist()
        codes = [stop if ch == "\x00" else c for ch, c in zip(low, codes)]
        tables.append(automaton(codes, width, stop))
        sizes.append(max(2, len(codes)))
    return classes, letter, tables, sizes


def suffix_automaton(text: list[int], width: int, stop: int) -> np.ndarray:
    """The table (states, width) alone, for alphabets that fit it."""
    return automaton(text, width, stop).table.reshape(-1, width)


def count_phrases(codes: np.ndarray, edges: Edges | np.ndarray, width: int) -> np.ndarray:
    """Phrases of each row of a (characters, segments) matrix; -1 pads the ends.  ``edges`` may be a flat table alone."""
    if isinstance(edges, np.ndarray):
        edges = Edges(edges, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
    n = codes.shape[1]
    # state 0 has no edges: before the first character, and behind one that no edge carries, a phrase begins
    state, phrases = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
    root = np.ones(n, dtype=np.int64)
    for row in codes:
        on = row >= 0
        c = np.where(on, row, 0)
        to = edges.go(state, c, width)
        miss = (to == 0) & on
        phrases += miss
        again = edges.go(root, c, width)
        to = np.where(miss, again, to)
        state = np.where(on, to, state)
    return phrases


def _segments(texts: list[str], classes: np.ndarray, letter: np.ndarray):
    """The characters of all texts as (SEGMENT, n) classes, the text of each segment, lengths and letters."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    has = np.add.reduceat(np.append(letter[joined], False), starts) if len(texts) else np.zeros(0)
    has = np.where(lengths > 0, has, 0)
    per = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), per)
    first = np.cumsum(per) - per
    within = np.arange(len(owner)) - np.repeat(first, per)
    begin = starts[owner] + within * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
    at = begin[None, :] + np.arange(SEGMENT)[:, None]
    inside = np.arange(SEGMENT)[:, None] < size[None, :]
    codes = np.where(inside, classes[joined[np.minimum(at, max(0, len(joined) - 1))]] if len(joined) else 0, -1)
    return codes.astype(np.int32), owner, lengths, has


def parse_texts(texts: list[str], samples: tuple[tuple[str, str], ...], width: int = 64, block_chars: int = 1 << 20) -> list[tuple[str, float]]:
    """(language, score) of each text; texts are taken in blocks of about ``block_chars`` characters."""
    if not samples:
        return [("und", 0.0)] * len(texts)
    classes, letter, tables, sizes = _model(samples, width)
    out: list[tuple[str, float]] = []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= block_chars):
            chars += len(texts[end])
            end += 1
        low = [t.lower() for t in texts[at:end]]
        codes, owner, lengths, has = _segments(low, classes, letter)
        cost = np.zeros((len(tables), len(low)))
        for k, table in enumerate(tables):
            if len(owner):
                cost[k] = np.bincount(owner, weights=count_phrases(codes, table, width), minlength=len(low)) * math.log2(sizes[k])
        best = cost.argmin(axis=0)
        for i in range(len(low)):
            if not has[i]:
                out.append(("und", 0.0))
                continue
            own = np.sort(cost[:, i])
            second = own[1] if len(own) > 1 else 2 * own[0]
            out.append((samples[best[i]][0], float(second / (own[0] + second)) if second else 0.0))
        at = end
    return out


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score``."""
    model = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))  # bounded by sample_chars a language

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = parse_texts([t if t is not None else "" for t in s], model.value)
            yield pd.DataFrame(got, columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "lang_score").withColumn("__p", predict("text")).withColumns({"lang_pred": F.col("__p.lang_pred"), "lang_score": F.col("__p.score")}).drop("__p")


def op2_langid(spark, sf_dir: str, sample_chars: int = 32_768) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(project(docs, doc_id="doc_id", text="text"), training_sample(docs, sample_chars))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
