"""Quality classifier by importance resampling (4).

Hashed n-gram generative models (word and punctuation tokens, unigrams and
bigrams in ``buckets`` hash buckets) give each document a log importance weight,
the log ratio of target to raw text; Gumbel top-k samples the documents to keep.

* Target: labelled rows of quality 1 that are not toxic.  Raw text that is not
  wanted is labelled too, in two kinds: toxic, and quality 0.  Each kind has its
  own model and the weight of a document is its least ratio over the kinds: with
  one pooled raw model the many ordinary words of a toxic text outweigh the few
  that mark it.  All three models are smoothed by the n-gram counts of the whole
  corpus.  A bucket counts only where target and kind differ by ``min_z``
  standard errors; elsewhere the ratio is 1.
* Labelled rows: at most ``sample_rows`` a kind, in hash order (the bound of what
  is broadcast, of the fit and of the one task that counts a kind).  An n-gram is
  counted once per context of four tokens, so copies of one text do not pass for
  evidence.  Corpus counts and scores cover every document.
* The limit ``tau`` <= 0 gives the best balanced accuracy on those rows.  k is
  the number of documents at or above it.  Keys are (weight - tau) / temperature
  plus a Gumbel variate hashed from the id; the k largest are kept, found by
  radix selection over counts, so no global sort is needed.

A token equal to the one before it forms the same bigram whatever the word, so
that repetition shows.  Null and empty texts, and texts without a token, have
weight 0 and stand with neutral text.  Without labelled rows of the target or of
a kind, that kind has ratio 1.  Repeated rows share a key and stand or fall
together (so the sample may exceed k by ties).  Null ids are hashed as null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, project, read_table

TOKEN = re.compile(r"\w+|[^\w\s]")
KINDS = ("toxic", "junk")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CONTEXT_BITS = 26


class _Hashes(dict):
    """token -> hash; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def token_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    return np.array(list(map(hashes.__getitem__, TOKEN.findall((text or "").lower()))), dtype=np.uint64)


def ngram_buckets(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and of the bigrams (one fewer) of a text's token hashes."""
    with np.errstate(over="ignore"):
        uni = (h * _MIX) >> np.uint64(40)
        pair = np.where(h[1:] == h[:-1], np.uint64(1), h[:-1] * np.uint64(31) + h[1:] + np.uint64(7))
        bi = (pair * _MIX) >> np.uint64(40)
    return (uni % np.uint64(buckets)).astype(np.int64), (bi % np.uint64(buckets)).astype(np.int64)


def contexts(h: np.ndarray) -> np.ndarray:
    """A hash of each token with up to three before it, of ``_CONTEXT_BITS`` bits."""
    out = h.copy()
    with np.errstate(over="ignore"):
        for j in range(1, min(4, len(h))):
            out[j:] = out[j:] * _MIX + h[:-j]
        return (out * _MIX) >> np.uint64(64 - _CONTEXT_BITS)


def corpus_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all n-grams of the column ``text``; each task adds up before it sends."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(buckets, dtype=np.int64), _Hashes()
        for pdf in batches:
            held, size = [], 0
            for text in pdf["text"]:
                held += ngram_buckets(token_hashes(text, hashes), buckets)
                size += len(held[-1])
                if size > 1 << 18:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return texts.select("text").mapInPandas(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def kind_counts(sample: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, n) of the bounded sample (kind, text): n-grams counted once per context."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, np.ndarray] = {}
        hashes = _Hashes()
        for pdf in batches:
            for kind, text in zip(pdf["kind"], pdf["text"]):
                if kind not in total:
                    total[kind], seen[kind] = np.zeros(buckets, dtype=np.int64), np.zeros(1 << _CONTEXT_BITS, dtype=bool)
                h = token_hashes(text, hashes)
                if not len(h):
                    continue
                at = contexts(h)
                new = ~seen[kind][at]
                seen[kind][at] = True
                uni, bi = ngram_buckets(h, buckets)
                np.add.at(total[kind], uni[new], 1)
                np.add.at(total[kind], bi[new[1:]], 1)
        for kind, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"kind": kind, "bucket": at, "n": own[at]})

    rows = sample.select("kind", "text", F.xxhash64("text").alias("h")).repartition("kind").sortWithinPartitions("kind", "h")  # reruns agree
    return rows.mapInPandas(add, "kind string, bucket long, n long")


def labelled_kinds(labels: DataFrame, sample_rows: int, seed: int = 42) -> DataFrame:
    """(doc_id, kind) with at most ``sample_rows`` rows a kind; rows with a null flag are not used."""
    rows = project(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null and quality is not null and toxic is not null")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "target")
    rows = rows.select("doc_id", kind.alias("kind")).where("kind is not null")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy("h", "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("doc_id", "kind").distinct()


def log_ratios(counts: DataFrame, corpus: DataFrame, buckets: int, coarse: int, prior: float, min_z: float) -> np.ndarray:
    """(kinds, buckets) log target / raw; only buckets with evidence reach the driver.

    ``corpus`` counts the low bits of the same hashes in ``coarse`` buckets; a
    bucket's background is its share of them."""
    out = np.zeros((len(KINDS), buckets), dtype=np.float64)
    total = {r["kind"]: float(r["n"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kinds = [k for k in KINDS if total.get(k)]
    if not total.get("target") or not kinds:
        return out
    everything = float(corpus.agg(F.sum("n")).first()[0] or 0)
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in ("target", *kinds)])
    wide = wide.withColumn("low", F.col("bucket") % coarse).join(corpus.select(F.col("bucket").alias("low"), F.col("n").alias("all")), "low", "left")
    share = (F.coalesce("all", F.lit(0)) + 1) / F.lit(everything + coarse) * F.lit(coarse)  # of an even spread
    smooth = lambda k: F.log((F.col(k) + prior * share) / F.lit(total[k] + prior * buckets))
    rows = []
    for k in kinds:
        nt, nk = total["target"], total[k]
        pooled = (F.col("target") + F.col(k)) / (nt + nk)
        error = F.sqrt(pooled * (1 - pooled) * F.lit(1 / nt + 1 / nk))
        z = F.abs(F.col("target") / nt - F.col(k) / nk) / F.greatest(error, F.lit(1e-300))
        rows.append(F.struct(F.lit(KINDS.index(k)).alias("kind"), z.alias("z"), (smooth("target") - smooth(k)).alias("ratio")))
    found = wide.select("bucket", F.explode(F.array(*rows)).alias("r")).select("bucket", "r.*").where(F.col("z") >= min_z)
    for r in found.collect():
        out[r["kind"], r["bucket"]] = r["ratio"]
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``log_weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # kinds x buckets numbers

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hashes = shared.value, _Hashes()
        for s in batches:
            out = []
            for text in s:
                b = np.concatenate(ngram_buckets(token_hashes(text, hashes), w.shape[1]))
                out.append(float(min(row[b].sum() for row in w)))
            yield pd.Series(out, dtype=float)

    return docs.drop("log_weight").withColumn("log_weight", weigh("text"))


def choose_limit(scored: DataFrame) -> float:
    """tau <= 0 of the best balanced accuracy on rows (kind, log_weight); one row per half unit reaches the driver."""
    step = 0.25
    bins = scored.select("kind", F.greatest(F.lit(-200), F.least(F.lit(0), F.floor(F.col("log_weight") / step))).alias("bin"))
    got = bins.groupBy("kind", "bin").agg(F.count("*").alias("n")).collect()
    totals = {k: sum(r["n"] for r in got if r["kind"] == k) for k in ("target", *KINDS)}
    if not totals["target"] or not sum(totals[k] for k in KINDS):
        return 0.0
    best = (-1.0, 0.0)
    for cut in range(-200, 1):
        kept = sum(r["n"] for r in got if r["kind"] == "target" and r["bin"] >= cut) / totals["target"]
        gone = [sum(r["n"] for r in got if r["kind"] == k and r["bin"] < cut) / totals[k] for k in KINDS if totals[k]]
        # one half for what is kept, one half for what goes; the higher limit on ties
        best = max(best, (kept + sum(gone) / len(gone), cut * step))
    return best[1]


def _sortable(key: Column) -> Column:
    """A non-negative long that orders as the double ``key`` does, in steps of 2**-20."""
    bound = 2.0**42
    return F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), key)) * F.lit(2.0**20)).cast("long") + F.lit(1 << 62)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs ``key`` (0 <= key < 2**63) by radix selection, 13 bits a round."""
    if k <= 0:
        return None
    prefix, shift = 0, 63
    while shift > 0:
        width = min(13, shift)
        shift -= width
        rows = keys if shift + width == 63 else keys.where(F.shiftrightunsigned("key", shift + width) == F.lit(prefix).cast("long"))
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        counts = {r["d"]: r["n"] for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= k:
                break
            k -= counts[d]
        prefix = prefix << width | d
    return prefix


@dataclass
class Sampler:
    """What decides about a document: model weights, limit, Gumbel temperature, and the k-th largest key."""

    weights: np.ndarray
    tau: float
    temperature: float
    seed: int
    least: int | None = None

    def key(self) -> Column:
        """The Gumbel key of a row with ``doc_id``, ``text_hash`` and ``log_weight``."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id", "text_hash"), 11)
        gumbel = -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)))
        return (F.col("log_weight") - self.tau) / self.temperature + gumbel

    def kept(self) -> Column:
        return F.lit(False) if self.least is None else _sortable(self.key()) >= F.lit(self.least)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 20, coarse: int = 1 << 16, sample_rows: int = 8_000, prior: float = 0.5, min_z: float = 6.0, temperature: float = 0.1, seed: int = 42) -> tuple[Sampler, DataFrame]:
    """The sampler, and (doc_id, text_hash, log_weight) of every document."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.write(labelled_kinds(labels, sample_rows, seed), "sample")
    slim = project(docs, doc_id="doc_id", text="text")
    shown = slim.join(F.broadcast(sample), "doc_id")  # sample_rows a kind
    corpus = scratch.write(corpus_counts(slim, coarse), "corpus")
    counts = scratch.write(kind_counts(shown, buckets), "kinds")
    weights = log_ratios(counts, corpus, buckets, coarse, prior, min_z)
    scores = scratch.write(score(slim, weights).select("doc_id", F.xxhash64("text").alias("text_hash"), "log_weight"), "scores")
    tau = choose_limit(scores.join(F.broadcast(sample), "doc_id"))
    sampler = Sampler(weights, tau, temperature, seed)
    k = scores.where(F.col("log_weight") >= tau).count()
    sampler.least = kth_largest(scores.select(_sortable(sampler.key()).alias("key")), k)
    return sampler, scores


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The sampled documents."""
    sampler, scores = fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.where(sampler.kept()).select("doc_id", "log_weight", sampler.key().alias("key"), F.lit(True).alias("kept"))


def keep_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their columns: a map-side filter, texts are not moved."""
    sampler, _ = fit(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    rows = score(rows, sampler.weights).withColumn("text_hash", F.xxhash64("text"))
    return rows.where(sampler.kept()).select("doc.*")
