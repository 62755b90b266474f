"""A training-corpus pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` writes each stage's rows to the shared folder and
reads them again for the next one.  All stages but the last return the columns of
``documents``; the last returns them with the shard, epoch and order of each copy.
Nulls, empty texts, repeated rows and extra columns are handled as the operators
in ``shroud.llm`` say; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.llm.common import Scratch, read_table
from shroud.llm.decontam import clean
from shroud.llm.mixing import mix
from shroud.llm.quality import keep_target
from shroud.llm.secrets import scan_secrets
from shroud.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling does not draw go (4)."""
    return keep_target(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (10)."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go (1)."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in any layer is replaced by a mark; all documents stay (8)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = scan_secrets(rows, F.col("doc.text"))
    hit = F.col("secrets.redacted").isNotNull()
    out = F.col("doc").withField("text", F.when(hit, F.col("secrets.redacted")).otherwise(F.col("doc.text")))
    if "n_chars" in docs.columns:
        n = F.length("secrets.redacted").cast(docs.schema["n_chars"].dataType)
        out = out.withField("n_chars", F.when(hit, n).otherwise(F.col("doc.n_chars")))
    return found.select(out.alias("doc")).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, dealt to shards (9)."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]

#: no SQL expresses these stages; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
