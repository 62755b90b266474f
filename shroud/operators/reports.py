"""Reports (R01-R05): counts over span tables, routes and manifests.

Every aggregate is a ``groupBy`` with partial (map-side) aggregation, so a
hot type or route is pre-aggregated per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.functions.spans import explode_nonempty
from shroud.operators.resolve import priority_sql


def entities_per_document(df: DataFrame, id_col: str = "doc_id", spans_col: str = "spans") -> DataFrame:
    """Number of entities kept per document (0 included)."""
    return df.select(id_col, F.size(spans_col).cast("long").alias("n_entities"))


def entities_by_type(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Per entity type -- spans, documents, mean score.

    Each row first counts its own spans by type, so no document key reaches the
    shuffle and a type is one partial row per task."""
    t, x = "ebt", "ebx"
    own = f"filter(`{spans_col}`, {x} -> {x}.entity_type = {t})"
    per_doc = (f"transform(array_distinct(transform(`{spans_col}`, {x} -> {x}.entity_type)), {t} -> named_struct("
               f"'entity_type', {t}, 'n', size({own}), "
               f"'score', aggregate({own}, CAST(0 AS decimal(38, 10)), (eba, {x}) -> CAST(eba + CAST({x}.score AS decimal(20, 10)) AS decimal(38, 10)))))")
    rows = explode_nonempty(df, [], F.expr(per_doc), alias="r").select("r.*")
    n = F.sum(F.col("n").cast("long"))
    return rows.groupBy("entity_type").agg(
        n.alias("n_spans"),
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.sum("score").cast("double") / n, 6).alias("avg_score"),
    )


def overlap_report(df: DataFrame, raw_col: str = "spans_raw", id_col: str = "doc_id") -> DataFrame:
    """Every thresholded span is 'kept' or 'skipped'; a skipped span
    names the first accepted span (in resolution order) that blocked it.
    Counted by (outcome, entity_type, blocked_by)."""
    from shroud.operators.resolve import greedy_sql, resolution_order_sql

    accepted = resolution_order_sql(greedy_sql(f"`{raw_col}`"))
    x, a, b = "orx", "ora", "orb"
    blocker = (f"element_at(filter(_acc, {a} -> NOT ({x}.`end` <= {a}.start OR {x}.start >= {a}.`end`) "
               f"AND NOT ({a}.entity_type = {x}.entity_type AND {a}.start = {x}.start AND {a}.`end` = {x}.`end`)), 1)")
    kept = f"exists(_acc, {b} -> {b}.entity_type = {x}.entity_type AND {b}.start = {x}.start AND {b}.`end` = {x}.`end`)"
    rows = (f"transform(`{raw_col}`, {x} -> named_struct('outcome', CASE WHEN {kept} THEN 'kept' ELSE 'skipped' END, "
            f"'entity_type', {x}.entity_type, 'blocked_by', CASE WHEN {kept} THEN NULL ELSE {blocker}.entity_type END))")
    per_doc = df.select(id_col, raw_col).withColumn("_acc", F.expr(accepted))
    out = explode_nonempty(per_doc, [], F.expr(rows), alias="r").select("r.*")
    return out.groupBy("outcome", "entity_type", "blocked_by").agg(F.count(F.lit(1)).alias("n"))


def route_counts(routed: DataFrame) -> DataFrame:
    """Spans per route (cached / local / model / kept / fallback)."""
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def run_summary(manifest: DataFrame) -> DataFrame:
    """Files by type and status."""
    return manifest.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["entities_per_document", "entities_by_type", "overlap_report", "route_counts", "run_summary", "priority_sql"]
