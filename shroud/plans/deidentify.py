"""End-to-end plans.

Default path (no stored mapping): detection, resolution, value generation
and splicing are one projection over the document table -- a map-only job
whose cost grows linearly with the input and has no shuffle.  With a stored
mapping, the detected table is written once to the shared folder; the distinct
span keys of its documents (never the text) are joined with the mapping, and
only documents that have spans meet them again on the document key.

``extra_spans`` names an ``array<span>`` column of names (D48, D49).
``salt`` must be given: without a secret, anyone can recompute which value
stands for a known datum.  Tests pass an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.catalog import DEFAULT_THRESHOLD, HANDLER_THRESHOLD, default_rules
from shroud.functions.fakes import SPARK, map_key_sql
from shroud.functions.spans import empty_spans_sql, explode_nonempty, scan_sql
from shroud.functions.trigger import low_rules, trigger_sql
from shroud.operators.detect import (
    TRIGGER_COL,
    all_ends_sql,
    all_first_sql,
    all_pairs_sql,
    all_pieces_sql,
    any_first_sql,
    any_match_sql,
    detect,
    raw_spans_sql,
    span_steps,
    with_trigger,
)
from shroud.operators.mapping import (
    MODEL_TIME_LIMIT,
    MappingStore,
    build_model_batches,
    join_mapping,
    model_generate,
    model_values,
    new_pairs,
)
from shroud.operators.replace import (
    REPL_DDL,
    apply_spans_sql,
    length_preserving_sql,
    route_sql,
    span_fields,
    with_fakes_sql,
)
from shroud.session import checkpoint_dir


def detect_documents(df: DataFrame, text_col: str = "text", rules=None, threshold: float = DEFAULT_THRESHOLD,
                     entity_types=None, out: str = "spans", extra_spans: str | None = None) -> DataFrame:
    """D* (and names) -> C01 -> C02 -> O01 (all languages)."""
    return detect(df, text_col, rules, out=out, threshold=threshold, resolve=True, entity_types=entity_types,
                  extra_spans=extra_spans)


def deidentify(df: DataFrame, text_col: str = "text", id_col="doc_id", rules=None,
               threshold: float = HANDLER_THRESHOLD, entity_types=None, *, salt: str,
               mapping: DataFrame | MappingStore | None = None, out: str = "text_deid", extra_spans: str | None = None) -> DataFrame:
    """Whole-text de-identification.  Adds ``spans`` (with fake_value
    and route) and ``text_deid``; C03 ``entity_types`` limits what is
    replaced.  ``id_col`` (name or list of names) must identify a row; it
    is only used to fold stored-mapping values back."""
    d = detect_documents(df, text_col, rules, threshold, entity_types, extra_spans=extra_spans)
    d = d.withColumn("spans", F.expr(with_fakes_sql("spans", salt=salt)).cast(REPL_DDL))
    if mapping is not None:
        d = _apply_mapping(d, mapping, id_col)
    return d.withColumn(out, F.expr(apply_spans_sql(f"`{text_col}`", "spans", ordered=True)))


def written(d: DataFrame, name: str = "detected") -> DataFrame:
    """``d`` written once to the shared folder, so that all branches read it."""
    path = f"{checkpoint_dir(d.sparkSession)}/shroud-{name}-{uuid.uuid4().hex}"
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def _apply_mapping(d: DataFrame, mapping: DataFrame | MappingStore, id_col, spans: str = "spans") -> DataFrame:
    """Values of the stored mapping replace generated ones (``id_col``: the columns that identify a row).

    The key of a span is joined once per document and key, and rows without a
    span go past the join."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    d = written(d)
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    key = F.expr(f"transform(`{spans}`, kx -> {map_key_sql(SPARK, 'kx.entity_type', 'kx.raw_txt')})")
    hit, rest = d.where(some), d.where(~some)
    keys = explode_nonempty(hit.select(*ids, F.array_distinct(key).alias("_keys")), ids, "_keys", alias="map_key")
    found = join_mapping(keys, mapping).where("cached_value IS NOT NULL").groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("map_key", "cached_value"))).alias("_cached"))
    hit = hit.join(found, ids, "left")
    x = "mpx"
    cached = f"try_element_at(_cached, {map_key_sql(SPARK, f'{x}.entity_type', f'{x}.raw_txt')})"
    merged = (f"transform(`{spans}`, {x} -> named_struct({span_fields(x)}, "
              f"'fake_value', coalesce({cached}, {x}.fake_value), "
              f"'route', CASE WHEN {cached} IS NOT NULL THEN 'cached' ELSE {x}.route END))")
    hit = hit.withColumn(spans, F.expr(merged)).drop("_cached").select(*d.columns)
    return hit.unionByName(rest)


def _line_spans(df: DataFrame, text_col: str, rules, threshold: float, entity_types) -> DataFrame:
    """``_lines``: segments as structs (t = text, sp = resolved spans), or NULL when no rule
    matches anywhere in the document (then no segment can match either, see ``any_match_sql``)."""
    rules = tuple(default_rules() if rules is None else rules)
    text, z = f"`{text_col}`", "lsz"
    low = low_rules(rules, threshold)
    d = with_trigger(df, text_col, rules)
    lines = (f"CASE WHEN {text} IS NULL OR NOT {any_match_sql(text, rules, TRIGGER_COL)} THEN NULL ELSE "
             f"transform(split({text}, '\\n', -1), {z} -> named_struct('t', {z}, 'g', {trigger_sql(z, rules, low=low)})) END")
    d = d.withColumn("_lines", F.expr(lines)).drop(TRIGGER_COL)

    def step(frame: DataFrame, **fields: str) -> DataFrame:
        named = ", ".join(f"'{k}', {v}" for k, v in {"t": f"{z}.t", **fields}.items())
        return frame.withColumn("_lines", F.expr(f"transform(_lines, {z} -> named_struct({named}))"))

    d = step(d, g=f"{z}.g", f=all_first_sql(f"{z}.t", rules, f"{z}.g", low))
    d = step(d, p=all_pairs_sql(f"{z}.t", rules, f"{z}.g", f"{z}.f"), w=all_pieces_sql(f"{z}.t", f"{z}.f"), f=any_first_sql(f"{z}.f"))
    d = step(d, p=all_ends_sql(f"{z}.p", rules), w=f"{z}.w", f=f"{z}.f")
    d = step(d, sp=f"CASE WHEN {z}.f THEN {raw_spans_sql(f'{z}.p', f'{z}.w', rules)} ELSE {empty_spans_sql()} END")
    for nxt in span_steps(threshold, resolve=True, entity_types=entity_types):
        d = step(d, sp=f"CASE WHEN size({z}.sp) = 0 THEN {z}.sp ELSE {nxt(f'{z}.sp')} END")
    return d


def deidentify_segments(df: DataFrame, text_col: str = "text", rules=None, threshold: float = HANDLER_THRESHOLD,
                        entity_types=None, *, salt: str, out: str = "text_deid", mapping: DataFrame | MappingStore | None = None,
                        id_col="doc_id") -> DataFrame:
    """Per newline-separated segment (no match crosses a segment),
    blank segments untouched, reassembled in order.  Runs inside the row
    (``transform`` over the segments): no explode, no regroup, no shuffle.
    With a stored mapping, one mapping holds for all segments (see L01)."""
    d = _line_spans(df, text_col, rules, threshold, entity_types)
    z = "sgz"
    blank = f"regexp_replace({z}.t, '(?U)^\\\\s+|\\\\s+$', '') = ''"
    fakes = with_fakes_sql(f"{z}.sp", salt=salt, v="sg")
    lines = (f"transform(_lines, {z} -> named_struct('t', {z}.t, 'sp', CASE WHEN size({z}.sp) = 0 OR {blank} THEN "
             f"CAST(array() AS {REPL_DDL}) ELSE CAST({fakes} AS {REPL_DDL}) END))")
    d = d.withColumn("_lines", F.expr(lines))
    if mapping is not None:
        d = _map_lines(d, mapping, id_col)
    w = "sgw"
    body = apply_spans_sql(f"{w}.t", f"{w}.sp", v="sa", ordered=True)
    joined = f"CASE WHEN _lines IS NULL THEN `{text_col}` ELSE array_join(transform(_lines, {w} -> {body}), '\\n') END"
    return d.withColumn(out, F.expr(joined)).drop("_lines")


def _map_lines(d: DataFrame, mapping: DataFrame | MappingStore, id_col) -> DataFrame:
    """Stored values for the spans of every line: the lines' spans are mapped as one list, of which each line takes its stretch."""
    columns = d.columns
    flat = "flatten(transform(_lines, ml -> ml.sp))"
    ends = scan_sql("transform(_lines, ml -> size(ml.sp))", "mel + mer", "0", "me")
    d = d.withColumns({"_mapped": F.expr(f"CAST(coalesce({flat}, array()) AS {REPL_DDL})"), "_ends": F.expr(f"CASE WHEN _lines IS NOT NULL THEN {ends} END")})
    d = _apply_mapping(d, mapping, id_col, "_mapped")
    back = ("transform(_lines, (ml, mi) -> named_struct('t', ml.t, 'sp', CASE WHEN size(ml.sp) = 0 THEN ml.sp "
            "ELSE slice(_mapped, _ends[mi] - size(ml.sp) + 1, size(ml.sp)) END))")
    return d.withColumn("_lines", F.expr(back)).select(*columns)


def deidentify_layout(df: DataFrame, text_col: str = "text", rules=None, threshold: float = HANDLER_THRESHOLD,
                      *, salt: str, out: str = "text_deid") -> DataFrame:
    """Per line, tag-map generators, length preserving (A04): every
    output line has the length of its input line.  Lines and their spans
    are materialised first, so each later step reads a struct field."""
    d = _line_spans(df, text_col, rules, threshold, None)
    w = "lyw"
    body = apply_spans_sql(f"{w}.t", length_preserving_sql(f"{w}.sp", salt, v="ly"), v="la")
    joined = f"CASE WHEN _lines IS NULL THEN `{text_col}` ELSE array_join(transform(_lines, {w} -> {body}), '\\n') END"
    return d.withColumn(out, F.expr(joined)).drop("_lines")


def deidentify_html(pages: DataFrame, *, salt: str, **kw) -> DataFrame:
    """Pages are treated as plain text (the html column)."""
    return deidentify(pages, text_col="html", id_col="page_id", salt=salt, **kw)


def model_values_for(df: DataFrame, make_client: Callable, *, salt: str, mapping: DataFrame | MappingStore | None = None,
                     text_col: str = "text", rules=None, threshold: float = HANDLER_THRESHOLD,
                     extra_spans: str | None = None, time_limit: float | None = MODEL_TIME_LIMIT, ledger: str | None = None) -> DataFrame:
    """The model's values (map_key, entity_type, raw_txt, fake_value, route) for the spans of ``df`` that take the
    model route and are not in ``mapping``: L00 -> A10 -> A12 -> A11.  Write them once, e.g. with
    ``MappingStore.upsert(None, generated=...)``, and de-identify with the store."""
    found = detect_documents(df, text_col, rules, threshold, extra_spans=extra_spans)
    spans = explode_nonempty(found, [], "spans", alias="s").select("s.entity_type", "s.raw_txt")
    pairs = new_pairs(spans.where(F.expr(route_sql("entity_type")) == "model"), mapping)
    return model_values(model_generate(build_model_batches(pairs), make_client, time_limit, ledger))


def deidentify_with_model(df: DataFrame, store: MappingStore, make_client: Callable, *, salt: str, text_col: str = "text",
                          id_col="doc_id", rules=None, threshold: float = HANDLER_THRESHOLD,
                          extra_spans: str | None = None, time_limit: float | None = MODEL_TIME_LIMIT) -> DataFrame:
    """The model route end to end: the model's values for new data are stored (each batch is asked once), then L01
    runs with the store.  Items whose batch failed keep the generated default."""
    values = model_values_for(df, make_client, salt=salt, mapping=store.live(), text_col=text_col, rules=rules,
                              threshold=threshold, extra_spans=extra_spans, time_limit=time_limit)
    store.upsert(None, salt, generated=values)
    return deidentify(df, text_col, id_col, rules, threshold, salt=salt, mapping=store, extra_spans=extra_spans)


def with_status(df: DataFrame, text_col: str = "text", out_col: str = "text_deid") -> DataFrame:
    """Per-document status -- a row without text gets status 'error' and a
    message, the others 'ok'.  Rows that make a plan fail: see ``isolated``."""
    bad = F.col(text_col).isNull()
    return df.withColumn("status", F.when(bad, "error").otherwise("ok")).withColumn(
        "error", F.when(bad, F.lit("no text")).otherwise(F.lit(None).cast("string")))


ISOLATION_CELLS = 1 << 20
ISOLATION_WAYS = 8


def isolated(df: DataFrame, plan: Callable[[DataFrame], DataFrame], text_col: str = "text",
             max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``plan(df)`` without the rows that make it fail, and those rows with ``error``.

    The plan runs over all rows and writes its result.  Where it fails, the rows are cut
    in eight by a hash of theirs, which run side by side, and so on with those that fail:
    a guilty row is found in as many steps as the number of rows has octal digits (seven
    at most), each over an eighth of the rows of the one before.  Rows that a hash of
    twenty bits can't tell apart go together.  Every attempt plans anew, which takes seconds
    for the full catalog with its generators: give ``isolated`` the step that fails.  Texts longer than ``max_chars`` are not tried:
    what exhausts a task's stack or memory ends its executor and can't be caught.
    Only failures of the plan's tasks lead to cutting; an error in the plan itself is raised."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/shroud-isolated-{uuid.uuid4().hex}"
    cell = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(ISOLATION_CELLS))
    df.withColumn("_cell", cell).write.parquet(f"{base}/in")
    rows = spark.read.parquet(f"{base}/in")
    schema = plan(df).schema
    guilty: list[DataFrame] = []
    if max_chars is not None:
        long = F.coalesce(F.length(f"`{text_col}`") > max_chars, F.lit(False))
        guilty.append(rows.where(long).withColumn("error", F.lit(f"text of more than {max_chars} characters")))
        rows = rows.where(~long)
    done: list[str] = []

    def attempt(cells: tuple[int, int]) -> list[tuple[int, int]]:
        """Run the plan over a range of cells; the smaller ranges to try where it fails."""
        lo, hi = cells
        part, out = rows.where(F.col("_cell").between(lo, hi - 1)), f"{base}/out/{lo}-{hi}"
        try:
            plan(part.drop("_cell")).write.mode("overwrite").parquet(out)
            done.append(out)
            return []
        except AnalysisException:
            raise
        except Exception as exc:  # Spark names the failure of a task in several classes
            first, last = part.agg(F.min("_cell"), F.max("_cell")).first()
            if first == last:
                guilty.append(part.withColumn("error", F.lit(f"{type(exc).__name__}: {exc}"[:500])))
                return []
            step = -(-(last + 1 - first) // ISOLATION_WAYS)
            return [(k, min(k + step, last + 1)) for k in range(first, last + 1, step)]

    todo = [(0, ISOLATION_CELLS)]
    with ThreadPoolExecutor(ISOLATION_WAYS) as pool:
        while todo:
            todo = [cells for found in pool.map(attempt, todo) for cells in found]
    good = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    bad = rows.where("false").withColumn("error", F.lit(None).cast("string"))
    for part in guilty:
        bad = bad.unionByName(part)
    return good, bad.drop("_cell")


__all__ = ["detect_documents", "deidentify", "deidentify_segments", "deidentify_layout", "deidentify_html",
           "model_values_for", "deidentify_with_model", "with_status", "isolated", "written", "route_sql"]
