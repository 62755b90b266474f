"""Conflict resolution and span de-duplication.

All of it runs inside a row on the document's own span array, so there is no
shuffle.  Spans are cut into chains that overlap, and only inside a chain is a
span compared with others: the work grows with the number of spans, not with its
square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.catalog import DEFAULT_PRIORITY, PRIORITY
from shroud.functions.spans import SPAN_DDL, empty_spans_sql, let_sql, scan_sql


def priority_sql(entity: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())
    return f"(CASE {entity} {arms} ELSE {DEFAULT_PRIORITY} END)"


#: up to so many spans are compared with each other, without chains
FEW = 16


def _sorted_sql(spans: str, keys, v: str) -> str:
    """The spans by ascending keys (SQL of the span ``{v}x``), equal ones as they stood.

    The keys go in front of each span, and structs are sorted by Spark's own ordering: a
    comparator is a lambda, evaluated node by node for each pair of spans."""
    return f"transform({_keyed_sql(spans, keys, v)}, {v}x -> {v}x.x)"


def _keyed_sql(spans: str, keys, v: str) -> str:
    """What :func:`_sorted_sql` sorts: the spans as the field ``x``."""
    x, i = f"{v}x", f"{v}i"
    named = ", ".join(f"'k{n}', {k}" for n, k in enumerate(keys))
    return f"sort_array(transform({spans}, ({x}, {i}) -> named_struct({named}, 'i', {i}, 'x', {x})))"


def _len(x: str) -> str:
    return f"({x}.`end` - {x}.start)"


def resolution_order_sql(spans: str, v: str = "ro") -> str:
    """(priority asc, score desc, start asc, longer first, type asc)."""
    return _sorted_sql(spans, _resolution_keys(f"{v}x"), v)


def _resolution_keys(x: str) -> tuple[str, ...]:
    return priority_sql(f"{x}.entity_type"), f"-{x}.score", f"{x}.start", f"-{_len(x)}", f"{x}.entity_type"


def _overlaps(x: str, a: str) -> str:
    # half-open intervals: touching spans do not overlap
    return f"({x}.`end` > {a}.start AND {x}.start < {a}.`end`)"


def clusters_sql(spans: str, v: str = "cl") -> str:
    """The spans cut into maximal chains of overlapping ones, in start order.

    Whether a span is kept depends only on spans that it overlaps, so every
    decision stays inside one chain; chains are short however many spans a
    document has."""
    s, m, k, i = f"{v}s", f"{v}m", f"{v}k", f"{v}i"
    ordered = order_spans_sql(spans, v=f"{v}o")
    reach = scan_sql(f"transform({s}, {v}e -> {v}e.`end`)", f"greatest({v}ml, {v}mr)", "0", f"{v}m")
    heads = f"filter(sequence(0, size({s}) - 1), {i} -> {i} = 0 OR {s}[{i}].start >= {m}a[greatest({i} - 1, 0)])"
    cut = (f"transform({k}, ({v}h, {v}n) -> slice({s}, {v}h + 1, "
           f"CASE WHEN {v}n + 1 < size({k}) THEN {k}[{v}n + 1] ELSE size({s}) END - {v}h))")
    body = let_sql(reach, f"{m}a", let_sql(heads, k, cut))
    return let_sql(ordered, s, f"CASE WHEN size({s}) = 0 THEN CAST(array() AS array<{SPAN_DDL}>) ELSE {body} END")


def greedy_sql(spans: str, v: str = "gr") -> str:
    """Accepted spans: per chain, in resolution order, all that overlap no accepted one."""

    def accept(chain: str, w: str) -> str:
        acc, x, a = f"{w}acc", f"{w}x", f"{w}a"
        return (f"aggregate({_keyed_sql(chain, _resolution_keys(f'{w}rx'), f'{w}r')}, {empty_spans_sql()}, ({acc}, {x}) -> "
                f"CASE WHEN exists({acc}, {a} -> {_overlaps(f'{x}.x', a)}) THEN {acc} ELSE concat({acc}, array({x}.x)) END)")

    single = f"CASE WHEN size({v}c) = 1 THEN {v}c ELSE {accept(f'{v}c', v)} END"
    many = f"flatten(transform({clusters_sql(spans, f'{v}k')}, {v}c -> {single}))"
    return f"CASE WHEN size({spans}) <= 1 THEN {spans} WHEN size({spans}) <= {FEW} THEN {accept(spans, f'{v}f')} ELSE {many} END"


def order_spans_sql(spans: str, descending: bool = False, v: str = "os") -> str:
    """By start ascending (legacy/report) or descending (apply)."""
    x = f"{v}x"
    return _sorted_sql(spans, (f"-{x}.start" if descending else f"{x}.start", f"-{_len(x)}", f"{x}.entity_type"), v)


def resolve_overlaps_sql(spans: str, order_by_start: bool = True) -> str:
    """Greedy accept in resolution order, skipping anything that overlaps
    an accepted span.  Result sorted by start (O03) unless told otherwise."""
    g = greedy_sql(spans)
    return f"CASE WHEN size({spans}) <= 1 THEN {spans} ELSE {order_spans_sql(g) if order_by_start else resolution_order_sql(g)} END"


def dedupe_contained_sql(spans: str, v: str = "dd", ordered: bool = True) -> str:
    """Analyzer-style duplicate removal: in (score desc, start asc, longer
    first) order, drop a span contained in an already kept span of the same
    type.  ``spans`` holds no two equal ones; without ``ordered`` the result need not
    come in that order.

    A span contained in a dropped one is contained in what that one was dropped for,
    too, so few spans are compared with all others: what contains a span and has no
    less score comes before it."""
    x, k, acc = f"{v}x", f"{v}k", f"{v}acc"

    def order(chain: str, w: str) -> str:
        return _sorted_sql(chain, (f"-{w}x.score", f"{w}x.start", f"-{_len(f'{w}x')}", f"{w}x.entity_type"), w)

    contained = f"{k}.start <= {x}.start AND {x}.`end` <= {k}.`end` AND {k}.entity_type = {x}.entity_type"
    chain = (
        f"aggregate({order(f'{v}c', f'{v}a')}, {empty_spans_sql()}, ({acc}, {x}) -> "
        f"CASE WHEN exists({acc}, {k} -> {contained}) THEN {acc} ELSE concat({acc}, array({x})) END)"
    )
    single = f"CASE WHEN size({v}c) = 1 THEN {v}c ELSE {chain} END"
    many = f"flatten(transform({clusters_sql(spans, f'{v}q')}, {v}c -> {single}))"
    before = f"{contained} AND {k}.score >= {x}.score AND ({k}.score > {x}.score OR {k}.start < {x}.start OR {k}.`end` > {x}.`end`)"
    few = f"filter({spans}, {x} -> CASE WHEN exists({spans}, {k} -> {before}) THEN false ELSE true END)"
    if ordered:
        few, many = order(few, f"{v}f"), order(many, f"{v}b")
    return f"CASE WHEN size({spans}) <= 1 THEN {spans} WHEN size({spans}) <= {FEW} THEN {few} ELSE {many} END"


def _c(name: str) -> str:
    return f"`{name}`"


def resolve_overlaps(spans_col: str, order_by_start: bool = True) -> Column:
    return F.expr(resolve_overlaps_sql(_c(spans_col), order_by_start))


def dedupe_contained(spans_col: str) -> Column:
    return F.expr(let_sql(f"array_distinct({_c(spans_col)})", "dds", dedupe_contained_sql("dds")))


def order_spans(spans_col: str, descending: bool = False) -> Column:
    return F.expr(order_spans_sql(_c(spans_col), descending))


def best_per_raw_text(span_table: DataFrame, doc_cols=("doc_id",), pos_col: str = "start") -> DataFrame:
    """Per (document, raw_txt) keep the highest score; ties go to the first
    start, then the longer span, then the type by name.

    Partitioned by the document key: a document's spans are bounded by the
    document itself, so no group grows with the corpus.
    """
    keys = list(doc_cols) + ["raw_txt"]
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(pos_col).asc(), F.col("end").desc(), "entity_type")
    return span_table.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
