"""Replacement strategies (A01-A06) on the document's span array.

Everything is a projection over the document row: spans carry their fake
value, and ``apply_spans`` joins them with the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.catalog import LOCAL_TYPES, ENTITY_ALIASES
from shroud.functions.fakes import SPARK, fake_value_sql, hash_sql, tagmap_fake_sql
from shroud.functions.spans import let_sql, scan_sql
from shroud.operators.resolve import order_spans_sql

# Types the legacy per-type replacer generates values for; any
# other type is replaced by the raw text of its last span.
LEGACY_GENERATED_TYPES = (
    "EMAIL_ADDRESS", "PHONE_NUMBER", "UK_NHS", "TW_ID_NUMBER", "UNIFIED_BUSINESS_NO", "CREDIT_CARD",
    "LOCATION", "IP_ADDRESS", "URL", "MAC_ADDRESS", "TW_PHONE_NUMBER", "TW_HEALTH_INSURANCE", "TW_PASSPORT_NUMBER",
)

REPL_DDL = ("array<struct<entity_type:string,start:int,`end`:int,score:double,raw_txt:string,"
            "fake_value:string,route:string>>")


#: spans times characters, up to which no text is split into characters
NEAR = 8192


def apply_spans_sql(text: str, spans: str, v: str = "ap", ordered: bool = False) -> str:
    """Splice ``fake_value`` of non-overlapping spans into ``text``; ``ordered`` tells that ``spans``
    names a column or variable of spans in the order of their starts.

    The text is split into characters once; the gaps between the spans and the
    values are joined, so the cost grows with text and spans, not their product.  Where
    that product is small, the gaps are taken from the text itself."""
    s, c, x, i = spans if ordered else f"{v}s", f"{v}c", f"{v}x", f"{v}i"
    prev = f"CASE WHEN {i} = 0 THEN 0 ELSE {s}[greatest({i} - 1, 0)].`end` END"
    gap = f"array_join(slice({c}, {prev} + 1, greatest({x}.start - {prev}, 0)), '')"
    pieces = f"transform({s}, ({x}, {i}) -> concat({gap}, coalesce({x}.fake_value, {x}.raw_txt)))"
    tail = f"array_join(slice({c}, element_at({s}, -1).`end` + 1, size({c})), '')"
    spliced = let_sql(f"split({text}, '', -1)", c, f"concat(array_join({pieces}, ''), {tail})")
    cut = f"substring({text}, {prev} + 1, greatest({x}.start - {prev}, 0))"
    near = (f"concat(array_join(transform({s}, ({x}, {i}) -> concat({cut}, coalesce({x}.fake_value, {x}.raw_txt))), ''), "
            f"substring({text}, element_at({s}, -1).`end` + 1))")
    body = (f"CASE WHEN size({s}) = 0 THEN {text} WHEN CAST(size({s}) AS BIGINT) * length({text}) <= {NEAR} THEN {near} "
            f"ELSE {spliced} END")
    if not ordered:
        body = let_sql(order_spans_sql(spans, v=f"{v}o"), s, body)
    return f"CASE WHEN {text} IS NULL THEN NULL ELSE {body} END"


def route_sql(entity: str) -> str:
    local = ", ".join(f"'{t}'" for t in LOCAL_TYPES + tuple(ENTITY_ALIASES))
    return f"(CASE WHEN {entity} IN ({local}) THEN 'local' ELSE 'model' END)"


def routed_fake_sql(entity: str, raw: str, salt: str = "", n: str | None = None, strict_names: bool = False,
                    h: str | None = None) -> str:
    """Local types -> per-type generator; others -> the model route's offline
    default (tag-map generator)."""
    local = fake_value_sql(SPARK, entity, raw, salt=salt, n=n, kind="local", strict_names=strict_names, h=h)
    model = fake_value_sql(SPARK, entity, raw, salt=salt, n=n, kind="tagmap", h=h)
    return f"(CASE WHEN {route_sql(entity)} = 'local' THEN {local} ELSE {model} END)"


_SPAN_FIELDS = ("'entity_type', {x}.entity_type, 'start', {x}.start, 'end', {x}.`end`, 'score', {x}.score, "
                "'raw_txt', {x}.raw_txt")


def span_fields(x: str) -> str:
    return _SPAN_FIELDS.format(x=x)


def with_fakes_sql(spans: str, *, salt: str = "", per_span: str | None = None, strict_names: bool = False,
                   v: str = "fk") -> str:
    """Add ``fake_value`` and ``route`` to each span.  ``per_span`` is an SQL
    expression (e.g. the document id) mixed into the seed together with the
    span start, so every span gets its own value (A02).  The seed hash is
    computed once per span (first transform), then the generators read it."""
    x, y = f"{v}x", f"{v}y"
    n = None if per_span is None else f"concat({per_span}, ':', {x}.start)"
    hashed = f"transform({spans}, {x} -> named_struct({span_fields(x)}, 'h', {hash_sql(SPARK, f'{x}.entity_type', f'{x}.raw_txt', salt, n)}))"
    val = routed_fake_sql(f"{y}.entity_type", f"{y}.raw_txt", salt, None, strict_names, h=f"{y}.h")
    return (f"transform({hashed}, {y} -> named_struct({span_fields(y)}, 'fake_value', {val}, "
            f"'route', {route_sql(f'{y}.entity_type')}))")


def replace_per_span(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "text_deid",
                     id_col: str = "doc_id", salt: str = "") -> DataFrame:
    """Own value per span (seed includes document id and offset)."""
    fk = with_fakes_sql(f"`{spans_col}`", salt=salt, per_span=f"CAST(`{id_col}` AS STRING)")
    return df.withColumn(out, F.expr(apply_spans_sql(f"`{text_col}`", fk)))


def legacy_fake_sql(entity: str, raw: str, h: str) -> str:
    """Generators of the legacy per-type replacer: as the local ones, except
    DATE_TIME (G22), PERSON without the name check, everything unknown keeps
    the (last) raw text."""
    from shroud.functions.fakes import Gen, legacy_date_fake_sql, local_fake_sql, FAKE_NAMES
    g = Gen(SPARK, h)
    base = local_fake_sql(SPARK, entity, raw, h)
    generated = ", ".join(f"'{t}'" for t in LEGACY_GENERATED_TYPES)
    return (f"(CASE WHEN {entity} = 'DATE_TIME' THEN {legacy_date_fake_sql(SPARK, raw, h)} "
            f"WHEN {entity} = 'PERSON' THEN {g.pick(FAKE_NAMES, 7)} "
            f"WHEN {entity} IN ({generated}) THEN {base} ELSE {raw} END)")


def replace_per_type(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "text_deid",
                     id_col: str = "doc_id", salt: str = "") -> DataFrame:
    """A03 (legacy): one value per entity type per document -- the value made
    for the *last* span of that type in resolution (priority) order.
    ``spans_col`` must hold the O01 result in resolution order.  The last
    raw text and the hash are computed once per span, then the generators
    read the struct fields."""
    x, lst, y, z = "ptx", "ptl", "pty", "ptz"
    # the last raw text of each type, once a type and not once a span
    types = f"array_distinct(transform(`{spans_col}`, {x} -> {x}.entity_type))"
    per_type = (f"map_from_entries(transform({types}, {y} -> named_struct('t', {y}, 'r', "
                f"element_at(filter(`{spans_col}`, {lst} -> {lst}.entity_type = {y}), -1).raw_txt)))")
    last = f"try_element_at(ptm, {x}.entity_type)"
    step1 = let_sql(per_type, "ptm", f"transform(`{spans_col}`, {x} -> named_struct({span_fields(x)}, 'last_raw', {last}))")
    h = hash_sql(SPARK, f"{y}.entity_type", f"{y}.last_raw", salt, f"CAST(`{id_col}` AS STRING)")
    step2 = f"transform({step1}, {y} -> named_struct({span_fields(y)}, 'last_raw', {y}.last_raw, 'h', {h}))"
    val = legacy_fake_sql(f"{z}.entity_type", f"{z}.last_raw", f"{z}.h")
    fk = f"transform({step2}, {z} -> named_struct({span_fields(z)}, 'fake_value', {val}))"
    return df.withColumn(out, F.expr(apply_spans_sql(f"`{text_col}`", fk)))


def length_preserving_sql(spans: str, salt: str = "", v: str = "lp") -> str:
    """Value chosen per raw text by its best-scoring span (O02), made
    by the tag-map generators, cut / space-padded to the original length;
    ORGANIZATION kept.  Best type and hash are computed once per span."""
    x, z, a, b, s, h, i = (f"{v}{k}" for k in ("x", "z", "a", "b", "s", "h", "i"))
    # spans in runs of one raw text, the best of a run first; every span looks at its run's head
    order = (f"CASE WHEN {a}.raw_txt < {b}.raw_txt THEN -1 WHEN {a}.raw_txt > {b}.raw_txt THEN 1 "
             f"WHEN {a}.score > {b}.score THEN -1 WHEN {a}.score < {b}.score THEN 1 "
             f"WHEN {a}.start < {b}.start THEN -1 WHEN {a}.start > {b}.start THEN 1 ELSE 0 END")
    first = f"transform({s}, ({x}, {i}) -> CASE WHEN {i} > 0 AND {s}[greatest({i} - 1, 0)].raw_txt = {x}.raw_txt THEN 0 ELSE {i} END)"
    heads = scan_sql(first, f"greatest({v}ql, {v}qr)", "0", f"{v}q")
    runs = f"zip_with({s}, {heads}, ({x}, {h}) -> named_struct({span_fields(x)}, 'best_type', {s}[{h}].entity_type))"
    typed = let_sql(f"array_sort({spans}, ({a}, {b}) -> {order})", s, runs)
    hashed = (f"transform({typed}, {x} -> named_struct({span_fields(x)}, 'best_type', {x}.best_type, "
              f"'h', {hash_sql(SPARK, f'{x}.best_type', f'{x}.raw_txt', salt)}))")
    gen = tagmap_fake_sql(SPARK, f"{z}.best_type", f"{z}.raw_txt", f"{z}.h")
    n = f"length({z}.raw_txt)"
    val = (f"CASE WHEN {z}.entity_type = 'ORGANIZATION' THEN {z}.raw_txt "
           f"ELSE rpad(substring({gen}, 1, {n}), {n}, ' ') END")
    return f"transform({hashed}, {z} -> named_struct({span_fields(z)}, 'fake_value', {val}))"


def replace_length_preserving(df: DataFrame, text_col: str = "text", spans_col: str = "spans",
                              out: str = "text_deid", salt: str = "") -> DataFrame:
    return df.withColumn(out, F.expr(apply_spans_sql(f"`{text_col}`", length_preserving_sql(f"`{spans_col}`", salt))))


def mask_sql(spans: str, char: str = "★", v: str = "mk") -> str:
    x = f"{v}x"
    c = char.replace("'", "\\'")
    return (f"transform({spans}, {x} -> named_struct('entity_type', {x}.entity_type, 'start', {x}.start, "
            f"'end', {x}.`end`, 'score', {x}.score, 'raw_txt', {x}.raw_txt, "
            f"'fake_value', repeat('{c}', {x}.`end` - {x}.start)))")


def mask(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "text_deid",
         char: str = "★") -> DataFrame:
    """Every span becomes ``char`` x its length."""
    return df.withColumn(out, F.expr(apply_spans_sql(f"`{text_col}`", mask_sql(f"`{spans_col}`", char))))


def keep(df: DataFrame, text_col: str = "text", out: str = "text_deid") -> DataFrame:
    """Dry run -- spans only, text unchanged."""
    return df.withColumn(out, F.col(text_col))


def apply_spans(text_col: str, spans_col: str) -> Column:
    return F.expr(apply_spans_sql(f"`{text_col}`", f"`{spans_col}`"))
