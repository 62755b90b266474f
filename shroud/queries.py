"""Registered queries: one per operator family of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame with plain
columns; ``shroud.oracles`` holds the DuckDB statement for the same name.
Every query reads the driver's tables (or corpora Spark derives from them)
in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud import catalog as C
from shroud.functions import validators as V
from shroud.functions.fakes import SPARK, fake_column_sql, fake_value_sql, is_likely_person_name_sql, is_relative_time_sql
from shroud.functions.spans import explode_nonempty, explode_spans
from shroud.operators import mapping as M
from shroud.operators import reports as R
from shroud.operators.detect import detect, detect_legacy
from shroud.operators.gazetteer import gazetteer_detect, gazetteer_spans, names_table
from shroud.operators.hooks import model_detect, python_regex_predictor
from shroud.operators.replace import keep, mask, replace_length_preserving, replace_per_span, replace_per_type
from shroud.operators.resolve import best_per_raw_text, order_spans_sql
from shroud.operators.text import LINE_COUNT_CAP, line_count, preview, reassemble_segments, segment_text
from shroud.plans.deidentify import (
    deidentify,
    deidentify_html,
    deidentify_layout,
    deidentify_segments,
    deidentify_with_model,
    detect_documents,
    isolated,
    with_status,
    written,
)
from shroud.session import checkpoint_dir
from shroud.sources import files as S
from shroud.sources.tables import (
    customer_corpus,
    file_listing,
    forms_corpus,
    long_names,
    long_texts,
    orders_corpus,
    read_table_documents,
    scan_width,
    spread,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]

SPAN_COLS = ["doc_id", "entity_type", "start", "end", "score", "raw_txt"]

# Option keys of the upload page -> entity types (C03); direct type keys pass
# through, unknown keys are dropped.  Fixed values.
OPTION_TYPES = {
    "name": ("PERSON",),
    "email": ("EMAIL_ADDRESS",),
    "phone": ("PHONE_NUMBER", "TW_PHONE_NUMBER", "TW_HOME_NUMBER"),
    "address": ("LOCATION",),
    "birthday": ("DATE_TIME",),
    "id": ("TW_ID_NUMBER", "US_SSN"),
    "company": ("ORGANIZATION", "UNIFIED_BUSINESS_NO"),
    "org": ("ORGANIZATION", "UNIFIED_BUSINESS_NO"),
    "bank": ("US_BANK_NUMBER", "IBAN_CODE"),
}
COMMON_OPTIONS = ("name", "email", "phone", "address", "CREDIT_CARD", "TW_ID_NUMBER", "TW_NHI_NUMBER", "DATE_TIME",
                  "UNIFIED_BUSINESS_NO", "TW_PHONE_NUMBER", "IP_ADDRESS", "TW_PASSPORT_NUMBER", "URL")
KNOWN_TYPES = tuple(sorted({r.entity for r in C.default_rules(True)} | {"PERSON", "LOCATION", "ORGANIZATION"}))


def option_types(options) -> tuple[str, ...] | None:
    """Selected option keys -> entity types; empty / None -> all.

    Aliases stand for their detector type (D47).  Unknown keys are dropped, but a
    list of nothing else is an error: it would replace nothing."""
    if not options:
        return None
    alias = {v: k for k, v in C.ENTITY_ALIASES.items()}
    out = []
    for k in options:
        k = alias.get(k, k)
        if k in OPTION_TYPES:
            out.extend(OPTION_TYPES[k])
        elif k in KNOWN_TYPES:
            out.append(k)
    if not out:
        raise ValueError(f"no known option among {sorted(options)}")
    return tuple(dict.fromkeys(out))


# ---------------------------------------------------------------- sources
def docs(spark, sf):
    return read_table_documents(spark, sf, "documents", partitions=scan_width(spark))


def cust(spark, sf):
    return customer_corpus(spark, sf)


def orders(spark, sf):
    return orders_corpus(spark, sf)


def urls(spark, sf):
    return spread(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")), scan_width(spark))


def pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"), scan_width(spark))


def forms(spark, sf):
    return forms_corpus(spark, sf)


SOURCES = {"documents": docs, "customer": cust, "orders": orders, "urls": urls, "forms": forms}
ALL_RULE_IDS = tuple(r.rule_id for r in C.default_rules(include_disabled=True))
DATE_RULE_IDS = tuple(r for r in ALL_RULE_IDS if r.startswith("D35"))


# ---------------------------------------------------------------- detection
def span_query(source: str, rule_ids=None, *, threshold=C.DEFAULT_THRESHOLD, resolve=False, entity_types=None,
               context=True) -> Query:
    def run(spark, sf):
        rules = C.default_rules() if rule_ids is None else C.rules_by_id(*rule_ids)
        d = detect(SOURCES[source](spark, sf), rules=rules, threshold=threshold, resolve=resolve,
                   entity_types=entity_types, context=context)
        return explode_spans(d, "doc_id")
    return run


def q_detect_legacy(spark, sf):
    return explode_spans(detect_legacy(docs(spark, sf)), "doc_id")


def q_detect_legacy_forms(spark, sf):
    return explode_spans(detect_legacy(forms(spark, sf)), "doc_id")


def all_names(spark, sf) -> DataFrame:
    return names_table(spark, sf).unionByName(long_names(spark, sf))


def named(source: str, spark, sf) -> DataFrame:
    """A corpus with the gazetteer's hits as the column ``name_spans``."""
    return gazetteer_detect(SOURCES[source](spark, sf), all_names(spark, sf), out="name_spans")


def q_gazetteer_forms(spark, sf):
    return gazetteer_spans(forms(spark, sf), all_names(spark, sf))


def q_gazetteer_long(spark, sf):
    return gazetteer_spans(long_texts(spark, sf), all_names(spark, sf))


def q_detect_names(source: str) -> Query:
    """L00 with names: gazetteer spans compete with the rules' by priority."""
    def run(spark, sf):
        d = detect_documents(named(source, spark, sf), threshold=C.HANDLER_THRESHOLD, extra_spans="name_spans")
        return explode_spans(d, "doc_id")
    return run


def q_deidentify_names(source: str) -> Query:
    def run(spark, sf):
        return deidentify(named(source, spark, sf), salt="", extra_spans="name_spans").select("doc_id", "text_deid")
    return run


def reversing_client():
    """A stand-in for a chat model: every item's raw text, reversed."""
    def chat(system, prompt):
        lines = prompt.split("\n")[1:]
        return "\n".join(ln.split("; raw=", 1)[1][::-1] for ln in lines)
    return chat


def q_deidentify_model_route(spark, sf):
    """The model route end to end: names -> L00 -> A10 -> A12 -> A11 -> A08 -> A01."""
    store = M.MappingStore(spark, f"{checkpoint_dir(spark)}/shroud-mapping-{uuid.uuid4().hex}")
    out = deidentify_with_model(named("forms", spark, sf), store, reversing_client, salt="", extra_spans="name_spans")
    return out.select("doc_id", "text_deid")


def q_detect_legacy_names(spark, sf):
    """D26 with named entities: gazetteer hits (D48) + legacy regexes over
    the orders corpus, ordered by start, duplicates kept."""
    d = gazetteer_detect(orders(spark, sf), names_table(spark, sf), out="name_spans")
    return explode_spans(detect_legacy(d, names_col="name_spans"), "doc_id")


def q_gazetteer(spark, sf):
    return gazetteer_spans(orders(spark, sf), names_table(spark, sf))


def q_model_detect(spark, sf):
    pred = python_regex_predictor({"EMAIL_ADDRESS": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"})
    d = model_detect(docs(spark, sf), pred, out="spans")
    return explode_spans(d, "doc_id")


# ---------------------------------------------------------------- validation
def q_validate_ubn(spark, sf):
    c = cust(spark, sf).select("doc_id", F.regexp_extract("text", r"UBN (\d{8})", 1).alias("ubn"))
    return c.select("doc_id", "ubn", F.expr(V.ubn_checksum_sql("ubn")).cast("int").alias("checksum"), V.ubn_valid("ubn").alias("is_valid"))


def q_normalize_mac(spark, sf):
    c = cust(spark, sf).select("doc_id", F.regexp_extract("text", r"MAC (\S+)", 1).alias("mac"))
    return c.select("doc_id", "mac", V.normalize_mac("mac").alias("normalized"),
                    F.expr(V.mac_score_sql("mac", "0.9D")).alias("score"))


def q_luhn(spark, sf):
    d = explode_nonempty(docs(spark, sf), ["doc_id"], F.expr(r"regexp_extract_all(text, '(?U)\\b\\d{13,19}\\b', 0)"),
                         alias="digits")
    return d.select("doc_id", "digits", V.luhn_valid("digits").alias("luhn_ok"))


# ---------------------------------------------------------------- scoring / selection
def q_select_types(options) -> Query:
    return span_query("documents", threshold=C.HANDLER_THRESHOLD, resolve=True, entity_types=option_types(options))


def q_context_boost(spark, sf):
    rules = C.rules_by_id("D22")
    base = detect(cust(spark, sf), rules=rules, threshold=None, context=False, out="plain")
    both = detect(base, rules=rules, threshold=None, context=True, out="boosted")
    z = explode_nonempty(both, ["doc_id"], F.arrays_zip("plain", "boosted"), alias="z")
    return z.select("doc_id", F.col("z.plain.start").alias("start"), F.col("z.plain.raw_txt").alias("raw_txt"),
                    F.col("z.plain.score").alias("score_plain"), F.col("z.boosted.score").alias("score_boosted"))


def q_best_per_raw(spark, sf):
    d = detect(forms(spark, sf), threshold=None)
    return best_per_raw_text(explode_spans(d, "doc_id"))


def q_span_order(spark, sf):
    d = detect_documents(docs(spark, sf), threshold=C.HANDLER_THRESHOLD)
    d = d.withColumn("spans", F.expr(order_spans_sql("spans", descending=True)))
    return explode_nonempty(d, ["doc_id"], "spans", alias="s", pos="ordinal").select(
        "doc_id", F.col("ordinal").cast("int").alias("ordinal"), "s.start", "s.end")


# ---------------------------------------------------------------- generators
def all_spans(spark, sf) -> DataFrame:
    parts = []
    for name in ("documents", "customer", "orders", "forms"):
        d = detect(SOURCES[name](spark, sf), threshold=C.HANDLER_THRESHOLD, resolve=True)
        parts.append(explode_spans(d, "doc_id").withColumn("corpus", F.lit(name)))
    names = detect_documents(named("forms", spark, sf), threshold=C.HANDLER_THRESHOLD, extra_spans="name_spans")
    parts.append(explode_spans(names, "doc_id").withColumn("corpus", F.lit("names")))
    return reduce(DataFrame.unionByName, parts)


def q_fakes(kind: str) -> Query:
    def run(spark, sf):
        return all_spans(spark, sf).select("corpus", "doc_id", "start", "entity_type", "raw_txt",
                                           F.expr(fake_column_sql("entity_type", "raw_txt", kind=kind)).alias("fake_value"))
    return run


def dated(spark, sf) -> DataFrame:
    """Orders and forms, each document under an id of its own."""
    return orders(spark, sf).unionByName(forms(spark, sf).withColumn("doc_id", -F.col("doc_id")))


def q_legacy_date(spark, sf):
    s = explode_spans(detect(dated(spark, sf), rules=C.rules_for_entities(["DATE_TIME", "DURATION_TIME"]),
                             threshold=C.HANDLER_THRESHOLD, resolve=True), "doc_id")
    return s.select("doc_id", "start", "raw_txt", F.expr(fake_column_sql("entity_type", "raw_txt", kind="legacy_date")).alias("fake_value"))


def q_person_names(spark, sf):
    n = names_table(spark, sf).select(F.col("phrase").alias("candidate"))
    seg = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("candidate"))
    u = n.unionByName(seg).distinct()
    return u.select("candidate",
                    F.expr(is_likely_person_name_sql(SPARK, "candidate")).alias("likely"),
                    F.expr(is_likely_person_name_sql(SPARK, "candidate", strict=True)).alias("likely_strict"))


def q_relative_time(spark, sf):
    s = explode_spans(detect(dated(spark, sf), rules=C.rules_for_entities(["DATE_TIME", "DURATION_TIME"]),
                             threshold=None), "doc_id")
    return s.select("doc_id", "start", "raw_txt", F.expr(is_relative_time_sql(SPARK, "raw_txt")).alias("is_relative"))


# ---------------------------------------------------------------- replacement
def _resolved(df, threshold=C.HANDLER_THRESHOLD):
    return detect_documents(df, threshold=threshold)


def q_apply_spans(spark, sf):
    return replace_per_span(_resolved(docs(spark, sf))).select("doc_id", "text_deid")


def q_replace_per_type(spark, sf):
    d = cust(spark, sf)
    # resolution (priority) order decides which span of a type is "last",
    # so the resolved spans are kept in that order (not sorted by start)
    from shroud.operators.resolve import resolve_overlaps_sql
    d = detect(d, threshold=C.HANDLER_THRESHOLD)
    d = d.withColumn("spans", F.expr(resolve_overlaps_sql("spans", order_by_start=False)))
    return replace_per_type(d).select("doc_id", "text_deid")


def q_length_preserving(spark, sf):
    return replace_length_preserving(_resolved(cust(spark, sf))).select(
        "doc_id", "text_deid", (F.length("text_deid") == F.length("text")).alias("same_length"))


def q_mask(spark, sf):
    return mask(_resolved(docs(spark, sf))).select("doc_id", "text_deid")


def q_keep(spark, sf):
    d = keep(_resolved(forms(spark, sf)))
    return d.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.col("text_deid").eqNullSafe(F.col("text")).alias("unchanged"))


# ---------------------------------------------------------------- mapping
def doc_span_table(spark, sf, source="documents"):
    return explode_spans(_resolved(SOURCES[source](spark, sf)), "doc_id")


def q_mapping_upsert(spark, sf):
    spans = doc_span_table(spark, sf, "documents").unionByName(doc_span_table(spark, sf, "customer"))
    return M.mapping_upsert(spans, M.empty_mapping(spark), version=1).select("map_key", "entity_type", "fake_value", "route")


def q_route_counts(spark, sf):
    found = written(doc_span_table(spark, sf, "documents"), "spans")
    prev = M.mapping_upsert(found, None, version=1)
    return R.route_counts(M.route_spans(found.unionByName(doc_span_table(spark, sf, "customer")), prev))


def model_pairs(spark, sf):
    spans = doc_span_table(spark, sf, "customer").unionByName(doc_span_table(spark, sf, "orders"))
    from shroud.operators.replace import route_sql
    return spans.filter(F.expr(route_sql("entity_type")) == "model").select("entity_type", "raw_txt").distinct()


def q_model_batches(spark, sf):
    b = M.build_model_batches(model_pairs(spark, sf), buckets=16)
    return b.select("batch_id", F.explode("items").alias("it"), "prompt").select(
        "batch_id", F.col("it.pos").alias("pos"), F.col("it.entity_type").alias("entity_type"),
        F.col("it.raw").alias("raw_txt"), "prompt")


def offline_responses(batches: DataFrame) -> DataFrame:
    """A stand-in model reply per batch: the tag-map value per item, one per
    line, with every 7th item left blank to exercise the 'kept' path."""
    val = fake_value_sql(SPARK, "x.entity_type", "x.raw", kind="tagmap")
    return batches.withColumn("response", F.expr(
        f"array_join(transform(items, x -> CASE WHEN x.pos % 7 = 6 THEN '' ELSE {val} END), '\\n')"))


def q_parse_batches(spark, sf):
    b = offline_responses(M.build_model_batches(model_pairs(spark, sf), buckets=16))
    return M.parse_model_batches(b).select("batch_id", "pos", "entity_type", "raw_txt", "fake_value", "route")


def q_model_generate(spark, sf):
    return M.model_values(M.model_generate(M.build_model_batches(model_pairs(spark, sf), buckets=16), reversing_client))


# ---------------------------------------------------------------- plans
def q_detect_documents(spark, sf):
    return explode_spans(detect_documents(docs(spark, sf)), "doc_id")


def q_deidentify_documents(spark, sf):
    return deidentify(docs(spark, sf), salt="").select("doc_id", "text_deid")


def q_deidentify_segments(spark, sf):
    return deidentify_segments(docs(spark, sf), salt="").select("doc_id", "text_deid")


def q_deidentify_layout(spark, sf):
    d = deidentify_layout(docs(spark, sf), salt="")
    return d.select("doc_id", "text_deid", (F.length("text_deid") == F.length("text")).alias("same_length"))


def q_deidentify_pages(spark, sf):
    return deidentify_html(pages(spark, sf), salt="").select("page_id", "text_deid")


def q_deidentify_conversations(spark, sf):
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), scan_width(spark))
    return deidentify(c, id_col=["conv_id", "turn"], salt="").select("conv_id", "turn", "text_deid")


def q_deidentify_with_mapping(spark, sf):
    """L01 with a stored mapping: the mapping of a previous run over
    ``documents`` is joined in while de-identifying documents and the
    customer corpus; spans whose key is stored are routed ``cached``."""
    prev = M.mapping_upsert(doc_span_table(spark, sf, "documents"), None, version=1)
    both = docs(spark, sf).withColumn("corpus", F.lit("documents")).unionByName(
        cust(spark, sf).withColumn("corpus", F.lit("customer")))
    both = both.withColumn("doc_id", F.concat_ws(":", "corpus", F.col("doc_id").cast("string")))
    out = deidentify(both, salt="", mapping=prev)
    return out.select("doc_id", "text_deid",
                      F.expr("CAST(size(filter(spans, s -> s.route = 'cached')) AS BIGINT)").alias("n_cached"))


def q_deidentify_forms(spark, sf):
    return deidentify(forms(spark, sf), salt="").select("doc_id", "text_deid")


def q_deidentify_segments_mapping(spark, sf):
    """L02 with a stored mapping whose values differ from the generated ones."""
    prev = M.mapping_upsert(doc_span_table(spark, sf, "documents"), None, version=1)
    prev = prev.withColumn("fake_value", F.concat(F.lit("<"), F.substring("map_key", 1, 6), F.lit(">")))
    return deidentify_segments(docs(spark, sf), salt="", mapping=prev).select("doc_id", "text_deid")


def q_deidentify_stream(spark, sf):
    """Documents arriving as files, de-identified by the stream; the
    result must equal the batch plan (its oracle is the batch SQL)."""
    from shroud.streaming.stream import stream_documents_once
    return stream_documents_once(spark, docs(spark, sf), salt="")


def q_status(spark, sf):
    d = with_status(deidentify(forms(spark, sf), salt=""))
    return d.select("doc_id", "status", "error")


def q_isolation(spark, sf):
    """The customer corpus, in which the text of one customer makes the plan fail: every other row, and an error row."""
    corpus = cust(spark, sf)
    first = corpus.agg(F.min("doc_id")).scalar()
    corpus = corpus.withColumn("text", F.when(F.col("doc_id") == first, F.lit("poison")).otherwise(F.col("text")))

    def plan(d):
        fails = F.when(F.col("text") == "poison", F.raise_error(F.lit("cannot be read"))).otherwise(F.col("text"))
        found = detect(d.withColumn("text", fails), rules=C.rules_by_id("D30"), threshold=None)
        return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"))

    good, bad = isolated(corpus, plan)
    ok = good.select("doc_id", "n_spans", F.lit("ok").alias("status"))
    return ok.unionByName(bad.select("doc_id", F.lit(None).cast("long").alias("n_spans"), F.lit("error").alias("status")))


def q_text_files(spark, sf):
    """Every document written as a file of its own and read back."""
    path = f"{checkpoint_dir(spark)}/shroud-files-{uuid.uuid4().hex}"
    named = table(spark, sf, "documents").select(F.format_string("/in/doc %d.txt", "doc_id").alias("path"), F.col("text").alias("text_deid"))
    S.write_deidentified(spread(named, scan_width(spark)), path, fmt="files")
    back = S.read_text_documents(spark, path).where(~F.col("path").endswith("_SUCCESS"))
    return back.select(S.file_name(F.col("path")).alias("file"), "status", F.sha2("text", 256).alias("sha256"))


# ---------------------------------------------------------------- text
def q_segments(spark, sf):
    s = segment_text(docs(spark, sf))
    return s.select("doc_id", F.col("seg_no").cast("int").alias("seg_no"), F.length("text").alias("seg_len"), "is_blank")


def q_segment_roundtrip(spark, sf):
    d = docs(spark, sf)
    back = reassemble_segments(segment_text(d), out="text_back")
    return d.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("text_back")).alias("roundtrip_equal"))


def q_preview(spark, sf):
    return preview(docs(spark, sf)).select("doc_id", "preview")


def q_line_count(spark, sf):
    return line_count(docs(spark, sf), cap=LINE_COUNT_CAP).select("doc_id", "line_count", "line_count_capped")


# ---------------------------------------------------------------- files
def q_classify(variant):
    def run(spark, sf):
        return S.classify_file_type(file_listing(spark, sf), variant=variant).select("arrival", "path", "type")
    return run


def q_select_files(spark, sf):
    return S.select_input_files(file_listing(spark, sf), max_files=S.MAX_FILES).select("arrival", "path", "name")


def q_output_name(spark, sf):
    return S.output_name(file_listing(spark, sf)).select("arrival", "path", "output_name")


def _manifest(spark, sf):
    """The documents and the forms as files; forms without a text stand for files that could not be read."""
    files = file_listing(spark, sf).select(F.col("arrival").alias("doc_id"), "path", "text")
    more = forms(spark, sf).select((-F.col("doc_id") - 1_000_000).alias("doc_id"), F.format_string("/in/forms/f%d.txt", "doc_id").alias("path"), "text")
    return S.result_manifest(deidentify(files.unionByName(more), text_col="text", salt=""))


def q_manifest(spark, sf):
    return _manifest(spark, sf)


def q_export_list(spark, sf):
    return S.export_list(_manifest(spark, sf))


def q_run_summary(spark, sf):
    return R.run_summary(_manifest(spark, sf))


# ---------------------------------------------------------------- reports
def q_entities_by_type(spark, sf):
    return R.entities_by_type(detect_documents(docs(spark, sf), threshold=C.HANDLER_THRESHOLD))


def q_entities_per_document(spark, sf):
    return R.entities_per_document(detect_documents(docs(spark, sf), threshold=C.HANDLER_THRESHOLD))


def q_overlap_report(spark, sf):
    d = detect(cust(spark, sf), threshold=C.HANDLER_THRESHOLD, out="spans_raw")
    return R.overlap_report(d)


def queries() -> dict[str, Query]:
    return {
        # detection
        "detect_tw_id": span_query("customer", ["D01"], threshold=None),
        "detect_ubn": span_query("customer", ["D02"], threshold=None),
        "detect_tw_phone": span_query("customer", ["D03", "D04", "D05", "D06"], threshold=None),
        "detect_duration": span_query("customer", [f"D{i:02d}" for i in range(7, 16)], threshold=None),
        "detect_duration_orders": span_query("orders", [f"D{i:02d}" for i in range(7, 16)], threshold=None),
        "detect_tw_home": span_query("customer", ["D17", "D18", "D19"], threshold=None),
        "detect_tw_home_parenthesized": span_query("customer", ["D16"], threshold=None),
        "detect_mac": span_query("customer", ["D20", "D21"], threshold=None),
        "detect_tw_nhi": span_query("customer", ["D22"], threshold=None),
        "detect_email": span_query("documents", ["D30"], threshold=None),
        "detect_credit_card": span_query("documents", ["D31"], threshold=None),
        "detect_ip": span_query("documents", ["D32", "D32b"], threshold=None),
        "detect_url": span_query("urls", ["D33"], threshold=None),
        "detect_phone": span_query("documents", ["D34"], threshold=None),
        "detect_date_time": span_query("orders", DATE_RULE_IDS, threshold=None),
        "detect_us_ids": span_query("documents", ["D38", "D39", "D40", "D41", "D42"], threshold=None),
        "detect_intl_ids": span_query("documents", ["D36", "D37", "D43", "D44", "D45", "D46"], threshold=None),
        "detect_all_customer": span_query("customer", threshold=None),
        "detect_forms": span_query("forms", ALL_RULE_IDS, threshold=None),
        "detect_forms_resolved": span_query("forms", threshold=C.HANDLER_THRESHOLD, resolve=True),
        "detect_url_documents": span_query("documents", ["D33"], threshold=None),
        "detect_legacy": q_detect_legacy,
        "detect_legacy_forms": q_detect_legacy_forms,
        "gazetteer_forms": q_gazetteer_forms,
        "gazetteer_long_texts": q_gazetteer_long,
        "detect_orders_names": q_detect_names("orders"),
        "detect_forms_names": q_detect_names("forms"),
        "gazetteer_location": q_gazetteer,
        "detect_legacy_names": q_detect_legacy_names,
        "model_detect_python": q_model_detect,
        # validation, scoring, selection
        "validate_ubn": q_validate_ubn,
        "normalize_mac": q_normalize_mac,
        "luhn_cards": q_luhn,
        "context_boost_nhi": q_context_boost,
        "threshold_filter": span_query("documents", threshold=C.HANDLER_THRESHOLD),
        "select_types": q_select_types(["email", "phone"]),
        "select_all_common": q_select_types(list(COMMON_OPTIONS)),
        # resolution
        "resolve_overlaps": span_query("customer", threshold=C.HANDLER_THRESHOLD, resolve=True),
        "best_per_raw_text": q_best_per_raw,
        "span_order": q_span_order,
        # generators
        "fake_local": q_fakes("local"),
        "fake_tagmap": q_fakes("tagmap"),
        "fake_legacy_date": q_legacy_date,
        "person_name_check": q_person_names,
        "relative_time_check": q_relative_time,
        # replacement
        "apply_spans": q_apply_spans,
        "replace_per_type": q_replace_per_type,
        "replace_length_preserving": q_length_preserving,
        "mask": q_mask,
        "keep_dry_run": q_keep,
        # mapping and model route
        "mapping_upsert": q_mapping_upsert,
        "route_counts": q_route_counts,
        "model_batches": q_model_batches,
        "parse_batches": q_parse_batches,
        "model_generate_offline": q_model_generate,
        # plans (L00-L05)
        "detect_documents": q_detect_documents,
        "deidentify_documents": q_deidentify_documents,
        "deidentify_segments": q_deidentify_segments,
        "deidentify_layout": q_deidentify_layout,
        "deidentify_pages": q_deidentify_pages,
        "deidentify_conversations": q_deidentify_conversations,
        "deidentify_forms": q_deidentify_forms,
        "deidentify_orders_names": q_deidentify_names("orders"),
        "deidentify_forms_names": q_deidentify_names("forms"),
        "deidentify_model_route": q_deidentify_model_route,
        "deidentify_segments_mapping": q_deidentify_segments_mapping,
        "deidentify_with_mapping": q_deidentify_with_mapping,
        "deidentify_stream": q_deidentify_stream,
        "document_status": q_status,
        "document_isolation": q_isolation,
        # text (T01-T04)
        "segments": q_segments,
        "segment_roundtrip": q_segment_roundtrip,
        "preview": q_preview,
        "line_count": q_line_count,
        # files (S03-S07)
        "classify_file_type": q_classify("backend"),
        "classify_file_type_legacy": q_classify("legacy"),
        "select_input_files": q_select_files,
        "output_name": q_output_name,
        "text_files": q_text_files,
        "manifest": q_manifest,
        "export_list": q_export_list,
        # reports (R01-R05)
        "entities_by_type": q_entities_by_type,
        "entities_per_document": q_entities_per_document,
        "overlap_report": q_overlap_report,
        "run_summary": q_run_summary,
    }
