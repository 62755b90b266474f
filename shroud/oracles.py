"""DuckDB oracle SQL, one statement per registered query.

Tables ``documents customer orders nation region pages conversations`` are
views in the checking DuckDB session.  The statements restate each operator
in DuckDB SQL (RE2 regexes, list lambdas); the rule catalog and the fixed
value lists are the only things shared with the Spark side.
"""

from __future__ import annotations

from dataclasses import replace

from shroud import catalog as C
from shroud.functions.fakes import DUCK, fake_value_sql, is_likely_person_name_sql, is_relative_time_sql
from shroud.functions.validators import UBN_WEIGHTS  # noqa: F401  (documented dependency)
from shroud.operators.gazetteer import GAZETTEER_SCORE, UNSPACED
from shroud.operators.mapping import MODEL_PROMPT_HEADER
from shroud.operators.text import BLANK_MARK, LINE_COUNT_CAP, PREVIEW_CHARS, TRUNCATED_MARK
from shroud.queries import ALL_RULE_IDS, COMMON_OPTIONS, DATE_RULE_IDS, option_types
from shroud.sources.files import ACCEPTED_EXTENSIONS, LEGACY_TEXT_EXTENSIONS, MAX_FILES
from shroud.sources.tables import CUSTOMER_CORPUS_SQL, FORMS_CORPUS_SQL, LONG_NAMES_SQL, LONG_TEXTS_SQL, ORDERS_CORPUS_SQL
from shroud.sqloracle import detect_duck, luhn_duck, mac_null_duck, q, resolve_duck, ubn_valid_duck

DOCS = "(SELECT doc_id AS id, text FROM documents)"
CUST = f"(SELECT doc_id AS id, text FROM ({CUSTOMER_CORPUS_SQL}))"
ORDS = f"(SELECT doc_id AS id, text FROM ({ORDERS_CORPUS_SQL}))"
URLS = "(SELECT page_id AS id, url AS text FROM pages)"
FRMS = "(SELECT doc_id AS id, text FROM forms_corpus)"  # see with_forms
SRC = {"documents": DOCS, "customer": CUST, "orders": ORDS, "urls": URLS, "forms": FRMS}
DATED = f"(SELECT id, text FROM {ORDS} UNION ALL SELECT -id, text FROM {FRMS})"
SPANS_OUT = 'SELECT id AS doc_id, entity_type, start, "end", score, raw_txt FROM ({})'
ST = 'STRUCT(entity_type VARCHAR, start INTEGER, "end" INTEGER, score DOUBLE, raw_txt VARCHAR, fake_value VARCHAR)'


def spans_sql(source, rule_ids=None, *, threshold=C.DEFAULT_THRESHOLD, resolve=False, entity_types=None,
              context=True) -> str:
    rules = C.default_rules() if rule_ids is None else C.rules_by_id(*rule_ids)
    return SPANS_OUT.format(detect_duck(SRC[source], rules, threshold=threshold, resolve=resolve,
                                        entity_types=entity_types, context=context))


def resolved(source, threshold=C.HANDLER_THRESHOLD, rules=None) -> str:
    """(id, entity_type, start, end, score, raw_txt) after L00."""
    return detect_duck(SRC[source], rules or C.default_rules(), threshold=threshold, resolve=True)


def route_duck(entity: str) -> str:
    local = ", ".join(f"'{t}'" for t in C.LOCAL_TYPES + tuple(C.ENTITY_ALIASES))
    return f"(CASE WHEN {entity} IN ({local}) THEN 'local' ELSE 'model' END)"


def routed_duck(entity: str, raw: str, n: str | None = None) -> str:
    local = fake_value_sql(DUCK, entity, raw, n=n, kind="local")
    model = fake_value_sql(DUCK, entity, raw, n=n, kind="tagmap")
    return f"(CASE WHEN {route_duck(entity)} = 'local' THEN {local} ELSE {model} END)"


def splice(src: str, spans_with_fake: str, id_col: str = "id", out: str = "text_deid") -> str:
    """A01 in DuckDB: right-to-left fold over (start desc) spans."""
    agg = (f"SELECT id, list({{'start': start, 'end': \"end\", 'fake': fake_value}} ORDER BY start DESC, "
           f"\"end\" - start DESC, entity_type) AS sp FROM ({spans_with_fake}) GROUP BY id")
    fold = ("list_reduce(sp, lambda t, x: substring(t, 1, x.start) || x.fake || substring(t, x.\"end\" + 1), s.text)")
    return (f"SELECT s.id AS {id_col}, CASE WHEN s.text IS NULL THEN NULL WHEN a.sp IS NULL THEN s.text "
            f"ELSE {fold} END AS {out} FROM {src} s LEFT JOIN ({agg}) a ON a.id = s.id")


def with_fake(rel: str, n: str | None = None) -> str:
    return f"SELECT *, {routed_duck('entity_type', 'raw_txt', n)} AS fake_value FROM ({rel})"


# ---------------------------------------------------------------- pieces
def legacy_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"(SELECT id AS doc_id, entity_type, start, \"end\", score, raw_txt FROM "
        f"({detect_duck(src, [r], threshold=None, context=False, dedupe=False)}))" for r in C.LEGACY_RULES)


NAMES_SQL = ("SELECT 'LOCATION' AS entity_type, n_name AS phrase FROM nation UNION SELECT 'LOCATION', r_name FROM region "
             "UNION SELECT 'PERSON', c_name FROM customer")
ALL_NAMES_SQL = " UNION ".join([NAMES_SQL, *LONG_NAMES_SQL])


def gazetteer_sql(src: str = ORDS, names: str = NAMES_SQL) -> str:
    """Every place of every name: the lengths of the pieces between its occurrences, summed."""
    unspaced = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED) + "]"

    def inside(a: str, b: str) -> str:
        word = " AND ".join(f"regexp_matches({x}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]') AND NOT regexp_matches({x}, '{unspaced}')" for x in (a, b))
        return f"({word})"

    parts = f"SELECT d.id, n.entity_type, n.phrase, string_split(d.text, n.phrase) AS p FROM {src} d JOIN ({names}) n ON contains(d.text, n.phrase)"
    piece = ("{'i': i, 'n': length(p[i]), 'before': right(CASE WHEN i > 1 THEN concat(phrase, p[i]) ELSE p[i] END, 1), "
             "'after': left(CASE WHEN i + 1 < len(p) THEN concat(p[i + 1], phrase) ELSE p[i + 1] END, 1)}")
    rows = f"SELECT id, entity_type, phrase, unnest([{piece} for i in range(1, len(p))]) AS x FROM ({parts})"
    pos = ("SELECT id, entity_type, phrase, x, CAST(sum(x.n) OVER (PARTITION BY id, entity_type, phrase ORDER BY x.i) "
           f"+ (x.i - 1) * length(phrase) AS INTEGER) AS s FROM ({rows})")
    return (f"SELECT id AS doc_id, entity_type, s AS start, CAST(s + length(phrase) AS INTEGER) AS \"end\", "
            f"CAST({GAZETTEER_SCORE} AS DOUBLE) AS score, phrase AS raw_txt FROM ({pos}) "
            f"WHERE NOT {inside('x.before', 'left(phrase, 1)')} AND NOT {inside('right(phrase, 1)', 'x.after')}")


def named_spans(source: str) -> str:
    """(id, ...) spans of L00 with the names of the gazetteer."""
    extra = f"SELECT doc_id AS id, * EXCLUDE (doc_id) FROM ({gazetteer_sql(SRC[source], ALL_NAMES_SQL)})"
    return detect_duck(SRC[source], C.default_rules(), threshold=C.HANDLER_THRESHOLD, resolve=True, extra=extra)


def fakes_sql(kind: str) -> str:
    parts = " UNION ALL ".join(
        f"(SELECT '{name}' AS corpus, id AS doc_id, start, entity_type, raw_txt FROM ({resolved(name)}))"
        for name in ("documents", "customer", "orders", "forms"))
    parts += f" UNION ALL (SELECT 'names' AS corpus, id AS doc_id, start, entity_type, raw_txt FROM ({named_spans('forms')}))"
    return (f"SELECT corpus, doc_id, start, entity_type, raw_txt, "
            f"{fake_value_sql(DUCK, 'entity_type', 'raw_txt', kind=kind)} AS fake_value FROM ({parts})")


def map_key(entity: str, raw: str) -> str:
    return f"substring(sha256(concat({entity}, '::', {raw})), 1, 32)"


def span_table(source: str) -> str:
    return resolved(source)


def model_pairs_sql() -> str:
    u = f"SELECT entity_type, raw_txt FROM ({span_table('customer')}) UNION ALL SELECT entity_type, raw_txt FROM ({span_table('orders')})"
    return f"SELECT DISTINCT entity_type, raw_txt FROM ({u}) WHERE {route_duck('entity_type')} = 'model'"


def batches_items_sql(batch_size: int = 30, buckets: int = 16) -> str:
    k = (f"SELECT entity_type, raw_txt, {map_key('entity_type', 'raw_txt')} AS map_key FROM ({model_pairs_sql()})")
    b = (f"SELECT *, CAST(('0x' || substring(map_key, 1, 8)) AS BIGINT) % {buckets} AS bucket FROM ({k})")
    rn = f"SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY map_key) - 1 AS rn FROM ({b})"
    return (f"SELECT bucket * 1000000000 + rn // {batch_size} AS batch_id, CAST(rn % {batch_size} AS INTEGER) AS pos, "
            f"entity_type, raw_txt, map_key FROM ({rn})")


def model_batches_sql() -> str:
    items = batches_items_sql()
    header = q(MODEL_PROMPT_HEADER)
    prompts = (f"SELECT batch_id, {header} || chr(10) || string_agg('type=' || entity_type || '; raw=' || raw_txt, chr(10) "
               f"ORDER BY pos) AS prompt FROM ({items}) GROUP BY batch_id")
    return (f"SELECT i.batch_id, i.pos, i.entity_type, i.raw_txt, p.prompt FROM ({items}) i "
            f"JOIN ({prompts}) p ON i.batch_id = p.batch_id")


def parse_batches_sql() -> str:
    # the stand-in reply has one line per item, blank for every 7th; a blank
    # line or one equal to the raw value keeps the raw value
    items = batches_items_sql()
    val = fake_value_sql(DUCK, "entity_type", "raw_txt", kind="tagmap")
    line = f"CASE WHEN pos % 7 = 6 THEN '' ELSE trim({val}) END"
    keep = f"({line}) = '' OR ({line}) = raw_txt"
    return (f"SELECT batch_id, pos, entity_type, raw_txt, CASE WHEN {keep} THEN raw_txt ELSE {line} END AS fake_value, "
            f"CASE WHEN {keep} THEN 'kept' ELSE 'model' END AS route FROM ({items})")


def file_listing_sql() -> str:
    exts = "['txt', 'pdf', 'docx', 'doc', 'md', 'csv', 'html', 'json', 'log', 'bin', 'TXT', '']"
    e = f"({exts})[doc_id % 12 + 1]"
    return (f"SELECT doc_id AS arrival, concat('/in/', source, '/', CASE WHEN doc_id % 17 = 0 THEN '~$' ELSE '' END, "
            f"lang, '_', CAST(doc_id % 97 AS VARCHAR), CASE WHEN {e} = '' THEN '' ELSE concat('.', {e}) END) AS path, "
            f"text FROM documents")


NAME = "regexp_extract(path, '([^/\\\\]*)$', 1)"
SUFFIX = f"regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)"


def output_name_expr() -> str:
    stem = f"CASE WHEN {SUFFIX} = '' THEN {NAME} ELSE regexp_extract({NAME}, '^(.+)\\.[^.]+$', 1) END"
    ext = f"CASE WHEN {SUFFIX} = '' THEN '.txt' ELSE lower({SUFFIX}) END"
    return f"concat({stem}, '_deid', {ext})"


def classify_expr(variant: str) -> str:
    if variant == "backend":
        ext = f"lower({SUFFIX})"
        return f"CASE WHEN {ext} = '.pdf' THEN 'pdf' WHEN {ext} = '.docx' THEN 'docx' ELSE 'text' END"
    name = f"lower({NAME})"
    ext = f"CASE WHEN contains({name}, '.') THEN regexp_extract({name}, '\\.([^.]*)$', 1) ELSE '' END"
    txt = ", ".join(f"'{e}'" for e in LEGACY_TEXT_EXTENSIONS)
    return (f"CASE WHEN {ext} IN ({txt}) THEN 'text' WHEN {ext} = 'docx' THEN 'docx' WHEN {ext} = 'doc' THEN 'doc' "
            f"WHEN {ext} = 'pdf' THEN 'pdf' ELSE 'binary' END")


def manifest_sql() -> str:
    files = (f"SELECT arrival AS id, path, text FROM ({file_listing_sql()}) UNION ALL "
             "SELECT -doc_id - 1000000, concat('/in/forms/f', doc_id, '.txt'), text FROM forms_corpus")
    deid = splice(f"({files})", with_fake(detect_duck(f"({files})", C.default_rules(), threshold=C.HANDLER_THRESHOLD, resolve=True)))
    failed = "d.text_deid IS NULL"
    return (f"SELECT f.path AS src, CASE WHEN {failed} THEN {NAME.replace('path', 'f.path')} ELSE {output_name_expr().replace('path', 'f.path')} END AS file_name, "
            f"{classify_expr('backend').replace('path', 'f.path')} AS type, CASE WHEN {failed} THEN NULL ELSE concat('processed/', "
            f"{output_name_expr().replace('path', 'f.path')}) END AS output_path, CASE WHEN {failed} THEN 'error' ELSE 'ok' END AS status, "
            f"CASE WHEN {failed} THEN 'no text' END AS error FROM ({files}) f JOIN ({deid}) d ON d.id = f.id")


def overlap_sql() -> str:
    raw = detect_duck(CUST, C.default_rules(), threshold=C.HANDLER_THRESHOLD)
    kept = resolve_duck(raw)
    st = 'STRUCT(entity_type VARCHAR, start INTEGER, "end" INTEGER)'
    order = f"{_prio('entity_type')}, score DESC, start, \"end\" - start DESC, entity_type"
    acc = (f"SELECT id, list({{'entity_type': entity_type, 'start': start, 'end': \"end\"}} ORDER BY {order}) AS acc "
           f"FROM ({kept}) GROUP BY id")
    joined = (f"SELECT r.entity_type, r.start, r.\"end\", a.acc FROM ({raw}) r JOIN ({acc}) a ON r.id = a.id")
    is_kept = "len(list_filter(acc, lambda b: b.entity_type = x_type AND b.start = x_start AND b.\"end\" = x_end)) > 0"
    blocker = ("list_filter(acc, lambda b: NOT (x_end <= b.start OR x_start >= b.\"end\") AND NOT "
               "(b.entity_type = x_type AND b.start = x_start AND b.\"end\" = x_end))[1].entity_type")
    rows = (f"SELECT CASE WHEN {is_kept} THEN 'kept' ELSE 'skipped' END AS outcome, x_type AS entity_type, "
            f"CASE WHEN {is_kept} THEN NULL ELSE {blocker} END AS blocked_by FROM "
            f"(SELECT entity_type AS x_type, start AS x_start, \"end\" AS x_end, acc FROM ({joined}))")
    _ = st
    return f"SELECT outcome, entity_type, blocked_by, count(*) AS n FROM ({rows}) GROUP BY ALL"


def _prio(col: str) -> str:
    from shroud.sqloracle import priority_duck
    return priority_duck(col)


def oracle_sql() -> dict[str, str]:
    d = {}
    d["detect_tw_id"] = spans_sql("customer", ["D01"], threshold=None)
    d["detect_ubn"] = spans_sql("customer", ["D02"], threshold=None)
    d["detect_tw_phone"] = spans_sql("customer", ["D03", "D04", "D05", "D06"], threshold=None)
    d["detect_duration"] = spans_sql("customer", [f"D{i:02d}" for i in range(7, 16)], threshold=None)
    d["detect_duration_orders"] = spans_sql("orders", [f"D{i:02d}" for i in range(7, 16)], threshold=None)
    d["detect_tw_home"] = spans_sql("customer", ["D17", "D18", "D19"], threshold=None)
    d["detect_tw_home_parenthesized"] = spans_sql("customer", ["D16"], threshold=None)
    d["detect_mac"] = spans_sql("customer", ["D20", "D21"], threshold=None)
    d["detect_tw_nhi"] = spans_sql("customer", ["D22"], threshold=None)
    d["detect_email"] = spans_sql("documents", ["D30"], threshold=None)
    d["detect_credit_card"] = spans_sql("documents", ["D31"], threshold=None)
    d["detect_ip"] = spans_sql("documents", ["D32", "D32b"], threshold=None)
    d["detect_url"] = spans_sql("urls", ["D33"], threshold=None)
    d["detect_phone"] = spans_sql("documents", ["D34"], threshold=None)
    d["detect_date_time"] = spans_sql("orders", DATE_RULE_IDS, threshold=None)
    d["detect_us_ids"] = spans_sql("documents", ["D38", "D39", "D40", "D41", "D42"], threshold=None)
    d["detect_intl_ids"] = spans_sql("documents", ["D36", "D37", "D43", "D44", "D45", "D46"], threshold=None)
    d["detect_all_customer"] = spans_sql("customer", threshold=None)
    d["detect_forms"] = spans_sql("forms", ALL_RULE_IDS, threshold=None)
    d["detect_forms_resolved"] = spans_sql("forms", threshold=C.HANDLER_THRESHOLD, resolve=True)
    d["detect_url_documents"] = spans_sql("documents", ["D33"], threshold=None)
    d["detect_legacy"] = legacy_sql(DOCS)
    d["detect_legacy_forms"] = legacy_sql(FRMS)
    d["gazetteer_location"] = gazetteer_sql()
    d["gazetteer_forms"] = gazetteer_sql(FRMS, ALL_NAMES_SQL)
    d["gazetteer_long_texts"] = gazetteer_sql(f"(SELECT doc_id AS id, text FROM ({LONG_TEXTS_SQL}))", ALL_NAMES_SQL)
    for source in ("orders", "forms"):
        d[f"detect_{source}_names"] = SPANS_OUT.format(named_spans(source))
        d[f"deidentify_{source}_names"] = splice(SRC[source], with_fake(named_spans(source)), "doc_id")
    d["detect_legacy_names"] = f"({gazetteer_sql()}) UNION ALL {legacy_sql(ORDS)}"
    mail = replace(C.rules_by_id("D24")[0], entity="EMAIL_ADDRESS")
    d["model_detect_python"] = SPANS_OUT.format(detect_duck(DOCS, [mail], threshold=None, context=False, dedupe=False))
    reply = "CASE WHEN reverse(raw_txt) = raw_txt THEN 'kept' ELSE 'model' END"
    d["model_generate_offline"] = (f"SELECT {map_key('entity_type', 'raw_txt')} AS map_key, entity_type, raw_txt, "
                                   f"reverse(raw_txt) AS fake_value, {reply} AS route FROM ({model_pairs_sql()})")
    modelled = (f"SELECT *, CASE WHEN {route_duck('entity_type')} = 'model' AND reverse(raw_txt) <> raw_txt "
                f"THEN reverse(raw_txt) ELSE {routed_duck('entity_type', 'raw_txt')} END AS fake_value FROM ({named_spans('forms')})")
    d["deidentify_model_route"] = splice(FRMS, modelled, "doc_id")
    d["deidentify_forms"] = splice(FRMS, with_fake(resolved("forms")), "doc_id")
    # validation
    ubn = "regexp_extract(text, 'UBN ([0-9]{8})', 1)"
    from shroud.sqloracle import ubn_valid_duck as _uv
    checksum = " + ".join(
        f"((CAST(substr(ubn, {i + 1}, 1) AS INTEGER) * {w}) // 10 + (CAST(substr(ubn, {i + 1}, 1) AS INTEGER) * {w}) % 10)"
        for i, w in enumerate(C.UBN_WEIGHTS))
    d["validate_ubn"] = (f"SELECT doc_id, ubn, CAST({checksum} AS INTEGER) AS checksum, "
                         f"coalesce(regexp_full_match(ubn, '[0-9]{{8}}') AND {_uv('ubn')}, false) AS is_valid "
                         f"FROM (SELECT doc_id, {ubn} AS ubn FROM ({CUSTOMER_CORPUS_SQL}))")
    norm_low = "replace(lower(mac), '-', ':')"
    dotted = (f"concat_ws(':', substr(replace({norm_low}, '.', ''), 1, 2), substr(replace({norm_low}, '.', ''), 3, 2), "
              f"substr(replace({norm_low}, '.', ''), 5, 2), substr(replace({norm_low}, '.', ''), 7, 2), "
              f"substr(replace({norm_low}, '.', ''), 9, 2), substr(replace({norm_low}, '.', ''), 11, 2))")
    d["normalize_mac"] = (f"SELECT doc_id, mac, CASE WHEN contains({norm_low}, '.') THEN {dotted} ELSE {norm_low} END AS normalized, "
                          f"CAST(CASE WHEN {mac_null_duck('mac')} THEN 0.2 ELSE 0.9 END AS DOUBLE) AS score "
                          f"FROM (SELECT doc_id, regexp_extract(text, 'MAC (\\S+)', 1) AS mac FROM ({CUSTOMER_CORPUS_SQL}))")
    d["luhn_cards"] = (f"SELECT doc_id, digits, coalesce({luhn_duck('digits')}, false) AS luhn_ok FROM "
                       f"(SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{13,19}}\\b')) AS digits FROM documents)")
    nhi = C.rules_by_id("D22")
    plain = detect_duck(CUST, nhi, threshold=None, context=False)
    boosted = detect_duck(CUST, nhi, threshold=None, context=True)
    d["context_boost_nhi"] = (f"SELECT p.id AS doc_id, p.start, p.raw_txt, p.score AS score_plain, b.score AS score_boosted "
                              f"FROM ({plain}) p JOIN ({boosted}) b ON p.id = b.id AND p.start = b.start")
    d["threshold_filter"] = spans_sql("documents", threshold=C.HANDLER_THRESHOLD)
    d["select_types"] = spans_sql("documents", threshold=C.HANDLER_THRESHOLD, resolve=True,
                                  entity_types=option_types(["email", "phone"]))
    d["select_all_common"] = spans_sql("documents", threshold=C.HANDLER_THRESHOLD, resolve=True,
                                       entity_types=option_types(list(COMMON_OPTIONS)))
    d["resolve_overlaps"] = spans_sql("customer", threshold=C.HANDLER_THRESHOLD, resolve=True)
    allc = detect_duck(FRMS, C.default_rules(), threshold=None)
    d["best_per_raw_text"] = (f"SELECT id AS doc_id, entity_type, start, \"end\", score, raw_txt FROM (SELECT *, row_number() OVER "
                              f"(PARTITION BY id, raw_txt ORDER BY score DESC, start, \"end\" DESC, entity_type) AS rn FROM ({allc})) WHERE rn = 1")
    d["span_order"] = (f"SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY start DESC, \"end\" - start DESC, "
                       f"entity_type) - 1 AS INTEGER) AS ordinal, start, \"end\" FROM ({resolved('documents')})")
    # generators
    d["fake_local"] = fakes_sql("local")
    d["fake_tagmap"] = fakes_sql("tagmap")
    dt = C.rules_for_entities(["DATE_TIME", "DURATION_TIME"])
    d["fake_legacy_date"] = (f"SELECT id AS doc_id, start, raw_txt, {fake_value_sql(DUCK, 'entity_type', 'raw_txt', kind='legacy_date')} "
                             f"AS fake_value FROM ({detect_duck(DATED, dt, threshold=C.HANDLER_THRESHOLD, resolve=True)})")
    cands = ("SELECT DISTINCT candidate FROM (SELECT n_name AS candidate FROM nation UNION ALL SELECT r_name FROM region "
             "UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_mktsegment FROM customer)")
    d["person_name_check"] = (f"SELECT candidate, {is_likely_person_name_sql(DUCK, 'candidate')} AS likely, "
                              f"{is_likely_person_name_sql(DUCK, 'candidate', strict=True)} AS likely_strict FROM ({cands})")
    d["relative_time_check"] = (f"SELECT id AS doc_id, start, raw_txt, {is_relative_time_sql(DUCK, 'raw_txt')} AS is_relative "
                                f"FROM ({detect_duck(DATED, dt, threshold=None)})")
    # replacement
    d["apply_spans"] = splice(DOCS, with_fake(resolved("documents"), n="concat(CAST(id AS VARCHAR), ':', start)"), "doc_id")
    d["mask"] = splice(DOCS, f"SELECT *, repeat('★', \"end\" - start) AS fake_value FROM ({resolved('documents')})", "doc_id")
    d["keep_dry_run"] = (f"SELECT s.id AS doc_id, coalesce(c.n, 0) AS n_spans, true AS unchanged "
                         f"FROM {FRMS} s LEFT JOIN (SELECT id, count(*) AS n FROM ({resolved('forms')}) GROUP BY id) c ON c.id = s.id")
    d["replace_per_type"] = replace_per_type_sql()
    d["replace_length_preserving"] = length_preserving_sql()
    # mapping
    pairs = (f"SELECT DISTINCT entity_type, raw_txt FROM (SELECT entity_type, raw_txt FROM ({span_table('documents')}) "
             f"UNION ALL SELECT entity_type, raw_txt FROM ({span_table('customer')}))")
    d["mapping_upsert"] = (f"SELECT {map_key('entity_type', 'raw_txt')} AS map_key, entity_type, "
                           f"{routed_duck('entity_type', 'raw_txt')} AS fake_value, {route_duck('entity_type')} AS route FROM ({pairs})")
    prev = f"SELECT DISTINCT {map_key('entity_type', 'raw_txt')} AS map_key FROM ({span_table('documents')})"
    allsp = (f"SELECT entity_type, raw_txt FROM ({span_table('documents')}) UNION ALL "
             f"SELECT entity_type, raw_txt FROM ({span_table('customer')})")
    d["route_counts"] = (f"SELECT CASE WHEN p.map_key IS NOT NULL THEN 'cached' ELSE {route_duck('s.entity_type')} END AS route, "
                         f"count(*) AS n FROM ({allsp}) s LEFT JOIN ({prev}) p ON p.map_key = {map_key('s.entity_type', 's.raw_txt')} "
                         f"GROUP BY ALL")
    d["model_batches"] = model_batches_sql()
    d["parse_batches"] = parse_batches_sql()
    # plans
    d["detect_documents"] = spans_sql("documents", threshold=C.DEFAULT_THRESHOLD, resolve=True)
    d["deidentify_documents"] = splice(DOCS, with_fake(resolved("documents")), "doc_id")
    d["deidentify_stream"] = d["deidentify_documents"]
    mails = spans_sql("customer", ["D30"], threshold=None)
    d["document_isolation"] = ("SELECT c.id AS doc_id, CASE WHEN c.id = m.id THEN NULL ELSE (SELECT count(*) FROM "
                               f"({mails}) s WHERE s.doc_id = c.id) END AS n_spans, CASE WHEN c.id = m.id THEN 'error' ELSE 'ok' END AS status "
                               f"FROM {CUST} c, (SELECT min(c_custkey) AS id FROM customer) m")
    d["text_files"] = ("SELECT concat('doc ', doc_id, '_deid.txt') AS file, 'ok' AS status, sha256(text) AS sha256 "
                       "FROM documents WHERE text IS NOT NULL")
    d["deidentify_pages"] = splice("(SELECT page_id AS id, html AS text FROM pages)",
                                   with_fake(detect_duck("(SELECT page_id AS id, html AS text FROM pages)", C.default_rules(),
                                                         threshold=C.HANDLER_THRESHOLD, resolve=True)), "page_id")
    conv = "(SELECT conv_id * 100000 + turn AS id, text FROM conversations)"
    d["deidentify_conversations"] = (
        f"SELECT c.conv_id, c.turn, x.text_deid FROM conversations c JOIN ("
        f"{splice(conv, with_fake(detect_duck(conv, C.default_rules(), threshold=C.HANDLER_THRESHOLD, resolve=True)), 'id')}"
        f") x ON x.id = c.conv_id * 100000 + c.turn")
    d["deidentify_segments"] = per_segment_sql(layout=False)
    d["deidentify_segments_mapping"] = per_segment_sql(layout=False, stored=True)
    d["deidentify_layout"] = per_segment_sql(layout=True)
    d["deidentify_with_mapping"] = with_mapping_sql()
    d["document_status"] = "SELECT doc_id, CASE WHEN text IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN text IS NULL THEN 'no text' END AS error FROM forms_corpus"
    # text
    d["segments"] = ("SELECT doc_id, CAST(seg_no - 1 AS INTEGER) AS seg_no, CAST(length(seg) AS INTEGER) AS seg_len, "
                     "regexp_replace(seg, '^\\s+|\\s+$', '', 'g') = '' AS is_blank FROM (SELECT doc_id, "
                     "unnest(string_split(text, chr(10))) AS seg, generate_subscripts(string_split(text, chr(10)), 1) AS seg_no "
                     "FROM documents WHERE text IS NOT NULL)")
    d["segment_roundtrip"] = ("SELECT doc_id, array_to_string(string_split(text, chr(10)), chr(10)) = text AS roundtrip_equal "
                              "FROM documents WHERE text IS NOT NULL")
    d["preview"] = (f"SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN text = '' THEN {q(BLANK_MARK)} "
                    f"WHEN length(text) > {PREVIEW_CHARS} THEN substring(text, 1, {PREVIEW_CHARS}) || {q(TRUNCATED_MARK)} "
                    f"ELSE text END AS preview FROM documents")
    nl = "(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))"
    d["line_count"] = (f"SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 1 ELSE {nl} + 1 END AS INTEGER) AS line_count, "
                       f"CAST(least(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {nl} + CASE WHEN suffix(text, chr(10)) "
                       f"THEN 0 ELSE 1 END END, {LINE_COUNT_CAP}) AS INTEGER) AS line_count_capped FROM documents")
    # files
    fl = file_listing_sql()
    d["classify_file_type"] = f"SELECT arrival, path, {classify_expr('backend')} AS type FROM ({fl})"
    d["classify_file_type_legacy"] = f"SELECT arrival, path, {classify_expr('legacy')} AS type FROM ({fl})"
    acc = ", ".join(f"'{e}'" for e in ACCEPTED_EXTENSIONS)
    named = f"SELECT arrival, path, {NAME} AS name FROM ({fl})"
    ok = (f"SELECT * FROM ({named}) WHERE NOT starts_with(name, '~$') AND "
          f"lower(string_split(name, '.')[-1]) IN ({acc})")
    first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY arrival, path) AS rn FROM ({ok})) WHERE rn = 1"
    d["select_input_files"] = f"SELECT arrival, path, name FROM ({first}) ORDER BY arrival, path LIMIT {MAX_FILES}"
    d["output_name"] = f"SELECT arrival, path, {output_name_expr()} AS output_name FROM ({fl})"
    d["manifest"] = manifest_sql()
    d["export_list"] = (f"SELECT DISTINCT regexp_extract(output_path, '([^/\\\\]*)$', 1) AS file, output_path AS src "
                        f"FROM ({manifest_sql()}) WHERE status = 'ok'")
    d["run_summary"] = f"SELECT type, status, count(*) AS n FROM ({manifest_sql()}) GROUP BY ALL"
    # reports
    d["entities_by_type"] = (f"SELECT entity_type, count(*) AS n_spans, count(DISTINCT id) AS n_docs, "
                             f"round(avg(score), 6) AS avg_score FROM ({resolved('documents')}) GROUP BY entity_type")
    d["entities_per_document"] = (f"SELECT s.id AS doc_id, coalesce(c.n, 0) AS n_entities FROM {DOCS} s LEFT JOIN "
                                  f"(SELECT id, count(*) AS n FROM ({resolved('documents')}) GROUP BY id) c ON c.id = s.id")
    d["overlap_report"] = overlap_sql()
    return {name: with_forms(sql) for name, sql in d.items()}


def with_forms(sql: str) -> str:
    """The forms corpus as one common table: written out per rule it would be planned fifty times."""
    return f"WITH forms_corpus AS MATERIALIZED ({FORMS_CORPUS_SQL}) {sql}" if "forms_corpus" in sql else sql


def replace_per_type_sql() -> str:
    """Per document and type, the value made for the last span of the
    type in resolution order (seeded with the document id)."""
    from shroud.operators.replace import LEGACY_GENERATED_TYPES
    from shroud.functions.fakes import Gen, legacy_date_fake_sql, local_fake_sql, FAKE_NAMES, hash_sql

    rel = resolved("customer")
    # every resolution-order key reversed: rk = 1 is the last span in that order
    order = f"{_prio('entity_type')} DESC, score ASC, start DESC, \"end\" - start ASC, entity_type DESC"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY id, entity_type ORDER BY {order}) AS rk FROM ({rel})"
    last = f"SELECT id, entity_type, raw_txt AS last_raw FROM ({ranked}) WHERE rk = 1"
    h = hash_sql(DUCK, "s.entity_type", "l.last_raw", n="CAST(s.id AS VARCHAR)")
    g = Gen(DUCK, h)
    gen = ", ".join(f"'{t}'" for t in LEGACY_GENERATED_TYPES)
    val = (f"CASE WHEN s.entity_type = 'DATE_TIME' THEN {legacy_date_fake_sql(DUCK, 'l.last_raw', h)} "
           f"WHEN s.entity_type = 'PERSON' THEN {g.pick(FAKE_NAMES, 7)} "
           f"WHEN s.entity_type IN ({gen}) THEN {local_fake_sql(DUCK, 's.entity_type', 'l.last_raw', h)} ELSE l.last_raw END")
    spans = (f"SELECT s.id, s.entity_type, s.start, s.\"end\", s.score, s.raw_txt, {val} AS fake_value FROM ({rel}) s "
             f"JOIN ({last}) l ON l.id = s.id AND l.entity_type = s.entity_type")
    return splice(CUST, spans, "doc_id")


def length_preserving_sql() -> str:
    from shroud.functions.fakes import hash_sql, tagmap_fake_sql

    rel = resolved("customer")
    best = (f"SELECT id, raw_txt, entity_type AS best_type FROM (SELECT *, row_number() OVER (PARTITION BY id, raw_txt "
            f"ORDER BY score DESC, start) AS rn FROM ({rel})) WHERE rn = 1")
    h = hash_sql(DUCK, "b.best_type", "s.raw_txt")
    gen = tagmap_fake_sql(DUCK, "b.best_type", "s.raw_txt", h)
    n = "CAST(length(s.raw_txt) AS INTEGER)"
    val = f"CASE WHEN s.entity_type = 'ORGANIZATION' THEN s.raw_txt ELSE rpad(substring({gen}, 1, {n}), {n}, ' ') END"
    spans = (f"SELECT s.id, s.entity_type, s.start, s.\"end\", s.score, s.raw_txt, {val} AS fake_value FROM ({rel}) s "
             f"JOIN ({best}) b ON b.id = s.id AND b.raw_txt = s.raw_txt")
    inner = splice(CUST, spans, "doc_id")
    return (f"SELECT x.doc_id, x.text_deid, length(x.text_deid) = length(c.text) AS same_length FROM ({inner}) x "
            f"JOIN ({CUSTOMER_CORPUS_SQL}) c ON c.doc_id = x.doc_id")


def per_segment_sql(layout: bool, stored: bool = False) -> str:
    """Detection and replacement per newline-separated segment,
    reassembled in order (segment id = doc_id * 100000 + seg_no)."""
    from shroud.functions.fakes import hash_sql, tagmap_fake_sql

    segs = ("SELECT doc_id, doc_id * 100000 + seg_no AS id, seg_no, seg AS text FROM (SELECT doc_id, "
            "unnest(string_split(text, chr(10))) AS seg, generate_subscripts(string_split(text, chr(10)), 1) AS seg_no "
            "FROM documents WHERE text IS NOT NULL)")
    src = f"(SELECT id, text FROM ({segs}))"
    rel = detect_duck(src, C.default_rules(), threshold=C.HANDLER_THRESHOLD, resolve=True)
    if layout:
        best = (f"SELECT id, raw_txt, entity_type AS best_type FROM (SELECT *, row_number() OVER (PARTITION BY id, raw_txt "
                f"ORDER BY score DESC, start) AS rn FROM ({rel})) WHERE rn = 1")
        gen = tagmap_fake_sql(DUCK, "b.best_type", "s.raw_txt", hash_sql(DUCK, "b.best_type", "s.raw_txt"))
        n = "CAST(length(s.raw_txt) AS INTEGER)"
        val = f"CASE WHEN s.entity_type = 'ORGANIZATION' THEN s.raw_txt ELSE rpad(substring({gen}, 1, {n}), {n}, ' ') END"
        spans = (f"SELECT s.id, s.entity_type, s.start, s.\"end\", s.score, s.raw_txt, {val} AS fake_value FROM ({rel}) s "
                 f"JOIN ({best}) b ON b.id = s.id AND b.raw_txt = s.raw_txt")
    else:
        spans = with_fake(rel)
    if stored:  # the whole-document spans of the same table made the mapping
        key = map_key("f.entity_type", "f.raw_txt")
        known = f"SELECT DISTINCT {map_key('entity_type', 'raw_txt')} AS k FROM ({span_table('documents')})"
        spans = (f"SELECT f.id, f.entity_type, f.start, f.\"end\", f.score, f.raw_txt, CASE WHEN m.k IS NOT NULL THEN "
                 f"'<' || substring(m.k, 1, 6) || '>' ELSE f.fake_value END AS fake_value FROM ({spans}) f "
                 f"LEFT JOIN ({known}) m ON m.k = {key}")
    done = splice(src, spans, "id")
    joined = f"SELECT g.doc_id, g.seg_no, x.text_deid FROM ({segs}) g JOIN ({done}) x ON x.id = g.id"
    agg = f"SELECT doc_id, string_agg(text_deid, chr(10) ORDER BY seg_no) AS text_deid FROM ({joined}) GROUP BY doc_id"
    if not layout:
        return agg
    return (f"SELECT a.doc_id, a.text_deid, length(a.text_deid) = length(d.text) AS same_length FROM ({agg}) a "
            f"JOIN documents d ON d.doc_id = a.doc_id")


def with_mapping_sql() -> str:
    """Stored values equal the generator's (they were made by it), so the
    text equals the map-only result; spans whose key is stored count as
    cached."""
    both = ("(SELECT concat('documents:', CAST(doc_id AS VARCHAR)) AS id, text FROM documents UNION ALL "
            f"SELECT concat('customer:', CAST(id AS VARCHAR)) AS id, text FROM {CUST})")
    rel = detect_duck(both, C.default_rules(), threshold=C.HANDLER_THRESHOLD, resolve=True)
    text = splice(both, with_fake(rel), "doc_id")
    prev = f"SELECT DISTINCT {map_key('entity_type', 'raw_txt')} AS map_key FROM ({span_table('documents')})"
    cached = (f"SELECT r.id, count(p.map_key) AS n FROM ({rel}) r LEFT JOIN ({prev}) p "
              f"ON p.map_key = {map_key('r.entity_type', 'r.raw_txt')} GROUP BY r.id")
    return (f"SELECT t.doc_id, t.text_deid, CAST(coalesce(c.n, 0) AS BIGINT) AS n_cached FROM ({text}) t "
            f"LEFT JOIN ({cached}) c ON c.id = t.doc_id")
