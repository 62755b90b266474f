"""DuckDB oracle SQL for the span detectors.

Independent re-statement of detection in DuckDB SQL (RE2 regexes, list
functions), used by ``__spark_entry__.oracle_sql`` and the tests to check the
Spark plans.  It shares only the catalog's *data* (patterns, scores, words)
with the Spark side, not its expressions.

RE2 differs from Java: no lookaround / backreference (the catalog carries a
rewritten ``re2`` spelling per rule, with a consumed prefix group standing in
for a lookbehind) and ASCII ``\\b``/``\\d`` (equal to the Unicode forms on the
driver's data, where no non-ASCII letter touches a digit).
"""

from __future__ import annotations

from shroud.catalog import CONTEXT_BOOST, CONTEXT_WINDOW, DEFAULT_PRIORITY, PRIORITY, UBN_WEIGHTS, Rule
from shroud.functions.context import context_regex


def q(s: str) -> str:
    """DuckDB string literal (no backslash escapes in DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


def ubn_valid_duck(r: str) -> str:
    terms = []
    for i, w in enumerate(UBN_WEIGHTS):
        p = f"(CAST(substr({r}, {i + 1}, 1) AS INTEGER) * {w})"
        terms.append(f"({p} // 10 + {p} % 10)")
    total = "(" + " + ".join(terms) + ")"
    seventh = f"CAST(substr({r}, 7, 1) AS INTEGER) * 4"
    return f"({total} % 10 = 0 OR ({seventh} >= 10 AND ({total} + 1) % 10 = 0))"


def digits_duck(r: str) -> str:
    return f"regexp_replace({r}, '[^0-9]', '', 'g')"


def luhn_duck(r: str) -> str:
    d = f"reverse({digits_duck(r)})"
    term = (
        f"lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({d}, i + 1, 1) AS INTEGER) "
        f"ELSE (CASE WHEN CAST(substr({d}, i + 1, 1) AS INTEGER) * 2 > 9 "
        f"THEN CAST(substr({d}, i + 1, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr({d}, i + 1, 1) AS INTEGER) * 2 END) END"
    )
    return f"(length({d}) > 0 AND list_sum(list_transform(range(length({d})), {term})) % 10 = 0)"


def iban_duck(r: str) -> str:
    u = f"upper(regexp_replace({r}, '\\s', '', 'g'))"
    moved = f"(substr({u}, 5) || substr({u}, 1, 4))"
    step = ("lambda a, c: CASE WHEN regexp_full_match(c, '[0-9]') THEN (a * 10 + CAST(c AS BIGINT)) % 97 "
            "ELSE (a * 100 + (ascii(c) - 55)) % 97 END")
    rem = f"list_reduce(string_split({moved}, ''), {step}, CAST(0 AS BIGINT))"
    return f"({rem} = 1 AND regexp_full_match({u}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+'))"


def nhs_duck(r: str) -> str:
    d = digits_duck(r)
    total = " + ".join(f"CAST(substr({d}, {i + 1}, 1) AS INTEGER) * {10 - i}" for i in range(9))
    chk = f"(11 - ({total}) % 11)"
    chk = f"(CASE WHEN {chk} = 11 THEN 0 ELSE {chk} END)"
    return f"(length({d}) = 10 AND {chk} != 10 AND {chk} = CAST(substr({d}, 10, 1) AS INTEGER))"


def mac_null_duck(r: str) -> str:
    return f"(lower(regexp_replace({r}, '[-:.]', '', 'g')) IN ('000000000000', 'ffffffffffff'))"


VALIDATORS_DUCK = {"ubn": ubn_valid_duck, "luhn": luhn_duck, "iban": iban_duck, "nhs": nhs_duck}


def window_duck(text: str, start: str, window: int = CONTEXT_WINDOW) -> str:
    lo = f"greatest({start} - {window}, 0)"
    return f"substring({text}, {lo} + 1, {start} - {lo})"


def rule_spans_duck(src: str, rule: Rule, context: bool = True, window: int = CONTEXT_WINDOW,
                    boost: float = CONTEXT_BOOST) -> str:
    """(id, entity_type, start, "end", score, raw_txt) for one rule over
    ``src`` (a relation with columns id, text)."""
    rx = q(rule.duck)
    inner = (
        f"SELECT id, text, regexp_extract_all(text, {rx}, 0) AS ms, regexp_extract_all(text, {rx}, 1) AS ps, "
        f"regexp_extract_all(text, {rx}, 2) AS bs, regexp_split_to_array(text, {rx}) AS gs "
        f"FROM {src} WHERE regexp_matches(text, {rx})"
    )
    pos = (
        "length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) + length(ps[i])"
    )
    hits = (
        f"SELECT id, text, CAST({pos} AS INTEGER) AS start, bs[i] AS raw_txt "
        f"FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({inner}))"
    )
    cond = "TRUE"
    if rule.validator in VALIDATORS_DUCK:
        cond = VALIDATORS_DUCK[rule.validator]("raw_txt")
    score = "0.98" if rule.validator == "ubn" else repr(float(rule.score))
    allow = "TRUE"
    if rule.validator == "mac":
        score = f"(CASE WHEN {mac_null_duck('raw_txt')} THEN least({score}, 0.20) ELSE greatest({score}, 0.90) END)"
        allow = f"NOT {mac_null_duck('raw_txt')}"
    if context and rule.context:
        crx = q(context_regex(rule.context, java=False))
        hit = f"regexp_matches({window_duck('text', 'start', window)}, {crx}) AND {allow}"
        score = f"(CASE WHEN {hit} THEN round(least({score} + {boost}, 1.0), 2) ELSE {score} END)"
    return (
        f"SELECT id, '{rule.entity}' AS entity_type, start, CAST(start + length(raw_txt) AS INTEGER) AS \"end\", "
        f"CAST({score} AS DOUBLE) AS score, raw_txt FROM ({hits}) WHERE {cond}"
    )


def priority_duck(col: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())
    return f"(CASE {col} {arms} ELSE {DEFAULT_PRIORITY} END)"


def detect_duck(src: str, rules, *, threshold: float | None = 0.5, context: bool = True, dedupe: bool = True,
                resolve: bool = False, entity_types=None, extra: str | None = None) -> str:
    """Span table (id, entity_type, start, "end", score, raw_txt); ``extra`` is
    a relation of further spans (names)."""
    union = " UNION ALL ".join(f"({rule_spans_duck(src, r, context)})" for r in rules)
    if extra is not None:
        union += f" UNION ALL (SELECT id, entity_type, start, \"end\", score, raw_txt FROM ({extra}))"
    rel = f"SELECT * FROM ({union})"
    if dedupe:
        # a span is dropped when an earlier span (score desc, start asc,
        # longer first) of the same type contains it
        numbered = (
            f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, start, \"end\" - start DESC, "
            f"entity_type) AS rn FROM ({rel})"
        )
        rel = (
            f"SELECT x.id, x.entity_type, x.start, x.\"end\", x.score, x.raw_txt FROM ({numbered}) x "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({numbered}) k WHERE k.id = x.id AND k.entity_type = x.entity_type "
            f"AND k.rn < x.rn AND k.start <= x.start AND x.\"end\" <= k.\"end\")"
        )
    if threshold is not None:
        rel = f"SELECT * FROM ({rel}) WHERE score >= {float(threshold)}"
    if entity_types is not None:
        inlist = ", ".join(f"'{t}'" for t in sorted(set(entity_types))) or "NULL"
        rel = f"SELECT * FROM ({rel}) WHERE entity_type IN ({inlist})"
    if resolve:
        rel = resolve_duck(rel)
    return rel


def resolve_duck(rel: str) -> str:
    """O01 greedy resolution with ``list_reduce`` over the sorted span list."""
    st = "STRUCT(entity_type VARCHAR, start INTEGER, \"end\" INTEGER, score DOUBLE, raw_txt VARCHAR)"
    lst = (
        f"list({{'entity_type': entity_type, 'start': start, 'end': \"end\", 'score': score, 'raw_txt': raw_txt}} "
        f"ORDER BY {priority_duck('entity_type')}, score DESC, start, \"end\" - start DESC, entity_type)"
    )
    greedy = (
        f"list_reduce(sp, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: NOT (x.\"end\" <= a.start "
        f"OR x.start >= a.\"end\"))) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS {st}[]))"
    )
    return (
        f"SELECT id, s.entity_type AS entity_type, s.start AS start, s.\"end\" AS \"end\", s.score AS score, "
        f"s.raw_txt AS raw_txt FROM (SELECT id, unnest({greedy}) AS s FROM "
        f"(SELECT id, {lst} AS sp FROM ({rel}) GROUP BY id))"
    )
