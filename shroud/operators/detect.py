"""Detection: rule catalog -> ``array<span>`` column, in projections.

``detect`` = trigger -> D* (regex + validation) -> C01 context boost -> duplicate
removal -> C02 threshold -> (optionally) C03 type selection -> O01 overlap
resolution.  It is a chain of projections: no shuffle, no Python worker, so it
scales with the number of input partitions.  Every step of a rule's matches goes
into a column of all rules, so that what the rules share -- the trigger, the offsets
of the matches, the text cut into pieces -- is planned and computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.catalog import CONTEXT_BOOST, CONTEXT_WINDOW, DEFAULT_THRESHOLD, LEGACY_RULES, Rule, default_rules
from shroud.functions.context import boosted_sql, piece_chars
from shroud.functions.spans import PAIR_DDL, SPAN_DDL, empty_spans_sql, ends_sql, first_sql, lit_sql, pairs_sql, pieces_sql
from shroud.functions.trigger import low_rules, lower_sql, may_match_sql, trigger_sql
from shroud.functions.validators import VALIDATORS_SQL, mac_is_null_sql, mac_score_sql
from shroud.operators.resolve import dedupe_contained_sql, resolve_overlaps_sql

LOWER_COL, TRIGGER_COL, FIRST_COL = "_shroud_lower", "_shroud_trigger", "_shroud_first"
PAIRS_COL, PIECES_COL = "_shroud_pairs", "_shroud_pieces"


def all_pairs_sql(text: str, rules: tuple[Rule, ...], trigger: str | None = None, first: str | None = None) -> str:
    """One array of matches for each rule (see ``pairs_sql``); ``first`` is the array of :func:`all_first_sql`."""
    only_ascii = None if trigger is None else f"{trigger}.ascii"
    pairs = [pairs_sql(text, r.java, v=f"r{i}", pre=may_match_sql(text, r, trigger), ascii=only_ascii, plain=r.java_ascii,
                       first=None if first is None else f"{first}[{i}]") for i, r in enumerate(rules)]
    return f"array({', '.join(pairs)})" if pairs else f"CAST(array() AS array<{PAIR_DDL}>)"


def all_ends_sql(pairs: str, rules: tuple[Rule, ...]) -> str:
    """The matches of each rule with their end offsets (:func:`ends_sql`), where any rule has more than one match."""
    sizes = ", ".join(f"size({pairs}[{i}])" for i in range(len(rules)))
    many = f"greatest({sizes}) > 1" if len(rules) > 1 else f"{sizes} > 1" if rules else "false"
    return f"CASE WHEN {many} THEN transform({pairs}, rp -> {ends_sql('rp')}) ELSE {pairs} END"


def all_first_sql(text: str, rules: tuple[Rule, ...], trigger: str, low: tuple[Rule, ...] = ()) -> str:
    """The place of the first match of each rule, 0 where there is none."""
    places = [first_sql(text, r.java, r.java_ascii, f"{trigger}.ascii", may_match_sql(text, r, trigger, low)) for r in rules]
    return f"array({', '.join(places)})" if places else "CAST(array() AS array<int>)"


def any_first_sql(first: str) -> str:
    return f"exists({first}, fp -> fp > 0)"


def all_pieces_sql(text: str, first: str, window: int = CONTEXT_WINDOW) -> str:
    """The text in pieces, where anything matched at all; a short text is a piece."""
    n = piece_chars(window)
    return f"CASE WHEN length({text}) <= {n} THEN array({text}) WHEN {any_first_sql(first)} THEN {pieces_sql(text, n)} ELSE CAST(array() AS array<string>) END"


def rule_spans_sql(pairs: str, pieces: str, rule: Rule, context: bool = True, window: int = CONTEXT_WINDOW,
                   boost: float = CONTEXT_BOOST, v: str = "r") -> str:
    """Spans of one rule from its matches with their ends (:func:`all_ends_sql`): validator -> context boost."""
    m, x = pairs, f"{v}s"
    start = f"({x}.n - length({x}.m))"
    if rule.validator in VALIDATORS_SQL:
        m = f"filter({m}, {x} -> {VALIDATORS_SQL[rule.validator](f'{x}.m')})"
    score = "0.98D" if rule.validator == "ubn" else f"{float(rule.score)}D"
    allow = None
    if rule.validator == "mac":
        score = mac_score_sql(f"{x}.m", score)
        allow = f"NOT {mac_is_null_sql(f'{x}.m')}"
    if context and rule.context:
        score = boosted_sql(score, pieces, start, rule.context, window, boost, allow)
    span = (
        f"named_struct('entity_type', '{rule.entity}', 'start', {start}, 'end', {x}.n, "
        f"'score', CAST({score} AS double), 'raw_txt', {x}.m)"
    )
    return f"CASE WHEN size({pairs}) = 0 THEN {empty_spans_sql()} ELSE transform({m}, {x} -> {span}) END"


def threshold_sql(spans: str, threshold: float, v: str = "th") -> str:
    """Keep ``score >= threshold``."""
    return f"filter({spans}, {v} -> {v}.score >= {float(threshold)}D)"


def select_types_sql(spans: str, entity_types: Iterable[str] | None, v: str = "st") -> str:
    """C03 on an array column: keep only spans whose type is selected."""
    if entity_types is None:
        return spans
    types = sorted(set(entity_types))
    if not types:
        return empty_spans_sql()
    inlist = ", ".join(f"'{t}'" for t in types)
    return f"filter({spans}, {v} -> {v}.entity_type IN ({inlist}))"


def raw_spans_sql(pairs: str, pieces: str, rules: tuple[Rule, ...], *, context: bool = True, window: int = CONTEXT_WINDOW,
                  boost: float = CONTEXT_BOOST, extra_spans: str | None = None) -> str:
    """All spans of the rules, before duplicates, threshold and resolution.

    ``pairs`` and ``pieces`` are the arrays of :func:`all_ends_sql` and
    :func:`all_pieces_sql`.  ``extra_spans`` is an array of spans found elsewhere (names
    of a gazetteer, D48, or of a model, D49); they pass through duplicate
    removal, threshold, type selection and resolution like any other."""
    parts = [rule_spans_sql(f"{pairs}[{i}]", pieces, r, context, window, boost, v=f"r{i}") for i, r in enumerate(rules)]
    if extra_spans is not None:
        parts.append(f"coalesce(CAST({extra_spans} AS {SPAN_DDL}), {empty_spans_sql()})")
    if not parts:
        return empty_spans_sql()
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def span_steps(threshold: float | None = DEFAULT_THRESHOLD, dedupe: bool = True, resolve: bool = False,
               entity_types: Iterable[str] | None = None) -> list[Callable[[str], str]]:
    """What happens to raw spans, as SQL builders to be applied one after the other.

    Each goes into a column of its own: one expression of all steps nests so many
    lambdas that the analyzer needs seconds, or gives up; the optimizer puts the
    columns together again."""
    types = None if entity_types is None else tuple(entity_types)
    steps: list[Callable[[str], str]] = []
    if threshold is not None or types is not None:
        # a span is dropped as a duplicate for one of its type with no less score, so this may come before;
        # the size keeps the optimizer from putting the making of spans into the lambda's evaluation
        steps.append(lambda arr: f"CASE WHEN size({arr}) = 0 THEN {arr} ELSE "
                                 f"{select_types_sql(arr if threshold is None else threshold_sql(arr, threshold), types)} END")
    if dedupe:
        steps.append(lambda arr: f"CASE WHEN size({arr}) <= 1 THEN {arr} ELSE array_distinct({arr}) END")
        steps.append(lambda arr: dedupe_contained_sql(arr, ordered=not resolve))
    if resolve:
        steps.append(resolve_overlaps_sql)
    return steps


def any_match_sql(text: str, rules: tuple[Rule, ...], trigger: str | None = None) -> str:
    """True when at least one rule's regex matches somewhere in ``text``.

    A document-level gate for per-segment plans, for rules of the catalog only:
    they hold no anchors, and before a segment their guards see a newline, which
    is as good to them as the start of the text.  So a match inside a segment is
    a match in the whole text.  Nothing of that kind is known of other rules;
    with any of them there is no gate."""
    known = {r.java for r in default_rules(include_disabled=True)}
    if any(r.java not in known for r in rules):
        return "true"
    conds = []
    for r in rules:
        pre = may_match_sql(text, r, trigger)
        rx = f"{text} RLIKE {lit_sql(r.java)}"
        if trigger is not None:
            rx = f"(CASE WHEN {trigger}.ascii THEN {text} RLIKE {lit_sql(r.java_ascii)} ELSE {rx} END)"
        conds.append(f"({pre} AND {rx})" if pre else f"({rx})")
    return "(" + " OR ".join(conds) + ")" if conds else "false"


def with_trigger(df: DataFrame, text_col: str, rules: tuple[Rule, ...], low: tuple[Rule, ...] = ()) -> DataFrame:
    text = f"`{text_col}`"
    lower = df.withColumn(LOWER_COL, F.expr(lower_sql(text)))
    return lower.withColumn(TRIGGER_COL, F.expr(trigger_sql(text, rules, LOWER_COL, low))).drop(LOWER_COL)


def detect(df: DataFrame, text_col: str = "text", rules: Iterable[Rule] | None = None, *, out: str = "spans",
           threshold: float | None = DEFAULT_THRESHOLD, context: bool = True, dedupe: bool = True, resolve: bool = False,
           entity_types: Iterable[str] | None = None, window: int = CONTEXT_WINDOW, boost: float = CONTEXT_BOOST,
           extra_spans: str | None = None) -> DataFrame:
    """Add an ``array<span>`` column holding the detected entities."""
    rules = tuple(default_rules() if rules is None else rules)
    text, extra = f"`{text_col}`", f"`{extra_spans}`" if extra_spans else None
    low = low_rules(rules, threshold, context)
    d = with_trigger(df, text_col, rules, low)
    d = d.withColumn(FIRST_COL, F.expr(all_first_sql(text, rules, TRIGGER_COL, low)))
    d = d.withColumns({PAIRS_COL: F.expr(all_pairs_sql(text, rules, TRIGGER_COL, FIRST_COL)), PIECES_COL: F.expr(all_pieces_sql(text, FIRST_COL, window))})
    d = d.withColumn(PAIRS_COL, F.expr(all_ends_sql(PAIRS_COL, rules)))
    d = d.withColumn(out, F.expr(raw_spans_sql(PAIRS_COL, PIECES_COL, rules, context=context, window=window, boost=boost, extra_spans=extra)))
    d = d.drop(TRIGGER_COL, FIRST_COL, PAIRS_COL, PIECES_COL)
    for step in span_steps(threshold, dedupe, resolve, entity_types):
        d = d.withColumn(out, F.expr(step(f"`{out}`")))
    return d


def legacy_spans_sql(pairs: str, names_spans: str | None = None) -> str:
    """Union of the legacy regexes (+ optional named-entity spans),
    ordered by start; score 1.0, no overlap resolution, duplicates kept.
    Ties on ``start`` keep the reference's insertion order (named entities,
    then PHONE patterns, EMAIL, ID), which the (k, i) sort key encodes."""
    parts = []
    if names_spans is not None:
        parts.append(f"transform({names_spans}, (lz, li) -> named_struct('s', lz, 'k', 0, 'i', li))")
    for k, rule in enumerate(LEGACY_RULES, start=1):
        spans = rule_spans_sql(f"{pairs}[{k - 1}]", "", rule, context=False, v=f"l{k}")
        parts.append(f"transform({spans}, (lz, li) -> named_struct('s', lz, 'k', {k}, 'i', li))")
    allp = "concat(" + ", ".join(parts) + ")"
    cmp = ("CASE WHEN la.s.start < lb.s.start THEN -1 WHEN la.s.start > lb.s.start THEN 1 "
           "WHEN la.k < lb.k THEN -1 WHEN la.k > lb.k THEN 1 WHEN la.i < lb.i THEN -1 WHEN la.i > lb.i THEN 1 ELSE 0 END")
    return f"transform(array_sort({allp}, (la, lb) -> {cmp}), lq -> lq.s)"


def detect_legacy(df: DataFrame, text_col: str = "text", out: str = "spans", names_col: str | None = None) -> DataFrame:
    names = f"`{names_col}`" if names_col else None
    d = with_trigger(df, text_col, LEGACY_RULES)
    d = d.withColumn(PAIRS_COL, F.expr(all_pairs_sql(f"`{text_col}`", LEGACY_RULES, TRIGGER_COL)))
    d = d.withColumn(PAIRS_COL, F.expr(all_ends_sql(PAIRS_COL, LEGACY_RULES)))
    return d.withColumn(out, F.expr(legacy_spans_sql(PAIRS_COL, names))).drop(TRIGGER_COL, PAIRS_COL)
