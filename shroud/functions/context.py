"""Context boost (C01) as an expression.

Contract: a span gains ``boost`` (capped at 1.0, rounded to 2 decimals) when
one of its rule's context words occurs, case-insensitively, in the
``window`` characters before the span.  Latin words count as whole words,
CJK words as substrings.
"""

from __future__ import annotations

import re

from shroud.catalog import CONTEXT_BOOST, CONTEXT_WINDOW
from shroud.functions.spans import PIECE_CHARS, lit_sql

_META = re.compile(r"([\\.^$|?*+()\[\]{}])")


def _is_cjk(word: str) -> bool:
    return any(ord(ch) >= 0x2E80 for ch in word)


def _esc(word: str) -> str:
    return _META.sub(r"\\\1", word)


def context_regex(words, java: bool = True) -> str | None:
    """Regex for 'any context word'; Java (Unicode) or RE2 (DuckDB) flavour."""
    if not words:
        return None
    latin = [_esc(w) for w in words if not _is_cjk(w)]
    cjk = [_esc(w) for w in words if _is_cjk(w)]
    parts = []
    if latin:
        # Java checks a first letter faster than a Unicode word boundary
        first = "(?=[" + "".join(sorted({w[0].lower() for w in words if not _is_cjk(w)})) + "])" if java else ""
        parts.append(first + r"\b(?:" + "|".join(latin) + r")\b")
    parts.extend(cjk)
    flags = "(?iU)" if java else "(?i)"
    return flags + "(?:" + "|".join(parts) + ")"


def window_before_sql(pieces: str, start: str, window: int = CONTEXT_WINDOW) -> str:
    """The ``window`` characters before a 0-based ``start`` offset, from the text's pieces
    (:func:`pieces_sql`): they lie in two neighbouring ones, wherever in the text that is."""
    n = piece_chars(window)
    lo = f"greatest({start} - {int(window)}, 0)"
    first, last = f"CAST({lo} DIV {n} AS int)", f"CAST({start} DIV {n} AS int)"
    near = f"concat(get({pieces}, {first}), CASE WHEN {last} > {first} THEN get({pieces}, {last}) ELSE '' END)"
    return f"substring({near}, {lo} - {first} * {n} + 1, {start} - {lo})"


def piece_chars(window: int) -> int:
    return max(PIECE_CHARS, int(window))


def boosted_sql(score: str, pieces: str, start: str, words, window: int = CONTEXT_WINDOW,
                boost: float = CONTEXT_BOOST, allow: str | None = None) -> str:
    rx = context_regex(words)
    if rx is None:
        return score
    hit = f"{window_before_sql(pieces, start, window)} RLIKE {lit_sql(rx)}"
    if allow is not None:
        hit = f"({hit}) AND ({allow})"
    return f"CASE WHEN {hit} THEN round(least({score} + {float(boost)}D, 1.0D), 2) ELSE {score} END"
