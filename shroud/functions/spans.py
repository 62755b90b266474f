"""Native span extraction: all matches of a Java regex with code-point offsets.

Spark has no "regexp with positions".  ``regexp_extract_all(text, re, 0)``
returns the matches and ``split(text, re, -1)`` the gaps between them; both
walk the same ``Matcher.find()`` sequence, so a match ends where the lengths of
the gaps and matches up to it sum to.  ``pairs_sql`` keeps these lengths, and
``ends_sql`` turns them into offsets with running sums in short pieces
(``scan_sql``): the work grows with the number of matches.  The whole thing sits
behind an ``rlike`` guard, so documents without a hit pay one regex scan only.
Everything stays a JVM expression (no Python worker); patterns must not match the
empty string.

Offsets are 0-based, end exclusive, in code points -- the same as Python
slicing and Spark's ``substring``/``length``.  ``substring`` walks a text from its
start; ``pieces_sql`` cuts it once into pieces of equal length, in which any
position is found in constant time.

Expressions are produced as Spark SQL text and parsed once with ``F.expr``:
building a catalog-sized expression tree through the Python ``Column`` API
costs one py4j round trip per node (seconds for the full catalog), a single
parse costs milliseconds.  The resulting plan is identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH_DDL = "array<struct<start:int,`end`:int,raw:string>>"
SPAN_DDL = "array<struct<entity_type:string,start:int,`end`:int,score:double,raw_txt:string>>"

MATCH_TYPE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("raw", T.StringType()),
    ]
)
SPAN_TYPE = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("raw_txt", T.StringType()),
    ]
)
SPAN_ARRAY = T.ArrayType(SPAN_TYPE)


def lit_sql(s: str) -> str:
    """A Spark SQL raw string literal holding ``s`` verbatim."""
    if "'" not in s:
        return "r'" + s + "'"
    if '"' not in s:
        return 'r"' + s + '"'
    raise ValueError(f"cannot quote {s!r} as a raw literal")


def str_sql(s: str) -> str:
    """An ordinary (escaped) Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def empty_spans_sql() -> str:
    return f"CAST(array() AS {SPAN_DDL})"


def empty_spans() -> Column:
    return F.expr(empty_spans_sql())


def let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


SCAN_PIECE = 128
SCAN_SHORT = 10


def scan_sql(values: str, op: str, zero: str, v: str) -> str:
    """Running results of an associative ``op`` over the int array ``values``.

    ``op`` is SQL over the variables ``{v}l`` and ``{v}r``.  Appending to an
    array copies it, so a plain fold over n values costs n * n; here each piece
    of ``SCAN_PIECE`` values appends to its own short array and starts from the
    totals of the pieces before it.  An array of few values, as most are, needs no
    pieces: each place folds what comes up to it."""
    arr, t, c, acc, x = (f"{v}{k}" for k in ("arr", "t", "c", "acc", "x"))
    l, r, n = f"{v}l", f"{v}r", SCAN_PIECE
    fold = f"({l}, {r}) -> CAST({op} AS int)"
    piece = f"slice({arr}, {c} * {n} + 1, {n})"
    step = op.replace(l, f"{acc}.p").replace(r, x)
    init = f"named_struct('p', aggregate(slice({t}, 1, {c}), {zero}, {fold}), 'out', CAST(array() AS array<int>))"
    part = (f"aggregate({piece}, {init}, ({acc}, {x}) -> named_struct('p', CAST({step} AS int), "
            f"'out', concat({acc}.out, array(CAST({step} AS int)))), {acc} -> {acc}.out)")
    pieces = f"sequence(0, CAST((size({arr}) - 1) DIV {n} AS int))"
    totals = f"transform({pieces}, {c} -> aggregate({piece}, {zero}, {fold}))"
    long = let_sql(totals, t, f"flatten(transform({pieces}, {c} -> {part}))")
    short = f"transform({arr}, ({x}, {c}) -> aggregate(slice({arr}, 1, {c} + 1), {zero}, {fold}))"
    return let_sql(values, arr, f"CASE WHEN size({arr}) <= 1 THEN {arr} WHEN size({arr}) <= {SCAN_SHORT} THEN {short} ELSE {long} END")


PAIR_DDL = "array<struct<n:int,m:string>>"


#: stands for a match where the text is cut into gaps
MARK = r"'\u0001'"


def pairs_sql(text: str, pattern: str, v: str = "m", pre: str | None = None, ascii: str | None = None, plain: str | None = None,
              first: str | None = None) -> str:
    """SQL for ``array<struct<n,m>>``: every match ``m`` of ``pattern`` in the SQL
    expression ``text``, ``n`` being its length and that of the gap before it.
    ``v`` prefixes the lambda variables; ``pre`` is a cheap boolean checked before
    the regex guard.  ``ascii`` tells that the text is ASCII only: then the place of
    an only match is that of its first code unit, and no gaps are needed.  ``plain`` is
    a pattern with the same matches in such a text, ``first`` the place that
    :func:`first_sql` found, which stands for the guard.

    ``split`` compiles its pattern anew for each text, but not a single character; so matches
    are replaced by one (in texts without it) and the text is cut there."""
    p, q = lit_sql(pattern), lit_sql(plain or pattern)
    gaps = (f"CASE WHEN contains({text}, {MARK}) THEN split({text}, {p}, -1) "
            f"ELSE split(regexp_replace({text}, {p}, {MARK}), {MARK}, -1) END")
    pairs = (f"filter(zip_with({v}a, {gaps}, ({v}m, {v}g) -> "
             f"named_struct('n', length({v}g) + length({v}m), 'm', {v}m)), {v}p -> {v}p.m IS NOT NULL)")
    found = f"regexp_extract_all({text}, {p}, 0)"
    if ascii is not None:
        found = found if plain is None else f"CASE WHEN {ascii} THEN regexp_extract_all({text}, {q}, 0) ELSE {found} END"
        only = f"array(named_struct('n', {first or f'regexp_instr({text}, {q})'} - 1 + length({v}a[0]), 'm', {v}a[0]))"
        pairs = f"CASE WHEN size({v}a) = 1 AND {ascii} THEN {only} ELSE {pairs} END"
    pairs = let_sql(found, f"{v}a", pairs)
    cond = f"{first} > 0" if first else f"{text} RLIKE {p}" if pre is None else f"({pre}) AND {text} RLIKE {p}"
    return f"CASE WHEN {cond} THEN {pairs} ELSE CAST(array() AS {PAIR_DDL}) END"


def first_sql(text: str, pattern: str, plain: str, ascii: str, pre: str | None = None) -> str:
    """The place (from 1, in code units) of the first match, 0 where there is none: what ``RLIKE``
    finds out, and in an ASCII text the offset of an only match, too.  ``plain`` as in ``pairs_sql``."""
    place = f"CASE WHEN {ascii} THEN regexp_instr({text}, {lit_sql(plain)}) ELSE regexp_instr({text}, {lit_sql(pattern)}) END"
    return f"coalesce({place}, 0)" if pre is None else f"CASE WHEN {pre} THEN coalesce({place}, 0) ELSE 0 END"


def ends_sql(pairs: str, v: str = "es") -> str:
    """``pairs`` with the end offset of each match as ``n``; an only match has it there."""
    ends = scan_sql(f"transform({pairs}, {v}x -> {v}x.n)", f"{v}sl + {v}sr", "0", f"{v}s")
    placed = f"zip_with({pairs}, {ends}, ({v}x, {v}e) -> named_struct('n', {v}e, 'm', {v}x.m))"
    return f"CASE WHEN size({pairs}) <= 1 THEN {pairs} ELSE {placed} END"


#: any place in so few characters is found by walking there
PIECE_CHARS = 512


def pieces_sql(text: str, chars: int = PIECE_CHARS) -> str:
    """The text in pieces of ``chars`` code points."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{chars}}}', 0)"


DIGIT_RE = r"(?U)\d"


def explode_nonempty(df, keep_cols, array_col, alias: str = "s", pos: str | None = None):
    """``explode`` of a computed array without re-computing it.

    For a plain ``explode`` the optimizer infers ``size(array) > 0`` and
    pushes that filter below the projection that computes the array --
    i.e. onto the scan, evaluating the whole (expensive) array expression a
    second time.  ``explode_outer`` + a null filter on the generated column
    has the same result and nothing to push down."""
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    gen = F.posexplode_outer(arr).alias(pos, alias) if pos else F.explode_outer(arr).alias(alias)
    return df.select(*keep_cols, gen).filter(F.col(alias).isNotNull())


def explode_spans(df, id_cols, spans_col: str = "spans", keep=()):
    """Span table: one row per span, plain columns."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    extra = list(keep)
    return explode_nonempty(df, ids + extra, spans_col).select(
        *ids, *extra, "s.entity_type", "s.start", "s.end", "s.score", "s.raw_txt"
    )
