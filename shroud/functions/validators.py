"""Check digits and normalisers as Catalyst expressions.

Each ``*_sql`` builder returns Spark SQL text over an input SQL expression;
the plain-named wrappers return ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shroud.catalog import UBN_WEIGHTS


def _digit(s: str, pos: int) -> str:
    return f"try_cast(substring({s}, {pos}, 1) AS int)"


def ubn_checksum_sql(s: str) -> str:
    """Sum of the digit sums of digit x weight."""
    terms = []
    for i, w in enumerate(UBN_WEIGHTS):
        p = f"({_digit(s, i + 1)} * {w})"
        terms.append(f"({p} div 10 + {p} % 10)")
    return "(" + " + ".join(terms) + ")"


def ubn_valid_sql(s: str) -> str:
    """Unified business number check, following the reference's code: the
    (sum+1) alternative applies when the 7th digit x 4 reaches 10."""
    total = ubn_checksum_sql(s)
    return (
        f"coalesce({s} RLIKE '^[0-9]{{8}}$' AND ({total} % 10 = 0 OR "
        f"({_digit(s, 7)} * 4 >= 10 AND ({total} + 1) % 10 = 0)), false)"
    )


def normalize_mac_sql(s: str) -> str:
    """Lower case, '-' -> ':', Cisco dotted -> colon pairs."""
    low = f"translate(lower({s}), '-', ':')"
    dotted = f"regexp_replace(translate({low}, '.', ''), r'(..)(?=.)', '$1:')"
    return f"CASE WHEN instr({low}, '.') > 0 THEN {dotted} ELSE {low} END"


def mac_is_null_sql(s: str) -> str:
    return f"({normalize_mac_sql(s)} IN ('00:00:00:00:00:00', 'ff:ff:ff:ff:ff:ff'))"


def mac_score_sql(s: str, score: str) -> str:
    """All-zero / all-f -> min(score, .20), else max(score, .90)."""
    return f"CASE WHEN {mac_is_null_sql(s)} THEN least({score}, 0.20D) ELSE greatest({score}, 0.90D) END"


def digits_only_sql(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn_sql(s: str) -> str:
    """Luhn on the digits of ``s`` (built-in ``luhn_check``)."""
    return f"coalesce(luhn_check({digits_only_sql(s)}), false)"


def iban_valid_sql(s: str, v: str = "ib") -> str:
    """ISO 13616 mod-97 = 1 over the rearranged, letter-expanded string."""
    u = f"upper(regexp_replace({s}, r'\\s', ''))"
    moved = f"concat(substring({u}, 5), substring({u}, 1, 4))"
    chars = f"filter(split({moved}, '', -1), {v}c -> {v}c != '')"
    step = (
        f"({v}a, {v}d) -> CASE WHEN {v}d RLIKE '^[0-9]$' THEN ({v}a * 10 + cast({v}d AS bigint)) % 97 "
        f"ELSE ({v}a * 100 + (ascii({v}d) - 55)) % 97 END"
    )
    rem = f"aggregate({chars}, cast(0 AS bigint), {step})"
    return f"coalesce({rem} = 1 AND {u} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$', false)"


def nhs_valid_sql(s: str) -> str:
    """UK NHS number mod-11 on its 10 digits."""
    d = digits_only_sql(s)
    total = " + ".join(f"{_digit(d, i + 1)} * {10 - i}" for i in range(9))
    check = f"(11 - ({total}) % 11)"
    check = f"(CASE WHEN {check} = 11 THEN 0 ELSE {check} END)"
    return f"coalesce(length({d}) = 10 AND {check} != 10 AND {check} = {_digit(d, 10)}, false)"


VALIDATORS_SQL = {"ubn": ubn_valid_sql, "luhn": luhn_sql, "iban": iban_valid_sql, "nhs": nhs_valid_sql}


def _col(name: str) -> str:
    return f"`{name}`"


def ubn_valid(col: str) -> Column:
    return F.expr(ubn_valid_sql(_col(col)))


def normalize_mac(col: str) -> Column:
    return F.expr(normalize_mac_sql(_col(col)))


def luhn_valid(col: str) -> Column:
    return F.expr(luhn_sql(_col(col)))


def iban_valid(col: str) -> Column:
    return F.expr(iban_valid_sql(_col(col)))


def nhs_valid(col: str) -> Column:
    return F.expr(nhs_valid_sql(_col(col)))
