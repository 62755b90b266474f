"""One pass over a text that tells which rules may match.

The trigger is a struct, computed once per row before any rule's regex:

* ``digit``, ``wide``, ``at``, ``ascii``: the text holds a Unicode digit, a character of
  the East Asian blocks, an ``@``; it holds ASCII characters only.
* ``url``, ``hex``: ``://``; two groups of hex digits around ``.``, ``:`` or ``-``
  (a search that stops at such a character only).
* ``relative``: a part of a relative-time word, see :func:`stems`.
* ``glued``: an ASCII letter right before a digit, or a letter that is not ASCII anywhere.
* ``WORDS``: one of the words of that name, in texts with digits.
* ``context_<rule>``: a context word of a rule that reaches the threshold with one only
  (:func:`low_rules`).
* ``runs``: bit n is set where the text holds a whole run of n digits (bit 40: of 40
  or more).

A rule names what each of its matches must hold; where the trigger lacks it, the
rule's regex does not run.  Words are looked for in the lower-cased text
(:func:`lower_sql`), which is computed once for all of them.
"""

from __future__ import annotations

import re

from shroud.catalog import Rule
from shroud.functions.fakes import RELATIVE_TIME_WORDS
from shroud.functions.spans import DIGIT_RE, let_sql, lit_sql, str_sql

#: parts of words that the matches of some rules with digits hold, by the flag's name
WORDS = {
    "unit": ("year", "month", "week", "day"),
    "ago": ("ago",),
    "old": ("old",),
    "experience": ("experience",),
    "job": ("work", "service", "employment"),
    "about": ("over", "under", "about", "around", "approximately", "roughly"),
    "month": ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
}
FLAGS = ("digit", "wide", "at", "url", "hex", "relative", "glued", *WORDS)
LONGEST_RUN = 40
WIDE_RE = r"[\x{2E80}-\x{10FFFF}]"
HEX_RE = r"[.:-](?<=[0-9A-Fa-f][.:-])[0-9A-Fa-f]{1,4}[.:-](?=[0-9A-Fa-f])"


def stems(words) -> tuple[str, ...]:
    """Parts of the phrases' last words (the first ones are common), such that each phrase holds one.

    Each part is cut from a word that no earlier part covers: a piece of five letters (or
    a shorter word), or one of three where that covers half a dozen words; of these
    the one that most words left hold.  Other short pieces stand in most texts."""
    left = sorted({w.split(" ")[-1] for w in words if w.isascii()})
    out: list[str] = []
    while left:
        word = left[0]
        pieces = {word[i : i + 5] for i in range(max(1, len(word) - 4))}
        pieces |= {p for i in range(len(word) - 2) if sum((p := word[i : i + 3]) in w for w in left) >= 6}
        best = max(sorted(pieces), key=lambda p: (sum(p in w for w in left), len(p)))
        out.append(best)
        left = [w for w in left if best not in w]
    return tuple(p for p in out if not any(q != p and q in p for q in out))


#: each match holds one of these as it stands; what lies before a weekday may be any blanks
RELATIVE_PHRASES = (*(w for w in RELATIVE_TIME_WORDS if w.isascii()), *(f"{d}day" for d in ("mon", "tues", "wednes", "thurs", "fri", "satur", "sun")))
RELATIVE_STEMS = stems(RELATIVE_PHRASES)


#: what a case-blind regex takes for an ASCII letter, though lower() does not give that letter
FOLDED_RE = r"[\x{130}\x{131}\x{17F}\x{212A}]"


def is_ascii_sql(text: str) -> str:
    return f"octet_length({text}) = length({text})"


def lower_sql(text: str) -> str:
    """The lower-cased text; null where a case-blind regex may see letters in it that this does not."""
    return f"CASE WHEN {is_ascii_sql(text)} OR NOT {text} RLIKE {lit_sql(FOLDED_RE)} THEN lower({text}) END"


def low_rules(rules: tuple[Rule, ...], threshold: float | None, context: bool = True) -> tuple[Rule, ...]:
    """Rules whose spans all stay below the threshold where the text holds none of their context words.

    The threshold drops these spans, and they take none of a higher score with them; so where no such word
    is, the rule need not run."""
    if threshold is None or not context:
        return ()
    return tuple(r for r in rules if r.context and r.score < threshold and r.validator not in ("mac", "ubn"))


def _holds(text: str, lower: str, words: tuple[str, ...]) -> str:
    """Whether any of the words occurs, in whatever case: plain searches, or a regex in texts with odd letters."""
    odd = f"{text} RLIKE {lit_sql('(?iU)' + '|'.join(re.escape(w) for w in words))}"
    return f"(CASE WHEN {lower} IS NULL THEN {odd} ELSE {_contains(lower, words)} END)"


def _contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {str_sql(w)})" for w in words) + ")"


def _holds_relative(text: str, lower: str) -> str:
    """Whether a stem occurs; a short one, as in ``days``, counts only with a phrase that holds it."""
    least = sorted(w for w in RELATIVE_PHRASES if not any(o != w and o in w for o in RELATIVE_PHRASES))
    short = [p for p in RELATIVE_STEMS if len(p) <= 3 and sum(p in w for w in least) > 1]
    plain = [_contains(lower, [p for p in RELATIVE_STEMS if p not in short])]
    plain += [f"({_contains(lower, (p,))} AND {_contains(lower, [w for w in least if p in w])})" for p in short]
    odd = f"{text} RLIKE {lit_sql('(?iU)' + '|'.join(RELATIVE_STEMS))}"
    return f"(CASE WHEN {lower} IS NULL THEN {odd} ELSE {' OR '.join(plain)} END)"


def trigger_sql(text: str, rules: tuple[Rule, ...], lower: str | None = None, low: tuple[Rule, ...] = ()) -> str:
    """The trigger of a text, as far as the rules look at it; ``lower`` names the column of its :func:`lower_sql`,
    ``low`` those rules that need a context word (:func:`low_rules`)."""
    if lower is None:
        return let_sql(lower_sql(text), "tgl", trigger_sql(text, rules, "tgl", low))
    used = {f for r in rules for f in r.flags} | {"digit" for r in rules if r.needs_digit}
    used |= {"at" for r in rules if "@" in r.literals} | {"url" for r in rules if "://" in r.literals}
    runs = any(r.runs for r in rules)
    digits = (f"CASE WHEN {is_ascii_sql(text)} THEN regexp_extract_all({text}, '[0-9]+', 0) "
              f"ELSE regexp_extract_all({text}, {lit_sql(DIGIT_RE + '+')}, 0) END")
    lengths = f"aggregate({digits}, 0L, (tga, tgx) -> tga | shiftleft(1L, least(length(tgx), {LONGEST_RUN})))"
    always = {"wide": f"NOT ({is_ascii_sql(text)}) AND {text} RLIKE {lit_sql(WIDE_RE)}", "at": f"contains({text}, '@')",
              "url": f"contains({text}, '://')", "hex": f"{text} RLIKE {lit_sql(HEX_RE)}", "relative": _holds_relative(text, lower)}

    def build(digit: bool) -> str:
        found = {"digit": "true", "glued": f"NOT ({is_ascii_sql(text)}) OR {text} RLIKE '[A-Za-z][0-9]'"} if digit else {}
        found |= {f: _holds(text, lower, w) for f, w in WORDS.items()} if digit else {}
        values = {f: always.get(f) or found.get(f, "false") if f in used else "false" for f in FLAGS} | {"ascii": is_ascii_sql(text)}
        values |= {f"context_{r.rule_id}": _holds(text, lower, tuple(w.lower() for w in r.context)) if digit or not r.needs_digit else "false" for r in low}
        mask = lengths if runs and digit else "0L"
        return "named_struct(" + ", ".join(f"'{f}', coalesce({v}, false)" for f, v in values.items()) + f", 'runs', coalesce({mask}, 0L))"

    if not used & {"digit", "glued", *WORDS} and not runs:
        return build(False)
    digit = f"{text} RLIKE '[0-9]' OR (NOT ({is_ascii_sql(text)}) AND {text} RLIKE {lit_sql(DIGIT_RE)})"
    return f"CASE WHEN {digit} THEN {build(True)} ELSE {build(False)} END"


def may_match_sql(text: str, rule: Rule, trigger: str | None, low: tuple[Rule, ...] = ()) -> str | None:
    """What the rule needs, as a condition on trigger and text; None if nothing is known."""
    conds, literals = [], rule.literals
    if trigger is not None and rule in low:
        conds.append(f"{trigger}.context_{rule.rule_id}")
    if trigger is not None:
        flags = [f for f, on in (("digit", rule.needs_digit), ("at", "@" in literals), ("url", "://" in literals)) if on] + list(rule.flags)
        conds += [f"{trigger}.{f}" for f in flags]
        for lengths in rule.runs:
            mask = sum(1 << min(n, LONGEST_RUN) for n in set(lengths))
            conds.append(f"({trigger}.runs & {mask}L) <> 0")
        if literals in (("@",), ("://",)):
            literals = ()
    if literals and trigger is not None and not any(x.isascii() for x in literals):
        conds.append(f"NOT {trigger}.ascii")
    if literals:
        conds.append("(" + " OR ".join(f"contains({text}, {str_sql(x)})" for x in literals) + ")")
    return " AND ".join(conds) if conds else None
