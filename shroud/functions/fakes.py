"""Deterministic fake-value generators (G01-G23) as SQL expressions.

The reference draws unseeded random values.  Our contract is deterministic:

    h = sha256(seed)   seed = "type::raw"  (or "salt::type::raw", or + "::n")

digits come from ``translate(substr(h, ..), 'abcdef', '012345')`` and list
picks from ``hex(substr(h, .., 4)) % size``.  With an empty salt the first 32
hex characters of ``h`` are exactly the mapping key of the reference's
mapping store, so "same (type, raw) -> same value" holds across documents,
runs and engines without any join.  A salt is required in production use:
unsalted short values (phone numbers) are guessable from the key.

Every builder takes a :class:`Dialect` so that the same contract is emitted
as Spark SQL (the engine) and DuckDB SQL (the oracle).
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (ours, not the reference's: it calls a fake-data library).
# ---------------------------------------------------------------------------
FAKE_NAMES = (
    "Alice Chen", "Brian Lee", "Carla Diaz", "David Wang", "Emma Brown", "Farid Khan", "Grace Liu",
    "Henry Moore", "Ines Garcia", "Jonas Weber", "Kim Tran", "Laura Rossi", "Marco Silva", "Nora Berg",
    "Omar Haddad", "Paula Novak", "Quinn Walsh", "Rosa Marin", "Sam Carter", "Tara Singh",
)
FAKE_ADDRESSES = (
    "12 Elm Street, Springfield", "45 Oak Avenue, Riverton", "7 Pine Road, Lakeside", "88 Maple Drive, Fairview",
    "31 Cedar Lane, Hillcrest", "5 Birch Court, Brookfield", "240 Harbor Way, Bayview", "19 Mill Road, Oakdale",
    "63 River Street, Ashford", "102 Park Place, Greenville",
)
FAKE_URL_WORDS = ("alpha", "bravo", "cedar", "delta", "ember", "fjord", "grove", "harbor", "iris", "juniper")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UNSUPPORTED_PREFIX = "未支援標籤: "
EMAIL_CONSTANT = "user@example.com"
DATE_SPAN_DAYS = 20000  # fake dates fall in 1970-01-01 .. 2024-10-04

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: the relative-time words and
# patterns that the DATE_TIME replacer keeps unchanged (G05; words are tested as
# substrings of the lower-cased, stripped span), and the person-name form words
# and form-field patterns.
# ---------------------------------------------------------------------------
RELATIVE_TIME_WORDS = (
    "today", "tomorrow", "yesterday", "now", "tonight",
    "this morning", "this afternoon", "this evening", "this noon",
    "last night", "yesterday morning", "yesterday afternoon", "yesterday evening",
    "tomorrow morning", "tomorrow afternoon", "tomorrow evening", "tomorrow night",
    "this week", "this month", "this year", "this quarter", "this semester",
    "next week", "next month", "next year", "next quarter", "next semester",
    "last week", "last month", "last year", "last quarter", "last semester",
    "recently", "lately", "soon", "later", "earlier", "before", "after",
    "currently", "presently", "nowadays", "these days", "right now",
    "just now", "a moment ago", "a while ago", "in a while", "shortly",
    "今天", "明天", "昨天", "現在", "今晚", "今夜",
    "今早", "今天早上", "今天上午", "今天中午", "今天下午", "今天晚上",
    "昨天早上", "昨天上午", "昨天中午", "昨天下午", "昨天晚上", "昨晚",
    "明天早上", "明天上午", "明天中午", "明天下午", "明天晚上", "明晚",
    "這週", "這個星期", "這個月", "這一個月", "今年", "這一年",
    "下週", "下個星期", "下個月", "下一個月", "明年", "下一年",
    "上週", "上個星期", "上個月", "上一個月", "去年", "上一年",
    "最近", "近來", "稍後", "等等", "等一下", "之前", "之後", "以前", "以後",
    "目前", "現階段", "當前", "眼前", "剛才", "剛剛", "一會兒", "待會兒",
)
RELATIVE_TIME_PATTERNS = (
    r"\b(in|within)\s+\d+\s+(days?|weeks?|months?|years?)\b",
    r"\b\d+\s+(days?|weeks?|months?|years?)\s+(ago|from now)\b",
    r"\bthis\s+(coming|past)\s+(week|month|year)\b",
    r"\b(next|last)\s+\w+(day|week|end)\b",
    r"\b(early|late)\s+(this|next|last)\s+(week|month|year)\b",
    r"\b幾天(前|後|內)\b",
    r"\b\d+天(前|後|內)\b",
    r"\b(下|上)(周|月|年)(初|中|末)\b",
)

# Person-name plausibility (G09): form words, and form-field patterns.
NON_PERSON_KEYWORDS = (
    "email", "mail", "address", "phone", "number", "id", "card",
    "password", "user", "admin", "account", "login", "register",
    "submit", "send", "click", "here", "link", "url", "http",
    "www", "com", "org", "net", "gov", "edu",
    "file", "document", "pdf", "doc", "txt",
    "company", "corporation", "inc", "ltd", "llc",
    "street", "avenue", "road", "drive", "lane",
    "city", "state", "country", "zip", "postal",
    "contact", "information", "details", "form",
    "name", "first", "last", "full", "given",
)
FORM_FIELD_PATTERNS = (
    r"^(first|last|full)\s*(name)?$",
    r"^name\s*(field)?$",
    r"^email\s*(address)?$",
    r"^phone\s*(number)?$",
    r"^contact\s*(info|information)?$",
)


@dataclass(frozen=True)
class Dialect:
    name: str  # "spark" | "duck"

    def s(self, v: str) -> str:
        """String literal."""
        if self.name == "spark":
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + v.replace("'", "''") + "'"

    def rx(self, v: str) -> str:
        """Regex literal (Java needs (?U) for Unicode classes)."""
        if self.name == "spark":
            v = "(?U)" + v
            return ("r'" + v + "'") if "'" not in v else ('r"' + v + '"')
        return "'" + v.replace("'", "''") + "'"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.name == "spark" else f"sha256({x})"

    def hexint(self, x: str) -> str:
        if self.name == "spark":
            return f"CAST(conv({x}, 16, 10) AS BIGINT)"
        return f"CAST(('0x' || {x}) AS BIGINT)"

    def rlike(self, x: str, pattern: str) -> str:
        if self.name == "spark":
            return f"({x} RLIKE {self.rx(pattern)})"
        return f"regexp_matches({x}, {self.rx(pattern)})"

    def regexp_extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.rx(pattern)}, {group})"

    def pick(self, items, idx: str) -> str:
        arr = ", ".join(self.s(i) for i in items)
        if self.name == "spark":
            return f"element_at(array({arr}), CAST({idx} AS INT) + 1)"
        return f"([{arr}])[{idx} + 1]"

    def date_from_days(self, days: str) -> str:
        if self.name == "spark":
            return f"date_format(date_add(DATE'1970-01-01', CAST({days} AS INT)), 'yyyy-MM-dd')"
        return f"strftime(DATE '1970-01-01' + CAST({days} AS INTEGER), '%Y-%m-%d')"

    def datetime_from_secs(self, secs: str) -> str:
        if self.name == "spark":
            return f"date_format(timestampadd(SECOND, CAST({secs} AS INT), TIMESTAMP'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\")"
        return f"strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST({secs} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"

    def chars_map_digits(self, x: str, digits: str) -> str:
        """Replace every ASCII digit of ``x`` by the digit of ``digits`` at the
        same position (1-based)."""
        if self.name == "spark":
            return (
                f"array_join(transform(split({x}, '', -1), (dc, di) -> CASE WHEN dc BETWEEN '0' AND '9' "
                f"THEN substring({digits}, di + 1, 1) ELSE dc END), '')"
            )
        return (
            f"array_to_string(list_transform(string_split({x}, ''), lambda dc, di: CASE WHEN regexp_full_match(dc, '[0-9]') "
            f"THEN substring({digits}, di, 1) ELSE dc END), '')"
        )


SPARK = Dialect("spark")
DUCK = Dialect("duck")


def seed_sql(d: Dialect, entity: str, raw: str, salt: str = "", n: str | None = None) -> str:
    parts = ([d.s(salt)] if salt else []) + [entity, raw] + ([f"CAST({n} AS VARCHAR)" if d.name == "duck" else f"CAST({n} AS STRING)"] if n else [])
    return "concat(" + ", '::', ".join(parts) + ")"


def map_key_sql(d: Dialect, entity: str, raw: str) -> str:
    """Mapping-store key: first 32 hex chars of sha256('type::raw')."""
    return f"substring({d.sha256(seed_sql(d, entity, raw))}, 1, 32)"


class Gen:
    """Building blocks over one hash expression ``h`` (64 hex chars)."""

    def __init__(self, d: Dialect, h: str):
        self.d, self.h = d, h

    def digits(self, off: int, k: int) -> str:
        # 64 hex chars -> up to 64 digits; offsets are 1-based
        return f"translate(substring({self.h}, {off}, {k}), 'abcdef', '012345')"

    def num(self, off: int, mod: int) -> str:
        return f"({self.d.hexint(f'substring({self.h}, {off}, 6)')} % {mod})"

    def pick(self, items, off: int) -> str:
        return self.d.pick(items, self.num(off, len(items)))


def luhn_complete_sql(d: Dialect, payload: str, n: int) -> str:
    """``payload`` (n digits) followed by its Luhn check digit."""
    def dig(pos_from_right: str) -> str:
        return f"CAST(substring({payload}, {n} + 1 - ({pos_from_right}), 1) AS INT)"

    term_i = (f"CASE WHEN {{i}} % 2 = 1 THEN (CASE WHEN {dig('{i}')} * 2 > 9 THEN {dig('{i}')} * 2 - 9 "
              f"ELSE {dig('{i}')} * 2 END) ELSE {dig('{i}')} END")
    total = " + ".join("(" + term_i.replace("{i}", str(i)) + ")" for i in range(1, n + 1))
    check = f"((10 - (({total}) % 10)) % 10)"
    return f"concat({payload}, CAST({check} AS {'STRING' if d.name == 'spark' else 'VARCHAR'}))"


def is_relative_time_sql(d: Dialect, raw: str) -> str:
    """Relative expressions are kept unchanged."""
    t = f"lower(trim({raw}))"
    if d.name == "spark":  # one search each, instead of a hundred calls in a method too long to be compiled
        # a word that holds another one is found by that
        least = [w for w in RELATIVE_TIME_WORDS if not any(o != w and o in w for o in RELATIVE_TIME_WORDS)]
        begins = "(?=[" + "".join(sorted({w[0] for w in least})) + "])"
        found = f"({d.rlike(t, begins + '(?:' + '|'.join(least) + ')')} OR {d.rlike(t, '|'.join(f'(?:{p})' for p in RELATIVE_TIME_PATTERNS))})"
        # each word and pattern holds a letter: in ASCII texts, what upper() changes
        return f"(CASE WHEN octet_length({raw}) = length({raw}) AND {t} = upper({raw}) THEN false ELSE {found} END)"
    words = " OR ".join(f"instr({t}, {d.s(w)}) > 0" for w in RELATIVE_TIME_WORDS)
    pats = " OR ".join(d.rlike(t, p) for p in RELATIVE_TIME_PATTERNS)
    return f"({words} OR {pats})"


def is_likely_person_name_sql(d: Dialect, raw: str, strict: bool = False) -> str:
    """G09.  ``strict`` reproduces the reference (keywords as substrings,
    Latin letters only); the default tests keywords as whole words and
    keeps non-Latin names eligible (fix F6)."""
    t = f"lower(trim({raw}))"
    if strict:
        kw = " OR ".join(f"instr({t}, {d.s(k)}) > 0" for k in NON_PERSON_KEYWORDS)
        allowed = d.rlike(t, r"^[a-z \-'.]+$")
    else:
        kw = d.rlike(t, r"\b(?:" + "|".join(NON_PERSON_KEYWORDS) + r")\b")
        allowed = d.rlike(t, r"^[\pL\pM \-'.]+$")
    form = " OR ".join(d.rlike(t, p) for p in FORM_FIELD_PATTERNS)
    has_digit = d.rlike(t, r"\d")
    return (f"(NOT ({kw}) AND NOT {has_digit} AND {allowed} AND length({t}) BETWEEN 2 AND 50 "
            f"AND NOT ({form}))")


def duration_fake_sql(d: Dialect, raw: str, g: Gen) -> str:
    """Every occurrence of the first whole-word integer -> n in 1..20."""
    first = d.regexp_extract(raw, r"\b(\d+)\b", 1)
    n = f"CAST(1 + {g.num(1, 20)} AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"
    return f"(CASE WHEN {first} = '' THEN {raw} ELSE replace({raw}, {first}, {n}) END)"


def mac_fake_sql(g: Gen) -> str:
    pairs = [f"substring({g.h}, {i}, 2)" for i in range(21, 33, 2)]
    return "concat(" + ", ':', ".join(pairs) + ")"


def ipv4_fake_sql(d: Dialect, g: Gen) -> str:
    octs = [f"CAST({d.hexint(f'substring({g.h}, {i}, 2)')} AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"
            for i in (41, 43, 45, 47)]
    return "concat(" + ", '.', ".join(octs) + ")"


def tw_home_fake_sql(d: Dialect, raw: str, g: Gen) -> str:
    """Keep the area code and punctuation, replace the other digits."""
    area = d.regexp_extract(raw, r"^(\+886\s?\d{1,2}|\(?\s?0\d{1,3}\s?\)?)", 1)
    rest = f"substring({raw}, length({area}) + 1)"
    chars = f"substring({g.h}, 1, length({rest}))" if d.name == "spark" else g.h  # so many are looked at
    digits = f"translate({chars}, 'abcdef', '012345')"
    return f"concat({area}, {d.chars_map_digits(rest, digits)})"


def local_fake_sql(d: Dialect, entity: str, raw: str, h: str, strict_names: bool = False) -> str:
    """Per-type generator of the local replacer (G01-G18, G21, G22-free).

    ``entity``/``raw`` are SQL expressions; ``h`` is the hash expression."""
    g = Gen(d, h)
    date = f"(CASE WHEN {is_relative_time_sql(d, raw)} THEN {raw} ELSE {d.date_from_days(g.num(1, DATE_SPAN_DAYS))} END)"
    person = f"(CASE WHEN {is_likely_person_name_sql(d, raw, strict_names)} THEN {g.pick(FAKE_NAMES, 7)} ELSE {raw} END)"
    card = luhn_complete_sql(d, f"concat('4', {g.digits(1, 14)})", 15)
    arms = [
        ("EMAIL_ADDRESS", d.s(EMAIL_CONSTANT)),
        ("DURATION_TIME", duration_fake_sql(d, raw, g)),
        ("PHONE_NUMBER", f"concat('(', {g.digits(11, 3)}, ') 555-', {g.digits(14, 4)})"),
        ("DATE_TIME", date),
        ("UK_NHS", f"concat({g.digits(1, 3)}, ' ', {g.digits(4, 3)}, ' ', {g.digits(7, 4)})"),
        ("CREDIT_CARD", card),
        ("PERSON", person),
        ("LOCATION", g.pick(FAKE_ADDRESSES, 13)),
        ("IP_ADDRESS", ipv4_fake_sql(d, g)),
        ("URL", f"concat('https://', {g.pick(FAKE_URL_WORDS, 19)}, '.example/')"),
        ("MAC_ADDRESS", mac_fake_sql(g)),
        ("UNIFIED_BUSINESS_NO", g.digits(1, 8)),
        ("TW_ID_NUMBER", f"concat({g.pick(tuple(LETTERS), 25)}, CAST(1 + {g.num(31, 2)} AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), {g.digits(41, 8)})"),
        ("TW_PHONE_NUMBER", f"concat('09', {g.digits(1, 8)})"),
        ("TW_HEALTH_INSURANCE", f"concat('0000', {g.digits(1, 6)})"),
        ("TW_NHI_NUMBER", f"concat('0000', {g.digits(1, 8)})"),
        ("TW_PASSPORT_NUMBER", f"concat('3', {g.digits(1, 7)})"),
    ]
    body = " ".join(f"WHEN {d.s(k)} THEN {v}" for k, v in arms)
    return f"(CASE {entity} {body} ELSE {raw} END)"


def tagmap_fake_sql(d: Dialect, entity: str, raw: str, h: str) -> str:
    """Tag-map generators of the layout path and the model route's offline
    default (G19, G20, G23); unknown tags give the 'unsupported' literal."""
    g = Gen(d, h)
    vc = "STRING" if d.name == "spark" else "VARCHAR"
    arms = [
        ("CREDIT_CARD", luhn_complete_sql(d, f"concat('4', {g.digits(1, 14)})", 15)),
        ("PERSON", g.pick(FAKE_NAMES, 7)),
        ("CRYPTO", d.sha256(g.h)),
        ("PHONE_NUMBER", f"concat('(', {g.digits(11, 3)}, ') 555-', {g.digits(14, 4)})"),
        ("DATE_TIME", d.datetime_from_secs(g.num(1, DATE_SPAN_DAYS * 86400))),
        ("EMAIL_ADDRESS", f"concat('user', {g.digits(21, 4)}, '@example.com')"),
        ("URL", f"concat('https://', {g.pick(FAKE_URL_WORDS, 19)}, '.example/')"),
        ("IBAN_CODE", f"concat('GB', {g.digits(1, 2)}, 'BANK', {g.digits(3, 14)})"),
        ("IP_ADDRESS", ipv4_fake_sql(d, g)),
        ("LOCATION", g.pick(FAKE_ADDRESSES, 13)),
        ("US_BANK_NUMBER", g.digits(1, 12)),
        ("US_DRIVER_LICENSE", f"concat({g.pick(tuple(LETTERS), 25)}, {g.pick(tuple(LETTERS), 31)}, {g.pick(tuple(LETTERS), 37)}, '-', {g.digits(43, 4)})"),
        ("US_ITIN", f"concat('9', {g.digits(1, 8)})"),
        ("US_PASSPORT", f"concat({g.pick(tuple(LETTERS), 25)}, {g.digits(1, 8)})"),
        ("US_SSN", f"concat({g.digits(1, 3)}, '-', {g.digits(4, 2)}, '-', {g.digits(6, 4)})"),
        ("UK_NHS", f"concat({g.digits(1, 3)}, ' ', {g.digits(4, 3)}, ' ', {g.digits(7, 4)})"),
        ("UK_NINO", f"concat({g.pick(tuple(LETTERS), 25)}, {g.pick(tuple(LETTERS), 31)}, ' ', {g.digits(1, 6)}, ' ', {g.pick(tuple(LETTERS), 37)})"),
        ("TW_HEALTH_INSURANCE", f"concat('0000', {g.digits(1, 6)})"),
        ("TW_NHI_NUMBER", f"concat('0000', {g.digits(1, 8)})"),
        ("TW_ID_NUMBER", f"concat({g.pick(tuple(LETTERS), 25)}, CAST(1 + {g.num(31, 2)} AS {vc}), {g.digits(41, 8)})"),
        ("UNIFIED_BUSINESS_NO", g.digits(1, 8)),
        ("TW_PHONE_NUMBER", f"concat('09', {g.digits(1, 8)})"),
        ("TW_PASSPORT_NUMBER", f"concat('3', {g.digits(1, 7)})"),
        ("MAC_ADDRESS", mac_fake_sql(g)),
        ("TW_HOME_NUMBER", tw_home_fake_sql(d, raw, g)),
    ]
    body = " ".join(f"WHEN {d.s(k)} THEN {v}" for k, v in arms)
    return f"(CASE {entity} {body} ELSE concat({d.s(UNSUPPORTED_PREFIX)}, {entity}) END)"


def legacy_date_fake_sql(d: Dialect, raw: str, h: str) -> str:
    """Legacy DATE_TIME replacer."""
    g = Gen(d, h)
    is_date = d.rlike(raw, r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b")
    temporal = " OR ".join(f"instr(lower({raw}), {d.s(w)}) > 0" for w in ("years", "months", "days", "ago", "next", "last"))
    vc = "STRING" if d.name == "spark" else "VARCHAR"
    return (f"(CASE WHEN {is_date} THEN {d.date_from_days(g.num(1, DATE_SPAN_DAYS))} "
            f"WHEN {temporal} THEN concat(CAST(1 + {g.num(7, 100)} AS {vc}), ' years') ELSE 'unknown_date_time' END)")


def hash_sql(d: Dialect, entity: str, raw: str, salt: str = "", n: str | None = None) -> str:
    return d.sha256(seed_sql(d, entity, raw, salt, n))


def fake_column_sql(entity: str, raw: str, *, salt: str = "", kind: str = "local") -> str:
    """The fake value as a column of a table of spans, in Spark SQL.

    The generators of all types make a method that the JVM does not compile when Spark
    generates code for them; inside a lambda only the generator of the row's type is evaluated."""
    values = f"named_struct('e', {entity}, 'r', {raw}, 'h', {hash_sql(SPARK, entity, raw, salt)})"
    return f"transform(array({values}), fkc -> {fake_value_sql(SPARK, 'fkc.e', 'fkc.r', kind=kind, h='fkc.h')})[0]"


def fake_value_sql(d: Dialect, entity: str, raw: str, *, salt: str = "", n: str | None = None,
                   kind: str = "local", strict_names: bool = False, h: str | None = None) -> str:
    """Fake value for (entity, raw); ``kind`` = local | tagmap | legacy_date.
    ``h`` may name an already computed hash (saves re-hashing per arm)."""
    h = h or hash_sql(d, entity, raw, salt, n)
    if kind == "local":
        return local_fake_sql(d, entity, raw, h, strict_names)
    if kind == "tagmap":
        return tagmap_fake_sql(d, entity, raw, h)
    if kind == "legacy_date":
        return legacy_date_fake_sql(d, raw, h)
    raise ValueError(kind)
