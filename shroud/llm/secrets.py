r"""Secret scans (8): a recursive decoding worklist.

Every text is scanned for secrets, then its encoded parts (URL escapes, Unicode
escapes, base64, and gzip or zlib streams inside base64) are unwrapped into new
layers, which are scanned and unwrapped in turn until no new layer appears.  A
layer seen before at the same place is not taken again, so layers that contain
themselves end.  Each character of a layer knows the span of the original text it
came from; a secret found in a layer is reported at that span.  Characters of a
compressed layer came from its own row of members, not from what stands beside it in
the run.  Decoded bytes are
read whatever they hold: as UTF-8 with bytes that are none kept in place, and as
UTF-16 and UTF-32 where there are NULs.

Base secrets (of the text itself), leftmost non-overlapping per kind:
``assign`` (a named value of 6 or more characters), ``access`` (AKIA keys of 20
or more) and ``hex`` (24 or more digits).  Spans are code points of the original
text, end exclusive, of the whole match.

Base64 is read from each of the first four characters of a run, and also across
blanks, line breaks and their escapes, where every part but the last has 16
characters or more; shorter parts are not joined.  A place in such a run covers the
breaks inside it.  Repeated rows are scanned each; an empty table gives an empty one.

Null text counts as empty and has no spans.  All other columns pass through.
Compressed layers are read to the end, all members, in pieces of about
``max_layer`` bytes (parameter) that are cut where no secret or escape can cross.
A longer run without such a place (any ASCII character but letters, digits and
``%+-./:=\_"'`` and space, or 16 NULs) is held whole.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import project, read_table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a run of 24+ is a whole match of [0-9a-f]+
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

URL = re.compile(r"%[0-9A-Fa-f]{2}")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
#: between the parts of a broken run: blanks and line breaks, also escaped ones
BROKEN = r"(?:[ \t\r\n]|\\[nrt])++"
#: a run broken into parts of 16 characters or more, but for the last
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{BROKEN}[A-Za-z0-9+/_-]{{16,}}+)*{BROKEN}[A-Za-z0-9+/_-]++={{0,2}}")
PART = re.compile(rf"{BROKEN}|([A-Za-z0-9+/_-]+)")
#: what every text with a secret or a further layer has
MAY = re.compile(r"(?:passw|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_-]{16}|%[0-9A-Fa-f]{2}|\\[ux]", re.ASCII | re.IGNORECASE)
#: bytes no secret and no coded part has
APART = np.array([0 < i < 128 and not re.match(r"""[A-Za-z0-9%+./:=\\_"'\x20-]""", chr(i)) for i in range(256)])

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Secrets of one layer as (kind, start, end), ordered by start, then kind as listed."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """A text with, for each character, the original span it came from (None: itself)."""

    __slots__ = ("end", "start", "text")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def derive(self, text: str, begin: list[int], stop: list[int]) -> Layer:
        """A layer whose character i came from [begin[i], stop[i]) of this one."""
        b, e = np.asarray(begin, dtype=np.int64), np.asarray(stop, dtype=np.int64)
        if self.start is None:
            return Layer(text, b, e)
        return Layer(text, self.start[b], self.end[e - 1])


def _readings(raw: bytes, places: bool = True) -> Iterator[tuple[str, np.ndarray | None, np.ndarray | None]]:
    """Every text that ``raw`` may hold, with the bytes [begin, stop) of each character (with ``places``); no byte is left out.

    UTF-8, where each byte that is none becomes a lone surrogate of its own, and, as
    ASCII has NULs in them, UTF-16 and UTF-32 of both orders from every offset where
    there is a NUL.  Texts without anything to scan or to unwrap are passed over.
    """
    text = raw.decode("utf-8", "surrogateescape")
    if MAY.search(text):
        stop = np.cumsum(_char_bytes(text)) if places else None
        yield text, np.append(0, stop[:-1]) if places else None, stop
    if b"\0" not in raw:
        return
    for width in (2, 4) if b"\0\0\0" in raw else (2,):
        for order in "<>":
            for offset in range(min(width, len(raw))):
                units = np.frombuffer(raw, f"{order}u{width}", (len(raw) - offset) // width, offset)
                text = np.minimum(units, 0xFFFF).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                if not MAY.search(text):
                    continue
                if places:
                    begin = offset + width * np.arange(len(units))
                    # an ASCII character lies in its one byte that is not NUL, so both orders give the same place
                    begin = begin + np.where(units < 128, (width - 1) * (order == ">"), 0)
                    yield text, begin, begin + np.where(units < 128, 1, width)
                else:
                    yield text, None, None


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflate(rest: list[bytes], piece: int) -> Iterator[bytes]:
    """What all compressed members at the start of ``rest[0]`` hold, at most ``piece`` bytes at a time; a damaged one up to the damage.

    ``rest[0]`` becomes what follows the last whole member."""
    while _packed(rest[0]):
        step, more, given = zlib.decompressobj(47), rest[0], 0
        try:
            while not step.eof:
                out = step.decompress(more, piece)
                more = step.unconsumed_tail
                if not out and not more:
                    return  # cut short
                given += len(out)
                yield out
        except zlib.error:
            # the failed call returns nothing: what came before the damage is read byte by byte
            step = zlib.decompressobj(47)
            with contextlib.suppress(zlib.error):
                for i in range(len(rest[0])):
                    out = step.decompress(rest[0][i : i + 1])
                    yield out[given:]
                    given = max(0, given - len(out))
            return
        rest[0] = step.unused_data.lstrip(b"\0")


def _last_cut(raw: bytes) -> int:
    """The last place that no secret, escape or base64 text crosses in any reading of ``raw``; 0 if there is none.

    It lies behind a byte that neither has nor, in UTF-16 and UTF-32, is a part of a
    character of those, or within a run of NULs longer than a character.
    """
    at = np.flatnonzero(APART[np.frombuffer(raw, np.uint8)])
    nul = raw.rfind(b"\0" * 16)
    return max(int(at[-1]) + 1 if len(at) else 0, nul + 8 if nul >= 0 else 0)


def _pieces(parts: Iterator[bytes], piece: int) -> Iterator[bytes]:
    """The bytes of ``parts`` in pieces of about ``piece``; one without a place to cut stays whole."""
    held, size, want = [], 0, piece
    for part in parts:
        held.append(part)
        size += len(part)
        if size < want:
            continue
        raw = b"".join(held)
        at = _last_cut(raw)
        if at:
            yield raw[:at]
        held, size = [raw[at:]], len(raw) - at
        want = max(piece, 2 * size)
    if size:
        yield b"".join(held)


def _char_bytes(text: str) -> list[int]:
    """Bytes of each character of a text decoded with surrogateescape."""
    return [1 if ch < "\x80" or "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8")) for ch in text]


def _unescape(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with every match replaced by what it decodes to."""
    text, at = layer.text, 0
    parts: list[str] = []
    begin: list[int] = []
    stop: list[int] = []
    for m in pattern.finditer(text):
        got = decode(m)
        if got is None:
            continue
        parts.append(text[at : m.start()])
        begin += range(at, m.start())
        stop += range(at + 1, m.start() + 1)
        for piece, a, b in got:
            parts.append(piece)
            begin += [a] * len(piece)
            stop += [b] * len(piece)
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])
    begin += range(at, len(text))
    stop += range(at + 1, len(text) + 1)
    return layer.derive("".join(parts), begin, stop)


def _url_run(m: re.Match):
    text = bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape")
    out, at = [], m.start()
    for ch, n in zip(text, _char_bytes(text)):
        out.append((ch, at, at + 3 * n))
        at += 3 * n
    return out


def _unicode_escape(m: re.Match):
    ch = chr(int(m.group()[2:], 16))
    return None if "\ud800" <= ch <= "\udfff" else [(ch, m.start(), m.end())]


def _streams(raw: bytes, piece: int) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """Each row of compressed members of ``raw``: its bytes [begin, stop) and what it holds; from its start, and from wherever
    gzip begins behind the last row.  A damaged row may reach to the end."""
    at = 0 if _packed(raw) else raw.find(b"\x1f\x8b\x08")
    while at >= 0:
        rest = [raw[at:]]
        for _ in _inflate(rest, piece):
            pass
        read = len(raw) - at - len(rest[0])
        yield at, len(raw) if _packed(rest[0]) else at + read, _inflate([raw[at:]], piece)
        at = raw.find(b"\x1f\x8b\x08", at + max(read, 1))


def _base64_runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Every run of base64 characters, the place of each one, and its end with padding: single runs, and broken ones joined."""
    for m in BASE64.finditer(text):
        yield m.group(1), np.arange(m.start(), m.end(1)), m.end()
    for m in WRAPPED.finditer(text):
        parts = [p for p in PART.finditer(text, m.start(), m.end()) if p.group(1)]
        yield "".join(p.group() for p in parts), np.concatenate([np.arange(p.start(), p.end()) for p in parts]), m.end()


def _base64_layers(layer: Layer, max_layer: int) -> Iterator[Layer]:
    """Every run is read from its first four characters on, as others may stand right before the coded part."""
    for run, place, end in _base64_runs(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            body = run[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            at = place[skip : skip + len(body)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            for begin, stop, stream in _streams(raw, max_layer):
                first, last = at[begin * 8 // 6], end if stop == len(raw) else at[-(-stop * 8 // 6) - 1] + 1
                for part in _pieces(stream, max_layer):
                    for text, _, _ in _readings(part, False):
                        yield layer.derive(text, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text)))
            for text, begin, stop in _readings(raw):  # byte i lies in the base64 characters from 8i/6 to (8i+8)/6
                yield layer.derive(text, at[begin * 8 // 6], at[-(-stop * 8 // 6) - 1] + 1)


def unwrap(layer: Layer, max_layer: int) -> Iterator[Layer]:
    """The layers one step below ``layer``."""
    if URL.search(layer.text):
        got = _unescape(layer, URL_RUN, _url_run)
        if got:
            yield got
    if "\\u" in layer.text or "\\x" in layer.text:
        got = _unescape(layer, UNICODE, _unicode_escape)
        if got:
            yield got
    yield from _base64_layers(layer, max_layer)


def _mark(layer: Layer) -> tuple[bytes, int]:
    """Content and place of a layer: the same content from another place is another layer."""
    at = layer.span(0, len(layer.text))[0] if layer.text else 0
    return hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), at


def find_secrets(text: str | None, max_layer: int = 1 << 24) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    text = text or ""
    base = scan(text)
    spans = set(base)
    top = Layer(text)
    seen = {_mark(top)}
    work = [unwrap(top, max_layer)]  # one layer is followed down before the next is made, so that few are held
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        mark = _mark(below)
        if mark in seen:
            continue
        seen.add(mark)
        spans.update((k, *below.span(a, b)) for k, a, b in scan(below.text))
        work.append(unwrap(below, max_layer))
    return base, ordered(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """``text`` with every covered run replaced by ``mark``."""
    if not spans:
        return text
    out, at, reach = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a > reach:
            out += [text[at:a], mark]
        reach = at = max(reach, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str | Column = "text", max_layer: int = 1 << 24) -> DataFrame:
    """All columns of ``docs`` and the struct ``secrets``: counts of base spans, their digest, all spans, the redacted text."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                base, spans = find_secrets(t, max_layer)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*n, digest, listed(spans), redact(t, spans) if spans else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return docs.drop("secrets").withColumn("secrets", run(F.col(text) if isinstance(text, str) else text))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = scan_secrets(project(docs, doc_id="doc_id", text="text"))
    return out.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", "secrets.base_sha256", "secrets.spans")
