"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes and identifier cues. From each anchor a
small parser walks to the boundaries of the span and validates it. Numbers have no anchor but
their digits; they are found by patterns that never step back into a run.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import by_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

# Identifier cues.
CUES = (
    "iban", "account", "acct", "passport", "ssn", "social security number", "tax id", "customer id",
    "api key", "api_key", "apikey", "token", "secret", "password",
)
# The cues whose values need no digits.
CREDENTIALS = frozenset(("api key", "api_key", "apikey", "token", "secret", "password"))

# A-Z alone become small, so offsets stay.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_REST = re.compile(r"[^\s\"'<>`{}|\\^]++")
_AUTHORITY = re.compile(r"(?:[^\s\"'<>`{}|\\^/?#@]*+@)?((?:[\w-]++\.)+[\w-]++|localhost)(?::[0-9]{1,5})?")
_LINK = re.compile(r"[ \t]*[\"']?[ \t]*(?:(?:number|no\.?|nr\.?|is|#)[ \t]*)?([:=#]?)[>=]?[ \t]*([\"']?)", re.IGNORECASE)
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*+")
_SECRET = re.compile(r"[^\s\"'<>`,;]++")
_QUOTED = {q: re.compile(rf"[^{q}\r\n]++(?={q})") for q in "\"'"}
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", ("://", 3))
    for cue in CUES:
        found.add_word(cue, ("credential" if cue in CREDENTIALS else "cue", len(cue)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _email(text: str, at: int, low: int) -> tuple[int, int] | None:
    start = at
    while start > low and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _address(text: str, at: int, low: int) -> tuple[int, int] | None:
    """A location with a scheme: letters before the colon, a host that can exist after it."""
    start = at
    while start > low and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    host = _AUTHORITY.match(text, at + 3) if start < at else None
    if not host:
        return None
    rest = _REST.match(text, host.end()) if text[host.end() : host.end() + 1] in ("/", "?", "#") else None
    return start, host.end() + len(rest[0].rstrip(".,;:!?)]")) if rest else host.end()


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _account(text: str, after: int, credential: bool) -> tuple[int, int] | None:
    """An identifier after a cue: a valid IBAN, or 6 letters and digits or more, 4 digits at
    least. A credential after a colon or an equals sign is what is quoted, else all up to a blank,
    and needs no digits."""
    link = _LINK.match(text, after)
    at = link.end()
    iban = _IBAN.match(text, at)
    if iban:
        for size in range(iban.end(), at + 14, -1):
            if text[size - 1] != " " and _iban(text[at:size]):
                return at, size
    if credential and link[1] in (":", "="):
        value = (_QUOTED[link[2]].match(text, at) if link[2] else None) or _SECRET.match(text, at)
        end = at + len(value[0] if link[2] else value[0].rstrip(".:!?)]")) if value else at
        return (at, end) if end - at >= 6 else None
    value = _VALUE.match(text, at)
    if not value or at == after or value.end() - at < 6:
        return None
    return (at, value.end()) if sum(c.isdigit() for c in value[0]) >= 4 else None


def spans(text: str | None) -> list[Span]:
    """All spans of a text (null: none) as (kind, start, end) in code points, by KINDS, then start."""
    text = text or ""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span:
            found[kind].append(span)

    def low(kind: str) -> int:
        return found[kind][-1][1] if found[kind] else 0

    for last, (anchor, size) in _anchors().iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        at = last - size + 1
        if anchor == "@":
            add("email", _email(text, at, low("email")))
        elif anchor == "://":
            add("address", _address(text, at, low("address")))
        elif at >= low("account") and (at == 0 or not text[at - 1].isalnum()):
            add("account", _account(text, last + 1, anchor == "credential"))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            add("ip", m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            add("card", m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                add("phone", m.span())
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; spans that overlap
    become one. Null stays null."""
    found = sorted(spans(text), key=lambda s: (s[1], -s[2]))
    if not found:
        return text
    parts, at = [], 0
    for kind, start, end in found:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans``, an array of (kind, first, past).

    Null and empty texts have no spans. Ids may be null or repeated; other columns are not
    carried; an empty table gives an empty one.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("past", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [
            [{"kind": k, "first": s, "past": e} for k, s, e in spans(t)]
            for t in batch.column(1).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["doc_id", "spans"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        by_slices(work), f"doc_id {id_type}, spans array<struct<kind: string, first: bigint, past: bigint>>"
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["first"], s["past"])
    listed = lambda c: F.array_join(F.transform(c, text), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced; all rows and columns stay. A column of text
    sizes, if there is one by that name, follows the new text."""
    sized = size_col if size_col in docs.columns else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        new = [redacted(t) for t in batch.column(at).to_pylist()]
        out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if sized:
            n = batch.schema.get_field_index(sized)
            old = out.column(n).to_pylist()
            sizes = [o if t is None else len(t) for o, t in zip(old, new)]
            out = out.set_column(n, out.schema.field(n), pa.array(sizes, out.schema.field(n).type))
        return out

    return docs.mapInArrow(by_slices(work), docs.schema)
