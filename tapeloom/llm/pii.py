"""Personal data by anchor expansion: an Aho-Corasick pass finds cues, small parsers expand them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

#: Order of the kinds among spans that start at one place; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
RANK = {k: i for i, k in enumerate(KINDS)}
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
#: Words that announce an account number, identifier or credential, and which parser tells its boundary.
CUES = {
    "account": "number", "acct": "number", "konto": "number", "iban": "iban", "passport": "passport", "ssn": "ssn", "social security": "ssn",
    "token": "credential", "api_key": "credential", "api-key": "credential", "api key": "credential", "apikey": "credential", "secret": "credential", "password": "credential",
}

_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OCTETS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9][^\s\"'<>]*")
#: What may stand between a cue and its value: a noun, then a sign; the value may be quoted.
_LINK = re.compile(r"(?i:[\x20_-]?(?:numbers?|num|nr|no|id|key)\b\.?)?[\x20]?(?P<sign>[:=#])?[\x20]?[\"']?")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9])")
_PASSPORT = re.compile(r"[A-Za-z]{0,2}[0-9]{6,9}(?![A-Za-z0-9])")
_SSN = re.compile(r"([0-9]{3})-?([0-9]{2})-?([0-9]{4})(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+~!@$%^&*-]*")


def automaton() -> ahocorasick.Automaton:
    """The automaton over all anchors; a digit anchors cards and addresses of four numbers."""
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c, parser in CUES.items():
        a.add_word(c, (parser, len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def iban_end(text: str, at: int) -> int | None:
    """Where an IBAN that begins at a place ends: the longest stretch that ends with a group and leaves 1 modulo 97."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    end = m.end()
    while end - at >= 15:
        if text[end - 1] != " " and not text[end : end + 1].isalnum():
            plain = text[at:end].replace(" ", "").upper()
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return end
        end -= 1
    return None


def account_span(text: str, last: int, parser: str) -> tuple[int, int] | None:
    """The value behind an identifier cue that ends at `last`, if the cue's parser takes it.

    An account number has 6 to 18 digits, an IBAN a right check, a passport 6 to 9 digits behind two
    letters at most, a social security number no part that is never given out. Credentials stand
    behind a sign and have 8 characters or more, digits among them and letters or marks too.
    """
    if text[last + 1 : last + 2].isalpha():
        return None
    link = _LINK.match(text, last + 1)
    at = link.end()
    if at == last + 1:
        return None
    if parser == "iban" or parser == "number" and text[at : at + 2].isalpha():
        end = iban_end(text, at)
        return (at, end) if end else None
    if parser == "number":
        m = _NUMBER.match(text, at)
    elif parser == "passport":
        m = _PASSPORT.match(text, at)
    elif parser == "ssn":
        m = _SSN.match(text, at)
        if m and (m[1] in ("000", "666") or m[1][0] == "9" or m[2] == "00" or m[3] == "0000"):
            m = None
    else:
        m = _SECRET.match(text, at) if link["sign"] else None
        if m:
            value = m[0].rstrip(".!")
            kinds = (any(c.isdigit() for c in value), any(not c.isdigit() for c in value))
            return (at, at + len(value)) if len(value) >= 8 and all(kinds) else None
    return (at, m.end()) if m else None


def find_spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of text in code points, end exclusive, by start and kind.

    Base kinds follow the contract's patterns, leftmost and non-overlapping within a kind; a match
    that fails its check is dropped and not tried again from within. Added kinds: ``url`` behind a
    scheme, ``account`` behind an identifier cue whose parser takes it (account_span).
    """
    out: list[tuple[str, int, int]] = []
    mail_end = ip_end = card_end = run_end = url_end = account_end = 0
    lower = text.lower() if text.isascii() else text.translate(_LOWER)  # place by place, whatever the case
    for last, (cue, length) in cues.iter(lower):
        at = last - length + 1
        if cue == "digit":
            if at >= card_end:
                m = _CHAIN.match(text, at)
                if m:
                    card_end = m.end()
                    digits = re.sub("[^0-9]", "", m[0]) if m.end() - at >= 12 else ""
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, m.end()))
            if at >= run_end and at >= ip_end:
                m = _OCTETS.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(map(_octet, m[0].split("."))):
                        out.append(("ip", at, m.end()))
                else:  # a start later in the same run of digits fails as well
                    run_end = at + 1
                    while run_end < len(text) and text[run_end] in _DIGITS:
                        run_end += 1
        elif cue == "at":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                out.append(("email", start, m.end()))
        elif cue == "plus":
            m = _DIAL.match(text, at)
            if m and 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", at, m.end()))
        elif cue == "scheme":
            if at >= url_end and (m := _URL.match(text, last + 1)):
                url_end = at + len(text[at : m.end()].rstrip(".,;:!?)"))
                out.append(("url", at, url_end))
        elif (not text[at - 1 : at].isalnum() or at == 0) and (found := account_span(text, last, cue)) and found[0] >= account_end:
            account_end = found[1]
            out.append(("account", *found))
    out.sort(key=lambda s: (s[1], RANK[s[0]], s[2]))
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data for every row: ``doc_id, spans array<struct<kind, start, end>>``.

    A null text counts as empty and has no spans; repeated rows and null ids give a row each; an
    empty table gives none. Other columns are neither read nor returned. Only texts go through Python, so ids of any type stay as they are.
    Memory is one Arrow batch.
    """

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cues = automaton()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t or "", cues)] for t in batch.to_pylist()]
            yield pa.array(found, SPANS)

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from detect_pii's rows."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("url"), count("account"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with each span replaced by its kind in angle brackets; overlapping spans merge.

    A null text stays null; repeated rows and null ids give a row each; an empty table gives none.
    Other columns are neither read nor returned.
    """

    @F.arrow_udf("string")
    @trimmed
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cues = automaton()
        for batch in batches:
            texts = []
            for t in batch.to_pylist():
                parts, end = [], 0
                for k, s, e in find_spans(t or "", cues):
                    if s >= end:
                        parts += [t[end:s], f"<{k}>"]
                    end = max(end, e)
                texts.append("".join([*parts, t[end:]]) if t is not None else None)
            yield pa.array(texts, pa.string())

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("text"))
