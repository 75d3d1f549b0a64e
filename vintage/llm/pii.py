"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs,
schemes, digits and words that announce an account. Each anchor is handed to a
small deterministic parser that widens it to the left and right within the
characters its kind allows and validates what it got. Texts without an anchor
cost one scan and nothing else.

Kinds with fixed definitions (leftmost, not overlapping within a kind): email,
ip, card, phone. Kinds that the anchors add: url (after a scheme), account (an
identifier after a cue such as ``iban`` or ``account no``).

Edge cases: a null text counts as empty and has no spans; a null ``doc_id`` is
kept; repeated rows are searched each for itself; offsets count code points and
exclude the end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, slices, utf8

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
#: Words that announce an identifier.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_REST = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_END = re.compile(r"[^\s<>\"'|\\^`{}]+")
_ACCOUNT = re.compile(r"[\x20:#.=-]{0,3}(?:no|nr|num|number|id)?[\x20:#.=]{0,3}([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(identifier: str) -> bool:
    """Check digits of an IBAN: the rearranged number leaves 1 on division by 97."""
    moved = identifier[4:] + identifier[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in _DIGITS:
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for word in SCHEMES:
        automaton.add_word(word, ("scheme", len(word)))
    for word in ACCOUNT_CUES:
        for form in (word, word.capitalize(), word.upper()):
            automaton.add_word(form, ("cue", len(form)))
    automaton.make_automaton()
    return automaton


class AnchorFinder:
    """``find(text)``: the spans ``(kind, start, end)``, by kind as in KINDS and then by start."""

    def __init__(self):
        self.anchors = _automaton()

    def find(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        # Where the search of each kind goes on: behind its last match, valid or not.
        email = ip = card = phone = url = account = 0
        for last, (anchor, length) in self.anchors.iter(text):
            at = last - length + 1
            if anchor == "digit":
                # the digit that begins a run, or the first one behind the last match
                if at >= card and (at == card or not _joined(text, at, card)):
                    if m := _CARD.match(text, at):
                        card = m.end()
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
                if at >= ip and (at == ip or text[at - 1] not in _DIGITS):
                    if m := _IP_REST.match(text, at):
                        ip = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                            found["ip"].append(m.span())
            elif anchor == "at":
                start = at
                while start > email and text[start - 1] in _LOCAL_CHARS:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at)):
                    email = m.end()
                    found["email"].append((start, m.end()))
            elif anchor == "plus":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                        found["phone"].append(m.span())
            elif anchor == "scheme":
                if at >= url and (m := _URL_END.match(text, last + 1)):
                    end = m.end()
                    while text[end - 1] in ".,;:!?)" and end > last + 1:
                        end -= 1
                    if end > last + 1:
                        url = end
                        found["url"].append((at, end))
            elif at >= account and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
                identifier = re.sub(r"[\x20-]", "", m.group(1))
                if sum(c in _DIGITS for c in identifier) >= 6 and (not identifier[:2].isalpha() or iban(identifier)):
                    account = m.end()
                    found["account"].append(m.span(1))
        return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def _joined(text: str, at: int, since: int) -> bool:
    """Whether the digit at ``at`` continues a card-like run that began at ``since`` or later."""
    before = text[at - 1] if at > since else ""
    return before in _DIGITS or (before in (" ", "-") and at - 2 >= since and text[at - 2] in _DIGITS)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = remembered("anchors", AnchorFinder)
    for batch, texts in slices(batches, "utf8"):
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in finder.find(t.decode("utf-8", "replace"))] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every whole text of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8")).mapInArrow(
        _search, "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )


def personal_data_report(found: DataFrame) -> DataFrame:
    """Digest columns: counts and a hash of the kinds with fixed definitions, and all spans as text."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(of(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, personal data in ``text`` replaced by its kind in angle brackets; null stays null."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = remembered("anchors", AnchorFinder)
        for batch, _ in slices(batches, text):
            out = [None if t is None else _redacted(t, finder) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, finder: AnchorFinder) -> str:
    out, end = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in finder.find(text)):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
