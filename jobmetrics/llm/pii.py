"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are kept whenever their pattern and check hold, whatever the score: email, ip, card (Luhn), phone. Added
kinds need their checksum or enough support from the words around them: iban (mod-97), routing number (weighted sum
modulo 10), and numbers of people (social security and tax numbers) that only context tells from other numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from jobmetrics.llm.batches import documents_of, map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "routing", "ssn")
KINDS = BASE + ADDED

# The base patterns of the contract. A match begins where a run begins, which keeps scanning linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Formats of the added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ROUTING = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
_SSN = re.compile(r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

# Words that speak for a kind within WINDOW characters, and words that speak against any.
SUPPORT = {
    "email": {"email", "mail", "contact", "e-mail"},
    "ip": {"ip", "host", "address", "server", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "cvv"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telephone", "contact"},
    "iban": {"iban", "account", "bank", "transfer", "bic", "swift"},
    "routing": {"routing", "aba", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security", "tax", "taxpayer"},
}
AGAINST = {"example", "sample", "dummy", "version", "isbn", "order", "part", "serial"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "routing": 0.2, "ssn": 0.4}
WINDOW, STEP, THRESHOLD = 40, 0.3, 0.5
_WORD = re.compile(r"[A-Za-z-]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def routing_sum(digits: str) -> bool:
    return digits != "000000000" and sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0


def _is_byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1  # what stands before this sign can begin no other match
        at = text.find("@", done)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that passed their check, by kind, leftmost and not overlapping within a kind."""
    for start, end in _emails(text):
        yield "email", start, end
    if not any(map(text.__contains__, "0123456789")):
        return
    for m in _IP.finditer(text):
        if all(map(_is_byte, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if 15 <= len(packed := m[0].replace(" ", "")) <= 34 and mod97(packed):
            yield "iban", *m.span()
    for m in _ROUTING.finditer(text):
        if routing_sum(m[0]):
            yield "routing", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, moved up by each supporting word nearby and down by each word against, within 0 and 1."""
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}"
    words = {w.lower() for w in _WORD.findall(near)}
    return min(1.0, max(0.0, PRIOR[kind] + STEP * len(words & SUPPORT[kind]) - STEP * len(words & AGAINST)))


def find(text: str) -> list[Span]:
    """All spans by kind as listed, then start. Base kinds stay at any score, added ones from ``THRESHOLD`` on."""
    spans = [Span(kind, start, end, score(text, kind, start, end)) for kind, start, end in _proposed(text)]
    return sorted((s for s in spans if s.kind in BASE or s.score >= THRESHOLD), key=lambda s: (KINDS.index(s.kind), s.start))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, score) of each row, over whole texts.

    A null text counts as empty and has no spans. One row out for each row in, repeated and null ids included; an
    empty table gives an empty one; other columns are left out. Spans of different kinds may overlap.
    """

    def rows(ids: list, texts: list):
        for doc_id, text in zip(ids, texts):
            yield doc_id, [s._asdict() for s in find((text or b"").decode())]

    return map_texts(
        documents_of(docs, id_col, text_col), rows, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
    )
