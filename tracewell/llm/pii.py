"""Personal data: expressions propose spans, checksums confirm them, context adjusts scores.

Base kinds (email, ip, card, phone) follow fixed expressions, leftmost and non-overlapping
within a kind; a match that fails its check is dropped and the search goes on behind it.
Added kinds are IBANs (mod-97), US social security numbers, and assigned secrets
(``token = "..."``).  Every span has a score: a prior of its kind, raised by a checksum and
by whole words near it that speak of such data, lowered by words that speak against it.  A secret's own key
word is part of its span, not of its context.  Base spans are always kept, whatever their score; added ones
must reach ``ADDED_SCORE``: a social security number needs a word for it, and words against it undo an IBAN or a secret.

All patterns scan in linear time: runs are matched possessively and only from their first
character, and emails are found from their ``@``.

One pass per document, no shuffle.  Edge cases: null text counts as empty; positions are code
points, ends exclusive; repeated rows stay repeated; null doc_ids are kept; an empty table
gives no rows; ``redacted`` keeps all other columns.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
ADDED_SCORE = 0.5
#: Code points before and after a span that are searched for context words.
CONTEXT = 48

# Priors and context words of each kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.35, "ssn": 0.35, "secret": 0.5}
FOR = {
    "email": "mail mails email emails contact write correo kontakt courriel".split(),
    "ip": "ip ips address addresses server servers host hosts login".split(),
    "card": "card cards visa mastercard credit debit payment karte tarjeta carte".split(),
    "phone": "phone phones call calls tel telephone mobile cell fax telefon telefono".split(),
    "iban": "iban bank account accounts konto cuenta compte transfer".split(),
    "ssn": "ssn social security taxpayer".split(),
    "secret": "credential credentials login auth authorization bearer config".split(),
}
AGAINST = {
    "ip": "version versions release section".split(),
    "card": "isbn serial order".split(),
    "iban": "serial part isbn order".split(),
    "ssn": "isbn part serial order".split(),
    "secret": "placeholder dummy changeme".split(),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9_])(?:api[_-]?key|token|secret|password|passwd)\s{0,8}[=:]\s{0,8}[\"']([^\s\"']{8,200})[\"']")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    start: int
    rank: int
    kind: str
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the letters and digits of an IBAN leave 1 modulo 97."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end(), True
            floor = domain.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _proposed(text: str):
    """(kind, start, end, confirmed by a checksum, where its context ends) of every span that passes its check."""
    if "@" in text:
        for begin, end, sure in _emails(text):
            yield "email", begin, end, sure, begin
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):  # zeros in front don't count
                yield "ip", m.start(), m.end(), False, m.start()
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), True, m.start()
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m[0])) <= 15:
                    yield "phone", m.start(), m.end(), False, m.start()
        for m in _IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                yield "iban", m.start(), m.end(), True, m.start()
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end(), False, m.start()
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            yield "secret", m.start(1), m.end(1), False, m.start()


def context_words(text: str, begin: int, end: int) -> set[str]:
    """Lower-case words of letters that lie whole within ``CONTEXT`` code points of a span."""
    low, high = max(0, begin - CONTEXT), min(len(text), end + CONTEXT)
    while 0 < low < begin and text[low - 1].isalpha():
        low += 1
    while end < high < len(text) and text[high].isalpha():
        high -= 1
    return set(_WORDS.findall(f"{text[low:begin]} {text[end:high]}".lower()))


def _score(text: str, kind: str, begin: int, end: int, sure: bool) -> float:
    near = context_words(text, begin, end)
    score = PRIOR[kind] + 0.3 * sure + 0.2 * (not near.isdisjoint(FOR[kind])) - 0.3 * (not near.isdisjoint(AGAINST.get(kind, ())))
    return min(1.0, max(0.0, round(score, 3)))


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    spans = []
    for kind, begin, end, sure, before in _proposed(text):
        score = _score(text, kind, before, end, sure)
        if kind in BASE_KINDS or score >= ADDED_SCORE:
            spans.append(Span(begin, KINDS.index(kind), kind, end, score))
    return sorted(spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlaps merged, replaced by ``<KIND>`` of its first."""
    out, at = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for begin, end, kind in merged:
        out += [text[at:begin], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


DETECT_SCHEMA = "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every span of every document with its score."""
    kind = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32(), "score": pa.float64()}))

    def scan(batches):
        for batch in batches:
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, DETECT_SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``detect``."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null text stays null; other columns as they were."""
    schema = StructType.fromJson(docs.schema.jsonValue())
    at = docs.columns.index("text")

    def scrub(batches):
        for batch in batches:
            texts = [None if t is None else redact(t, spans) if (spans := find(t)) else t for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(scrub, schema)
