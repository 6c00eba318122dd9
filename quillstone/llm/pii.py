"""Personal data in texts: patterns propose spans, checksums confirm them, and nearby words adjust their scores.

Kinds `email`, `ip`, `card` and `phone` are found as fixed patterns say, leftmost and non-overlapping within a kind, and
stay whatever their score is. Card numbers must pass Luhn's test. The method adds `iban` (confirmed by its remainder
modulo 97), `ssn` (confirmed by its number ranges) and `local_phone` (a number without a country code): these are given
only from a score of `threshold` on, which the last two reach by a word nearby alone, and not where they lie within a
span of the fixed kinds.

All scans take time in proportion to the text, however long a run of digits or letters is: an address is read outwards
from its @, a chain of dotted numbers is read once, and patterns give nothing back that could not help.

Defined cases: null and empty texts have no spans; a number of any length is read (leading zeros count for nothing);
digits are 0-9 only; offsets count code points; rows are independent, so null and repeated ids need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import texts_of

#: Kinds in the order in which spans of one start are listed, and their scores before any word nearby.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.65, "ssn": 0.35, "local_phone": 0.3}
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
#: Code points before and after a span in which words are looked for, and what they change.
BEFORE, AFTER, FOR, AGAINST = 48, 24, 0.25, 0.35

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")
_DROP = str.maketrans("", "", " -")

_WORDS_FOR = {
    kind: re.compile(rf"(?<!\w)(?:{words})", re.IGNORECASE)
    for kind, words in {
        "email": r"e-?mail|mail|contact|correo|courriel|kontakt",
        "ip": r"ip|host|server|client|address|adresse|direcci",
        "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte|cvv",
        "phone": r"tel|phone|call|mobile|cell|fax|telefon|tél|móvil|handy",
        "iban": r"iban|account|bank|konto|cuenta|compte|transfer",
        "ssn": r"ssn|social security|taxpayer|tin\b",
        "local_phone": r"tel|phone|call|mobile|cell|fax|telefon|tél|móvil|handy",
    }.items()
}
_WORDS_AGAINST = re.compile(r"(?<!\w)(?:version|release|order no|invoice no|isbn|serial|sample|dummy|checksum|build)", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48 << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Of letters and digits, at most 34: the first four go to the end, letters count from 10, the remainder is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = m.end()
            yield start, free


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        if (parts := m[0].split(".")) and len(parts) >= 4:
            at = m.start()
            for i in range(0, len(parts) - 3, 4):  # a match takes four numbers, and the next one starts after it
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    yield at, end
                at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(_DROP)) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(1 for _ in _DIGITS.finditer(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of blocks that passes the test: words in capitals may follow the number."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 2
        if end < len(text) and text[end].isalnum():
            end = start + m[0].rfind(" ")  # the last block goes on: it's a word
        while end - start >= 15:
            plain = text[start:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield start, end
                at = end
                break
            end = start + text[start:end].rfind(" ")


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _LOCAL_PHONE.finditer(text))


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": social_numbers, "local_phone": local_phones}


def _score(kind: str, text: str, start: int, end: int) -> float:
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    score = SCORES[kind]
    if _WORDS_FOR[kind].search(before) or _WORDS_FOR[kind].search(after):
        score += FOR
    if _WORDS_AGAINST.search(before):
        score -= AGAINST
    return round(min(1.0, max(0.0, score)), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, whether its kind is a fixed one), by start and kind."""
    out, held = [], []
    if not _DIGITS.search(text) and "@" not in text:
        return out
    for k, (kind, find) in enumerate(FINDERS.items()):
        for start, end in find(text):
            score, base = _score(kind, text, start, end), kind in BASE
            if base:
                held.append((start, end))
            elif score < threshold or any(a <= start and end <= b for a, b in held):
                continue
            out.append((start, k, kind, end, score, base))
    return [(kind, start, end, score, base) for start, _, kind, end, score, base in sorted(out)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, spans array<struct<kind, start, end, score, base>>) of each row's whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN]
        for batch in it:
            spans = [[dict(zip(names, s, strict=True)) for s in spans_of(t, threshold)] for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: int, `end`: int, score: double, base: boolean>>").withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row: spans of the fixed kinds are counted."""
    found = find(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])
    many = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *many, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
