"""Personal data: proposed by patterns, confirmed by checksums, scored by
context.

Each kind has a regular expression that proposes leftmost, non-overlapping
spans; a validator that a span must pass (Luhn for cards, mod-97 for IBANs,
parts of at most 255 for IP addresses, 9 to 15 digits for phones); a base
score; and context words. The words near a span raise the score by
``CONTEXT`` or, for words that speak against the kind, lower it by as much.
The four listed kinds are kept whatever their score; IBANs and national
numbers, whose patterns alone prove little, only at ``ACCEPT`` or more.

The IBAN pattern may run on into the words behind a number. The span is cut to
its country's length, else to the longest part, between blanks, that passes
mod-97; where none does, the search goes on behind the span's first group.

The patterns are written so that no text costs more than linear time: runs
are matched possessively and only from their first character, which changes
no leftmost match. Offsets count code points, ends are exclusive.

Null and empty texts have no spans. Whole texts are searched, whatever their
length. Equal spans of two kinds are all kept. Extra columns pass through; a
column named like the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from probengine.llm.common import prepare, texts

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
ALWAYS = frozenset(KINDS[:4])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
#: Characters on either side that are searched for context words.
NEAR = 48
CONTEXT, ACCEPT = 0.2, 0.75
_BASE = {"email": 0.9, "ip": 0.6, "card": 0.75, "phone": 0.7, "iban": 0.8, "national_id": 0.6}
_FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login", "client"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "debit"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    "national_id": {"ssn", "social", "security", "taxpayer"},
}
_AGAINST = {
    "ip": {"version", "release", "section", "chapter"},
    "card": {"order", "invoice", "serial", "tracking", "isbn"},
    "phone": {"serial", "order", "invoice"},
    "national_id": {"order", "invoice", "part"},
}
_WORD = re.compile(r"[a-z][a-z-]*")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
    "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of those before it."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    rest = digits[::-1]
    return (sum(map(int, rest[::2])) + sum(twice[int(d)] for d in rest[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the characters, the first four moved to the end and letters
    written as 10 to 35, are 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @, the run of local characters before it, which is where the
    leftmost match starts, and the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def _found(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in pattern.finditer(text))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each proposed span the part that is an IBAN, if any."""
    found = _IBAN.search(text)
    while found:
        start, parts, plain = found.start(), [], ""
        for group in found[0].split(" "):
            plain += group
            parts.append((len(plain), start + len(plain) + len(parts), plain))
        free = parts[0][1]
        length = _IBAN_LENGTH.get(found[0][:2])
        for size, end, number in sorted(parts, key=lambda p: (p[0] != length, -p[0])):
            if 15 <= size <= 34 and mod97(number):
                yield start, end
                free = end
                break
        found = _IBAN.search(text, free)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their validators, kind by kind."""
    for start, end in _emails(text):
        yield "email", start, end
    for start, end in _found(_IP, text):
        # leading zeros may be many: compare without them
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text[start:end].split(".")):
            yield "ip", start, end
    for start, end in _found(_CARD, text):
        digits = _NOT_DIGIT.sub("", text[start:end])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", start, end
    if "+" in text:
        for start, end in _found(_PHONE, text):
            if 9 <= len(_NOT_DIGIT.sub("", text[start:end])) <= 15:
                yield "phone", start, end
    for start, end in _ibans(text):
        yield "iban", start, end
    for start, end in _found(_NATIONAL, text):
        yield "national_id", start, end


def find_spans(text: str) -> list[dict]:
    """All kept spans of one text by start, then by kind as listed."""
    out = []
    for kind, start, end in _proposed(text):
        near = set(_WORD.findall(f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()))
        score = _BASE[kind] + CONTEXT * (bool(near & _FOR[kind]) - bool(near & _AGAINST.get(kind, set())))
        score = min(max(score, 0.0), 1.0)
        if kind in ALWAYS or score >= ACCEPT:
            out.append({"kind": kind, "start": start, "end": end, "score": score})
    return sorted(out, key=lambda s: (s["start"], KINDS.index(s["kind"])))


@arrow_udf(SPANS)
def _spans(column: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return pa.array([find_spans(t) for t in texts(column)], type=kind)


def detect(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: the personal data in ``text`` (kind, start, end, score)."""
    prepare(df.sparkSession)
    return df.withColumn(out, _spans(F.col(text)))


def masked(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by the upper-case
    name of its first kind in brackets."""
    out, free = [], 0
    for s in spans:
        if s["start"] >= free:
            out += [text[free:s["start"]], f"[{s['kind'].upper()}]"]
        free = max(free, s["end"])
    return "".join([*out, text[free:]])


@arrow_udf(T.StringType())
def _masked(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else masked(t, find_spans(t)) for t in column.to_pylist()], type=pa.string())


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows, personal data in ``text`` masked; null stays null."""
    prepare(df.sparkSession)
    return df.withColumn(text, _masked(F.col(text)))


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
