"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that passes validation is permuted by a keyed Feistel network within the
set of values of its own format: a card number that passes the Luhn test becomes
another that passes it, a date another date, each with its separators in place.
The permutation depends on the key and the value alone, so equal values have
equal pseudonyms in every document, and whoever has the key can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import with_text

ROUNDS = 10


def feistel(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size).

    Rounds alternate between the two digits of the value in a near-square mixed
    radix; a result beyond ``size`` is permuted again until it is inside, which
    keeps the whole a permutation.
    """
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    turns = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    sign = -1 if inverse else 1
    while True:
        left, right = divmod(value, b)
        for turn in turns:
            other = right if turn % 2 == 0 else left
            mac = hashlib.blake2b(f"{tweak}|{size}|{turn}|{other}".encode(), key=key, digest_size=16).digest()
            shift = sign * int.from_bytes(mac, "big")
            if turn % 2 == 0:
                left = (left + shift) % a
            else:
                right = (right + shift) % b
        value = left * b + right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass the Luhn test."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def _permuted_digits(digits: str, key: bytes, kind: str, inverse: bool) -> str:
    return f"{feistel(int(digits), 10 ** len(digits), key, f'{kind}{len(digits)}', inverse):0{len(digits)}d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _card(text: str, key: bytes, inverse: bool) -> str | None:
    d = _only_digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    new = _permuted_digits(d[:-1], key, "card", inverse)
    return _refill(text, new + luhn_digit(new))


def _phone(text: str, key: bytes, inverse: bool) -> str | None:
    d = _only_digits(text)
    if not 10 <= len(d) <= 15:
        return None
    return _refill(text, d[:-10] + _permuted_digits(d[-10:], key, "phone", inverse))


_SSN_AREAS = [a for a in range(1, 900) if a != 666]


def _ssn(text: str, key: bytes, inverse: bool) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area == 0 or area == 666 or area > 899 or group == 0 or serial == 0:
        return None
    rank = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    new = feistel(rank, len(_SSN_AREAS) * 99 * 9999, key, "ssn", inverse)
    rest, serial = divmod(new, 9999)
    area, group = divmod(rest, 99)
    return f"{_SSN_AREAS[area]:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


_YEARS = range(1900, 2100)


@lru_cache(1)
def _dates() -> tuple[dict[tuple[bool, int], list[datetime.date]], dict[datetime.date, int]]:
    """All dates by class, and each one's rank in its class.

    A class fixes how many digits month and day take, and whether the day is
    above 12. So a date keeps the width of its fields, stays one that is read day
    first or month first as before, and has one pseudonym under any spelling.
    """
    classes: dict[tuple[bool, int], list[datetime.date]] = {}
    rank = {}
    day = datetime.date(_YEARS[0], 1, 1)
    while day.year < _YEARS.stop:
        own = classes.setdefault(_date_class(day), [])
        rank[day] = len(own)
        own.append(day)
        day += datetime.timedelta(1)
    return classes, rank


def _date_class(day: datetime.date) -> tuple[bool, int]:
    return day.month > 9, (day.day > 9) + (day.day > 12)


def _date(text: str, key: bytes, inverse: bool) -> str | None:
    """Year first, or with dots day first, or with slashes month first, and day first where only that is a date."""
    parts = re.split(r"([-/.])", text)
    for order in [(0, 2, 4)] if len(parts[0]) == 4 else [(4, 0, 2), (4, 2, 0)] if parts[1] == "/" else [(4, 2, 0)]:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        if day.year not in _YEARS:
            return None
        classes, rank = _dates()
        own = classes[_date_class(day)]
        new = own[feistel(rank[day], len(own), key, f"date{_date_class(day)}", inverse)]
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            parts[i] = f"{v:0{len(parts[i])}d}"
        return "".join(parts)
    return None


def _ipv4(text: str, key: bytes, inverse: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    n = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, "ipv4", inverse)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _iban(text: str, key: bytes, inverse: bool) -> str | None:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or not 2 <= int(flat[2:4]) <= 98 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _permuted_classes(flat[4:], key, "iban", inverse)
    check = 98 - number(body + flat[:2] + "00") % 97
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


# Alphabets within which a character stays.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permuted_classes(text: str, key: bytes, kind: str, inverse: bool) -> str:
    """Digits stay digits, letters stay letters of their case, other characters stay."""
    radix = [next((a for a in _ALPHABETS if c in a), c) for c in text]
    value = 0
    for c, a in zip(text, radix, strict=True):
        value = value * len(a) + a.index(c)
    shape = "".join(a[0] for a in radix)
    value, out = feistel(value, math.prod(map(len, radix)), key, f"{kind}|{shape}", inverse), []
    for a in reversed(radix):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _email(text: str, key: bytes, inverse: bool) -> str | None:
    local, _, host = text.rpartition("@")
    name, dot, top = host.rpartition(".")
    return f"{_permuted_classes(local, key, 'local', inverse)}@{_permuted_classes(name, key, 'host', inverse)}{dot}{top}"


@dataclass(frozen=True)
class Kind:
    """What a value looks like, and its pseudonym or None if it isn't valid."""

    name: str
    pattern: str
    pseudonym: Callable[[str, bytes, bool], str | None]


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: In order of preference where matches start at the same place. An address is found by its @ and host; before it stands a run of ``_LOCAL``.
KINDS = (
    Kind("email", r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])", _date),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    Kind("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ipv4),
    Kind("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", _card),
    Kind("card", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?(?![0-9])", _card),
    Kind("card", r"(?<![0-9])[0-9]{4}([ -])[0-9]{6}\1[0-9]{5}(?![0-9])", _card),
    Kind("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9])", _phone),
)
_COMPILED = [(k, re.compile(k.pattern)) for k in KINDS]
#: What a valid value of any kind holds: two digits in a row, the @ of an address, or a dot between one-digit octets.
_TRIGGER = re.compile(r"[0-9]{2}|[0-9]\.[0-9]|@")


def _matches(kind: Kind, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Places of a kind's pattern, in linear time: no character is looked at from two starts."""
    if kind.name != "email":
        yield from (m.span() for m in pattern.finditer(text))
        return
    at = 0
    for m in pattern.finditer(text) if "@" in text else ():
        start = m.start()
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
        at = m.end()


def find(text: str) -> list[tuple[int, int, Kind]]:
    """Valid values as disjoint (start, end, kind), the earliest first, then the preferred kind."""
    spans = []
    for rank, (kind, pattern) in enumerate(_COMPILED):
        spans += [(start, rank, end, kind) for start, end in _matches(kind, pattern, text) if kind.pseudonym(text[start:end], b"0" * 32, False) is not None]
    spans.sort(key=lambda s: s[:2])
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out.append((start, end, kind))
            at = end
    return out


def pseudonymise(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the given text."""
    if not _TRIGGER.search(text):
        return text, []
    out, at, spans = [], 0, []
    for start, end, kind in find(text):
        out += [text[at:start], kind.pseudonym(text[start:end], key, inverse)]
        spans.append((kind.name, start, end))
        at = end
    return "".join([*out, text[at:]]) if spans else text, spans


def derive_key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


FIELDS = "text: string, n_values: bigint, kinds: string, spans: string"


def pseudonyms(docs: DataFrame, secret: str, keep: list[str] | None = None) -> DataFrame:
    """(row, got): the kept columns; the new text, how many values it holds, their kinds and their kind:start:end spans.

    A null text stays null and holds none; an empty table gives an empty one.
    Repeated rows and values get equal pseudonyms, a date under any spelling the
    same date. Texts of any length are read whole, in linear time. Other columns
    of any name pass through.
    """
    key = derive_key(secret)

    def run(column: pa.Array) -> list[pa.Array]:
        texts, counts, kinds, spelled = [], [], [], []
        for t in column.to_pylist():
            new, spans = (None, []) if t is None else pseudonymise(t, key)
            texts.append(new)
            counts.append(len(spans))
            kinds.append(",".join(sorted({k for k, _, _ in spans})))
            spelled.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(spelled, pa.string())]

    return with_text(docs, run, FIELDS, keep=keep)


def replace_text(docs: DataFrame, secret: str) -> DataFrame:
    """The documents with their texts pseudonymised; other columns as they are (n_chars follows the text, if there)."""
    new = {"text": F.col("got.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("got.n_values") > 0, F.char_length("got.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return pseudonyms(docs, secret).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
