"""Pseudonyms that keep their format: validated numbers, addresses and dates are permuted by a keyed Feistel network.

A value becomes a number below the size of its format, the number is permuted, and
the result is written in the same format. One key gives one pseudonym for equal values everywhere, different
values keep different pseudonyms, and who has the key can turn them back.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterflow.llm.texts import map_rows, slices

KINDS = ("email", "card", "phone", "ip", "ssn", "iban", "date")
ROUNDS = 10

PSEUDONYMS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        *[StructField(f"n_{k}", LongType(), False) for k in KINDS],
    ]
)


class Feistel:
    """A keyed permutation of the numbers below ``size``, for each format (``tweak``) its own.

    Numbers are split into two parts of nearly equal range, each round adds a keyed
    hash of one to the other, and results outside the range are permuted again until they fall inside.
    """

    def __init__(self, key: bytes):
        # Of any length; all of it counts.
        self.key = hashlib.blake2b(key, digest_size=64).digest()

    def _hash(self, tweak: bytes, i: int, x: int, n: int) -> int:
        data = b"%d|%d|%d|" % (i, n, x) + tweak
        # 16 bytes more than the range needs leave no measurable bias.
        size = min(64, (n.bit_length() + 7) // 8 + 16)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=size).digest(), "big") % n

    def _once(self, x: int, a: int, b: int, tweak: bytes) -> int:
        for i in range(ROUNDS):
            left, right = divmod(x, b)
            x = a * right + (left + self._hash(tweak, i, right, a)) % a
        return x

    def _back(self, x: int, a: int, b: int, tweak: bytes) -> int:
        for i in reversed(range(ROUNDS)):
            right, mixed = divmod(x, a)
            x = (mixed - self._hash(tweak, i, right, a)) % a * b + right
        return x

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        step = self._back if back else self._once
        x = step(x, a, b, tweak)
        while x >= size:
            x = step(x, a, b, tweak)
        return x


def _checksum_ok(digits: str) -> bool:
    """The check of card numbers: every second digit from the right counts double, by its digit sum."""
    double = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order, by digits of the same script."""
    rest = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(rest))) if c.isdecimal() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


Turn = Callable[[int, int, bytes], int]


def _card(text: str, turn: Turn) -> str | None:
    digits = _digits(text)
    if not _checksum_ok(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{turn(int(digits[:-1]), 10**n, b'card%d' % n):0{n}d}"
    return _refill(text, next(body + c for c in "0123456789" if _checksum_ok(body + c)))


#: Country codes of one and of two digits (fixed values); all others have three.
_COUNTRY_CODES = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(text: str, turn: Turn) -> str | None:
    """The digits behind the country code are permuted, whatever the groups they are written in.

    Numbers without a plus sign are those of North America, country 1. A trunk zero in brackets is no part of a number.
    """
    digits = _digits(text)
    country = next((digits[:k] for k in (1, 2) if digits[:k] in _COUNTRY_CODES), digits[:3]) if text[0] == "+" else "1"
    fixed = len(country) if text[0] == "+" else 0
    # Where the country code ends in the text, and a trunk zero behind it.
    places = [i for i, c in enumerate(text) if c.isdecimal()]
    start = places[fixed - 1] + 1 if fixed else 0
    trunk = re.match(r"[ .-]?\(0\)", text[start:])
    start += trunk.end() if trunk else 0
    digits = _digits(text[start:])
    n = len(digits)
    if not 4 <= n <= 14 or fixed and fixed + n < 8:
        return None
    return text[:start] + _refill(text[start:], f"{turn(int(digits), 10**n, b'phone+%s %d' % (country.encode(), n)):0{n}d}")


def _ip(text: str, turn: Turn) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = turn(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(text: str, turn: Turn) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    x = turn((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, b"ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain[:2], plain[2:4], plain[4:]) == 1


def _iban(text: str, turn: Turn) -> str | None:
    if not _iban_ok(text):
        return None
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    new = _classes(body, turn, b"iban" + country.encode())
    plain = country + f"{98 - _mod97(country, '00', new):02d}" + new
    rest = iter(plain)
    return "".join(c if c == " " else next(rest) for c in text)


def _is_date(year: int, one: int, two: int) -> bool:
    """Whether the fields are month and day in either order."""
    for month, day in ((one, two), (two, one)):
        if 1 <= month <= 12 and 1 <= day <= _days(year, month):
            return True
    return False


def _days(year: int, month: int) -> int:
    return 29 if month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def _date(text: str, turn: Turn) -> str | None:
    """Dates with the year first or last and month and day in either order, permuted among all dates of the same written form.

    A form is the sign between the fields, the place of the year and the width of the two other fields. Numbers
    that are no date of the form are permuted again, so dates never meet and each is turned back by its own form.
    """
    sign = next(c for c in text if not c.isdigit())
    fields = text.split(sign)
    at = 0 if len(fields[0]) == 4 else 2
    year, one, two = int(fields[at]), *(int(f) for f in fields[1 - at // 2 : 3 - at // 2])
    widths = [len(f) for f in fields[1 - at // 2 : 3 - at // 2]]
    if len(fields[at]) != 4 or not 1 <= year <= 9999 or not _is_date(year, one, two):
        return None
    # One digit stands for 1 to 9, two for 01 to 31.
    spans = [9 if w == 1 else 31 for w in widths]
    size = 9999 * spans[0] * spans[1]
    x = ((year - 1) * spans[0] + one - 1) * spans[1] + two - 1
    tweak = b"date%s%d%d%d" % (sign.encode(), at, *widths)
    while True:
        x = turn(x, size, tweak)
        rest, two = divmod(x, spans[1])
        year, one = divmod(rest, spans[0])
        if _is_date(year + 1, one + 1, two + 1):
            break
    others = [f"{v + 1:0{w}d}" for v, w in zip((one, two), widths, strict=True)]
    return sign.join([f"{year + 1:04d}", *others] if at == 0 else [*others, f"{year + 1:04d}"])


#: Characters that are permuted among themselves: small and capital letters, digits, and letters with marks of both sizes.
_CLASSES = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
)
_CLASS_OF = {c: (k, i) for k, chars in enumerate(_CLASSES) for i, c in enumerate(chars)}


def _classes(text: str, turn: Turn, tweak: bytes) -> str:
    """All characters permuted together, each within its class; others stay."""
    x, size, shape = 0, 1, []
    for c in text:
        k, i = _CLASS_OF.get(c, (-1, 0))
        if k >= 0:
            x, size = x * len(_CLASSES[k]) + i, size * len(_CLASSES[k])
        shape.append(str(k) if k >= 0 else c)
    # The shape is the format, so different shapes have permutations of their own.
    x = turn(x, size, tweak + "".join(shape).encode())
    out = []
    for c in reversed(text):
        k, _ = _CLASS_OF.get(c, (-1, 0))
        if k >= 0:
            x, i = divmod(x, len(_CLASSES[k]))
            c = _CLASSES[k][i]
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, turn: Turn) -> str | None:
    name, at, host = text.rpartition("@")
    return _classes(name, turn, b"email" + host.lower().encode()) + at + host


# Values that a phone number before them doesn't take in.
_OTHERS = (
    r"(?:\d{3}-\d{2}-\d{4}|\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
    r"|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?![ -]?\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?![ -]?\d)|\d{13,19})(?![0-9A-Za-z])"
)
_GAP = rf"(?:[.-]| (?!{_OTHERS}))?"
_NEXT_DIGIT = rf"\)?{_GAP}\(?\d"
_NUMBERS = re.compile(
    r"(?<![0-9A-Za-z])(?<!\d\.)(?:"
    # French and Spanish numbers have nine digits, others 7 to 14 in any groups.
    rf"(?P<phone>\+3[34](?:[ .-]?\(0\))?(?:{_NEXT_DIGIT}){{9}}(?![0-9A-Za-z])"
    rf"|\+\d{{1,3}}{_GAP}\(?\d{{2,4}}\)?{_GAP}\d{{3,4}}{_GAP}\d{{3,4}}(?![0-9A-Za-z])|\+\d{{1,3}}(?:{_NEXT_DIGIT}){{7,14}}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r"|(?P<ssn>\d{3}(?P<s1>[- ])\d{2}(?P=s1)\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?!\.\d))"
    r"|(?P<date>\d{4}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{1,2}|\d{1,2}(?P<s3>[-/.])\d{1,2}(?P=s3)\d{4})"
    r"|(?P<card>\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{1,7}|\d{4}(?P<s5>[ -])\d{6}(?P=s5)\d{4,5}|\d{13,19})"
    r")(?![0-9A-Za-z])"
)
_IBANS = re.compile(r"(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")
#: Characters of an IBAN by country (fixed values).
_IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (
        part.split(":")
        for part in (
            "15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|"
            "23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|26:IS TR|27:BI DJ FR GR IT MC MR SM|"
            "28:AL AZ BY CY DO GT HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU"
        ).split("|")
    )
    for country in countries.split()
}


def _iban_ends(text: str) -> list[int]:
    """Ends of groups at which an IBAN may stop: the one that gives its country's length first, then the longest first."""
    ends = [i for i in range(len(text), 0, -1) if text[i - 1] != " " and (i == len(text) or text[i] == " ")]
    length = _IBAN_LENGTHS.get(text[:2])
    return sorted(ends, key=lambda i: len(text[:i].replace(" ", "")) != length)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places of IBANs with a right check number. A match may go on into words behind it, or take in the start of another IBAN."""
    m = _IBANS.search(text)
    while m:
        end = next((i for i in _iban_ends(m[0]) if _iban_ok(m[0][:i])), 0)
        if end:
            yield m.start(), m.start() + end
        m = _IBANS.search(text, m.start() + (end or 1))


_EMAILS = re.compile(r"(?P<email>[\w.%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})")
_TURN = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "iban": _iban, "date": _date}


def pseudonymise(text: str | None, feistel: Feistel, back: bool = False) -> tuple[str | None, Counter]:
    """The text with its values replaced, and their number by kind. ``back`` turns pseudonyms into the values again."""
    counts: Counter = Counter()
    if not text:
        return text, counts
    found = [(m.start(), m.end(), next(k for k, v in m.groupdict().items() if v and k in _TURN)) for m in _NUMBERS.finditer(text)]
    found += [(start, end, "iban") for start, end in _ibans(text)]
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAILS.finditer(text)]
    if not found:
        return text, counts

    def turn(x: int, size: int, tweak: bytes) -> int:
        return feistel.permute(x, size, tweak, back)

    spans = []
    for start, end, kind in found:
        new = _TURN[kind](text[start:end], turn)
        if new is not None:
            spans.append((start, -end, kind, new))
    out, at = [], 0
    for start, end, kind, new in sorted(spans):
        if start < at:  # inside a value that began before
            continue
        out += (text[at:start], new)
        at = -end
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        feistel = Feistel(key)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [pseudonymise(t, feistel) for t in part.column("text").to_pylist()]
                out = {"doc_id": part.column("doc_id"), "text": [g[0] for g in got]}
                yield out | {f"n_{k}": np.array([g[1][k] for g in got], dtype=np.int64) for k in KINDS}

    return run


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``; other columns are ignored) with personal values replaced.

    Values are e-mail addresses (the part before the sign), card numbers with a right check digit, phone numbers (after a plus
    sign and the country 7 to 14 digits in any groups), IPv4 addresses, social security numbers, IBANs with a right check number,
    and dates that exist. Numbers that fail their check stay. Of values that overlap the first, then the longest counts; there are no
    other ties. ``key`` has any length, all of which counts, and is no part of the result.

    Returns ``doc_id, text`` and a count for each kind. Null texts stay null, empty ones empty; repeated rows get equal results,
    an empty table none. Texts are searched whole, however long.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(rows, _replace(key), PSEUDONYMS)
