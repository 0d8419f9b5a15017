"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and addresses are replaced by others of the same
format: a keyed Feistel network permutes the values that the format allows
(walking on while the result lies outside), and check digits are made anew.  So
equal values stay equal in all documents, different ones stay different, every
replacement is valid again, and the text keeps its length.  Only the
neighbourhoods of digits and a few signs are searched.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

ROUNDS = 10
#: Used by the registered query only; a real run passes its own secret key.
EXAMPLE_KEY = b"an example key, not a secret"

_HINT = np.zeros(256, dtype=bool)
_HINT[[*range(0x30, 0x3A), 0x40, 0x3D, 0x3A]] = True  # digits, @, = and :
_REMEMBERED = 100_000

_PATTERN = re.compile(
    r"""
      (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b)
    | (?P<secret>(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)["']?\s*(?:[:=]|\bis\b)\s*["']?(?P<value>[A-Za-z0-9+/_-]{8,}))
    | (?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
    | (?P<isodate>(?<![\d./-])\d{4}(?P<sign>[-/.])\d{1,2}(?P=sign)\d{1,2}(?!\d|[./-]\d))
    | (?P<date>(?<![\d./-])\d{1,2}(?P<mark>[-/.])\d{1,2}(?P=mark)\d{4}(?!\d|[./-]\d))
    | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    | (?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}:?(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![\w:]))
    | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
    | (?P<phone>(?<![\d(+])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d))
    | (?P<plus>(?<![\d+])\+\d{8,15}(?!\d))
    | (?P<groups>(?<![\d+])\+\d(?:(?:[ .-]|[ ]?\(|\)[ .-]?)?(?!(?<=[ .-])\d{4}(?:[ -]\d{4}){3})\d){7,14}(?<=\d\d)(?!\d|[-./:]\d))
    | (?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))
    """,
    re.VERBOSE,
)


class Permutation:
    """A keyed permutation of the numbers below `size`, one for each tweak."""

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key, digest_size=32).digest()

    def __call__(self, value: int, size: int, tweak: str) -> int:
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        name = f"{tweak}/{size}/".encode()
        while True:
            left, right = value >> half, value & mask
            for k in range(ROUNDS):
                mixed = blake2b(name + bytes([k]) + right.to_bytes((half + 7) // 8, "big"), key=self.key, digest_size=(half + 7) // 8).digest()
                left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
            value = (left << half) | right
            if value < size:
                return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refilled(text: str, chars: str) -> str:
    """text with its letters and digits replaced in turn."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit after `digits`."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _classes(chars: str) -> list[tuple[int, int]]:
    """First code and number of characters of each character's class."""
    return [(48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26) for c in chars]


def _same_classes(chars: str, permute: Permutation, tweak: str) -> str:
    """Each digit, capital and small letter becomes another of its class; the whole is permuted at once."""
    kinds = _classes(chars)
    value, size, shape = 0, 1, ""
    for c, (first, n) in zip(chars, kinds):
        value = value * n + ord(c) - first
        size *= n
        shape += {10: "9", 26: "a"}[n] if first != 65 else "A"
    value, out = permute(value, size, f"{tweak}/{shape}"), []
    for first, n in reversed(kinds):
        value, k = divmod(value, n)
        out.append(chr(first + k))
    return "".join(reversed(out))


def _mixed(values: list[int], sizes: list[int], permute: Permutation, tweak: str) -> list[int]:
    value, size = 0, 1
    for v, n in zip(values, sizes):
        value, size = value * n + v, size * n
    value, out = permute(value, size, tweak), []
    for n in reversed(sizes):
        value, k = divmod(value, n)
        out.append(k)
    return out[::-1]


def _card(text: str, permute: Permutation) -> str | None:
    digits = _digits(text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    body = digits[0] + str(permute(int(digits[1:-1]), 10**n, f"card/{len(digits)}")).zfill(n)
    return _refilled(text, body + str(luhn(body)))


def _cased(text: str, permute: Permutation, tweak: str) -> str:
    """Letters and digits of text become others of their class, the same ones whatever the case; the case stays."""
    new = _refilled(text, _same_classes("".join(c for c in text.lower() if c.isalnum()), permute, tweak))
    return "".join(c.upper() if old.isupper() else c for old, c in zip(text, new))


def _email(text: str, permute: Permutation) -> str | None:
    """The name and each label of the host but the last."""
    name, _, host = text.partition("@")
    *labels, top = host.split(".")
    return ".".join([_cased(name, permute, "email") + "@" + _cased(labels[0], permute, "host"), *(_cased(x, permute, "host") for x in labels[1:]), top])


def _iban(text: str, permute: Permutation) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _same_classes(plain[4:], permute, "iban/" + plain[:2])
    check = 98 - number(body + plain[:2] + "00") % 97
    return _refilled(text, f"{plain[:2]}{check:02d}{body}")


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _kind(d: datetime.date) -> tuple[bool, int]:
    """What each writing of a date shows: whether the month has one digit, and the day one, two up to 12, or more, which may stand second."""
    return d.month < 10, 0 if d.day < 10 else 1 if d.day <= 12 else 2


@lru_cache(maxsize=1)
def _days() -> tuple[dict[tuple[bool, int], list[int]], dict[int, int]]:
    """The days of each kind, and each day's place among those of its kind."""
    days: dict[tuple[bool, int], list[int]] = {}
    place = {}
    for k in range(_FIRST, _LAST + 1):
        some = days.setdefault(_kind(datetime.date.fromordinal(k)), [])
        place[k] = len(some)
        some.append(k)
    return days, place


def _other_day(k: int, month: str, day: str, permute: Permutation) -> tuple[str, str, str]:
    """Year, month and day of the date that stands for this one in all writings, with as many digits."""
    days, place = _days()
    kind = _kind(datetime.date.fromordinal(k))
    d = datetime.date.fromordinal(days[kind][permute(place[k], len(days[kind]), f"date/{kind[0]:d}{kind[1]}")])
    return str(d.year), str(d.month).zfill(len(month)), str(d.day).zfill(len(day))


def _day(year: str, month: str, day: str) -> int | None:
    try:
        k = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    return k if _FIRST <= k <= _LAST else None


def _isodate(text: str, permute: Permutation) -> str | None:
    year, month, day = text.split(text[4])
    if (k := _day(year, month, day)) is None:
        return None
    return text[4].join(_other_day(k, month, day, permute))


def _date(text: str, permute: Permutation) -> str | None:
    sign = next(c for c in text if not c.isdigit())
    a, b, year = text.split(sign)
    if (k := _day(year, b, a)) is not None:
        return sign.join(reversed(_other_day(k, b, a, permute)))
    if (k := _day(year, a, b)) is not None:
        year, a, b = _other_day(k, a, b, permute)
        return sign.join([a, b, year])
    return None


def _ssn(text: str, permute: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    a, g, s = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], permute, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _ip(text: str, permute: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or parts[0] == "0":
        return None
    # each part stays among the numbers of as many digits, so that the length stays
    first = {1: 0, 2: 10, 3: 100}
    count = {1: 10, 2: 90, 3: 156}
    lows, sizes = [first[len(p)] for p in parts], [count[len(p)] for p in parts]
    if len(parts[0]) == 1:
        lows[0], sizes[0] = 1, 9
    new = _mixed([int(p) - low for p, low in zip(parts, lows)], sizes, permute, "ip/" + ".".join(str(len(p)) for p in parts))
    return ".".join(str(low + n) for low, n in zip(lows, new))


def _ipv6(text: str, permute: Permutation) -> str | None:
    """Groups that are not zero become others of as many hexadecimal digits, so that each writing of an address fits."""
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    groups = [value >> 16 * k & 0xFFFF for k in range(7, -1, -1)]
    if sum(map(bool, groups)) < 2 or not _digits(text):
        return None
    sizes = [len(f"{g:x}") for g in groups if g]
    lows = [1 if n == 1 else 16 ** (n - 1) for n in sizes]
    shape = "".join(str(len(f"{g:x}")) if g else "0" for g in groups)
    new = _mixed([g - low for g, low in zip(filter(None, groups), lows)], [16**n - low for n, low in zip(sizes, lows)], permute, "ipv6/" + shape)
    rest = iter(low + n for n, low in zip(new, lows))
    out = ":".join(f"{next(rest):x}".zfill(len(x)) if x and int(x, 16) else x for x in text.split(":"))
    return out.upper() if text != text.lower() else out


# Calling codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _phone(text: str, permute: Permutation) -> str | None:
    """The digits after the calling code, the same in all writings; a number without one is of code 1, and a zero in brackets stays."""
    head, zero, tail = text.partition("(0)") if text[0] == "+" else (text, "", "")
    digits = _digits(head + tail)
    code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3]) if text[0] == "+" else ""
    own = digits[len(code) :]
    if code in ("", "1") and len(own) == 10:
        area, exchange, line = int(own[:3]), int(own[3:6]), int(own[6:])
        if area < 200 or exchange < 200:
            return None
        a, e, n = _mixed([area - 200, exchange - 200, line], [800, 800, 10000], permute, "phone")
        new = f"{a + 200:03d}{e + 200:03d}{n:04d}"
    else:
        new = str(permute(int(own), 10 ** len(own), f"phone/{code}/{len(own)}")).zfill(len(own))
    at = len(_digits(head))
    return _refilled(head, (code + new)[:at]) + zero + _refilled(tail, (code + new)[at:])


def _secret(text: str, permute: Permutation) -> str | None:
    """Hexadecimal values stay hexadecimal; others must mix digits and letters."""
    if re.fullmatch(r"[0-9a-f]{8,}", text):
        return f"{permute(int(text, 16), 16 ** len(text), 'hex'):0{len(text)}x}"
    chars = "".join(c for c in text if c.isalnum())
    if not (any(c.isdigit() for c in chars) and any(c.isalpha() for c in chars)):
        return None
    return _refilled(text, _same_classes(chars, permute, "secret"))


def _access(text: str, permute: Permutation) -> str | None:
    """A cloud access key keeps the four letters that mark it."""
    return text[:4] + _same_classes(text[4:], permute, "access")


_MAKERS: dict[str, Callable[[str, Permutation], str | None]] = {"email": _email, "secret": _secret, "access": _access, "iban": _iban, "isodate": _isodate, "date": _date, "ssn": _ssn, "ipv6": _ipv6, "ip": _ip, "phone": _phone, "plus": _phone, "groups": _phone, "card": _card}


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        self.permute = Permutation(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def _new(self, kind: str, value: str) -> str | None:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        if (kind, value) not in self.known:
            self.known[kind, value] = _MAKERS[kind](value, self.permute)
        return self.known[kind, value]

    def replaced(self, text: str, found: list[str]) -> str:
        """text with its personal data replaced; their kinds are added to `found`."""
        out, at, begin = [], 0, 0
        while m := _PATTERN.search(text, begin):
            kind = m.lastgroup
            a, b = m.span("value") if kind == "secret" else m.span()
            new = self._new(kind, text[a:b])
            if new is None:
                begin = _after_first(text, m.start(), m.end())
                continue
            out += [text[at:a], new]
            at = begin = b
            found.append({"isodate": "date", "plus": "phone", "groups": "phone", "access": "secret", "ipv6": "ip"}.get(kind, kind))
        return "".join([*out, text[at:]]) if out else text


def _after_first(text: str, begin: int, end: int) -> int:
    """Where to search on after a match that is not valid: behind its first run of letters or digits."""
    k = begin
    while k < end and not text[k].isalnum():
        k += 1
    while k < end and text[k].isalnum():
        k += 1
    return max(k, begin + 1)


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, begin and end of the passages with hints: such words with four before and one after, run together."""
    starts, ends, counts = K.spans(data, offsets)
    hints = np.flatnonzero(_HINT[data])
    word = np.flatnonzero(np.searchsorted(hints, ends) > np.searchsorted(hints, starts))
    if not len(word):
        return word, word, word
    owner = np.repeat(np.arange(len(counts)), counts)
    doc = owner[word]
    new = np.ones(len(word), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (np.diff(word) > 6)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(word)) - 1
    begin = np.cumsum(counts) - counts
    low = np.maximum(word[first] - 4, begin[doc[first]])
    high = np.minimum(word[last] + 1, (begin + counts - 1)[doc[first]])
    return doc[first], starts[low], ends[high]


def _pass(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key)
        for batch in batches:
            for part in K.slices(batch, 1):
                data, offsets = K.buffers(part.column(1))
                changes: dict[int, list[tuple[int, int, bytes, list[str]]]] = {}
                for doc, a, b in zip(*(x.tolist() for x in _places(data, offsets))):
                    before, found = data[a:b].tobytes(), []
                    after = pseudonyms.replaced(before.decode("utf-8", "surrogateescape"), found).encode("utf-8", "surrogateescape")
                    if found:
                        changes.setdefault(doc, []).append((a, b, after, found))
                texts = part.column(1)
                kinds: list[list[str]] = [[]] * part.num_rows
                if changes:
                    new = texts.to_pylist() if texts.type == pa.string() else texts.cast(pa.string()).to_pylist()
                    for doc, parts in changes.items():
                        at, pieces = int(offsets[doc]), []
                        for a, b, after, _ in parts:
                            pieces += [data[at:a].tobytes(), after]
                            at = b
                        pieces.append(data[at : offsets[doc + 1]].tobytes())
                        new[doc] = b"".join(pieces).decode("utf-8", "replace")
                        kinds[doc] = [k for *_, found in parts for k in found]
                    texts = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(kinds, pa.list_(pa.string())), *part.columns[2:]], ["doc_id", "text", "kinds", *part.schema.names[2:]])

    return run


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text, and kinds, those of the replaced values in order.

    Replaced are e-mail addresses but for the last label of their hosts, card
    numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 and IPv6
    addresses, phone numbers (of ten digits as 3-3-4, or with + and 8 to 15 digits
    in any groups), dates of 1900 to 2099 in numbers (day, month or year first,
    with or without zeros before one digit), the values of passwords and tokens,
    and cloud access keys.  Equal values get one pseudonym in all writings: with or
    without separators, zeros, calling code 1, in any case and any order of a
    date's parts, of which day first is read where both orders are possible.  What
    has to stay so stays: that a month has one digit, a day one, two up to 12, or
    more, and a group of an IPv6 address its digits.  What fails its check stays.  A null text stays null, and one without such data stays as
    it is.  Rows without an id and repeated rows are treated alike.  Other columns
    are not read.
    """
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pass(key), "doc_id long, text string, kinds array<string>")


def without_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts replaced as by pseudonymised(), all other columns as they are, whatever their names.

    Null and empty texts stay; rows without an id and repeated rows are treated as
    others are.  The published example key is refused.
    """
    if key == EXAMPLE_KEY:
        raise ValueError("the example key is published: whoever has it can undo the pseudonyms")
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    passed, fields, own = K.carried(docs, text_col)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), *fields])
    out = K.bounded(docs).select(*columns, *passed).mapInArrow(_pass(key), schema)
    own[text_col] = F.col("text")
    return out.select(*(own[c].alias(c) for c in docs.columns))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"), EXAMPLE_KEY)
