"""Scalar functions of the log grammar, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Event type bits, in the order in which their names are listed.
SECURITY, PERFORMANCE, TRAFFIC, ERROR, NORMAL = 1, 2, 4, 8, 16
EVENT_TYPES = {"SECURITY": SECURITY, "PERFORMANCE": PERFORMANCE, "TRAFFIC": TRAFFIC, "ERROR": ERROR, "NORMAL": NORMAL}
#: Analysis modes and the event types that each keeps.
MODES = {"security": SECURITY, "performance": PERFORMANCE, "traffic": TRAFFIC, "full": SECURITY | PERFORMANCE | TRAFFIC | ERROR}
# Names of severities 0 to 4, of JSON levels 0 to 4, and the level that each severity stands for.
SEVERITY_NAMES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
JSON_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "CRITICAL"]
SEVERITY_LEVELS = ["INFO", "INFO", "WARN", "ERROR", "CRITICAL"]
# Spellings of levels in plain text.
LEVEL_WORDS = {"DEBUG": ["DEBUG"], "INFO": ["INFO", "NOTICE"], "WARN": ["WARN", "WARNING"], "ERROR": ["ERROR", "ERR"], "CRITICAL": ["CRIT", "CRITICAL", "ALERT", "EMERG"]}

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = r"\.".join([_OCTET] * 4) + "(?:[^0-9]|$)"


def mode_bits(mode: str) -> int:
    """Bits of a mode given in any case; ValueError for another word."""
    try:
        return MODES[mode.lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"mode must be one of {', '.join(MODES)}") from None


def mode_bits_of(word: Column) -> Column:
    """Bits of the mode that a word names in any case; null for another word and for null."""
    out = F.lit(None).cast("int")
    for name, bits in MODES.items():
        out = F.when(F.lower(word) == name, bits).otherwise(out)
    return out


def _named(value: Column, names: list[str]) -> Column:
    out = F.when(value == 0, names[0])
    for k, name in enumerate(names[1:], 1):
        out = out.when(value == k, name)
    return out.otherwise("UNKNOWN")


def level_from_severity(severity: Column) -> Column:
    return _named(severity, SEVERITY_LEVELS)


def level_from_json_level(level: Column) -> Column:
    return _named(level, JSON_LEVELS)


def severity_name(severity: Column) -> Column:
    return _named(severity, SEVERITY_NAMES)


def level_from_string(text: Column) -> Column:
    """Level of a word in any case; only its first 15 bytes count."""
    word = F.upper(first_bytes(text, 15))
    out = F.when(word.isNull(), "UNKNOWN")
    for level, words in LEVEL_WORDS.items():
        out = out.when(word.isin(words), level)
    return out.otherwise("UNKNOWN")


def event_type_name(types: Column) -> Column:
    """Names of the set bits, parted by spaces."""
    return F.concat_ws(" ", *(F.when(types.bitwiseAND(bit) != 0, name) for name, bit in EVENT_TYPES.items()))


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes; a character may be cut."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(text.cast("binary"), 1, n).cast("string"))


def number(digits: Column, kind: str = "int") -> Column:
    """Value of a run of digits; 0 if it is empty or too large."""
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast(kind), F.lit(0).cast(kind))


def ipv4(text: Column) -> Column:
    """The first dotted quad with parts of 0 to 255, without leading zeros; empty if there is none."""
    parts = [F.regexp_extract(text, IPV4, k) for k in (1, 2, 3, 4)]
    return F.when(text.rlike(IPV4), F.concat_ws(".", *parts)).otherwise("")


def json_text(text: Column, key: str, after: str = "") -> Column:
    """Value of the first `"key":` (behind `after`), by search rather than by JSON's rules: up to the next quote, comma or brace."""
    lead = f'(?s)"{after}".*?' if after else ""
    pattern = f'{lead}"{key}":\\s*(?:"([^"]*)"|([^",}}][^,}}]*))?'
    return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def has(text: Column, *parts: str) -> Column:
    """Whether any part stands in the text, ASCII letters in any case."""
    return text.rlike("(?i)" + "|".join(escaped(p) for p in parts))


def escaped(literal: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in literal)


def apache_time(text: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS without its zone; null if it is none."""
    return F.when(text.rlike(f"^[0-9]+/{_MONTH}/"), F.try_to_timestamp(F.substring(text, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))).cast("timestamp_ntz")


def iso_time(text: Column) -> Column:
    """yyyy-mm-ddTHH:MM:SS, without what follows; null if it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def syslog_time(text: Column, year: int) -> Column:
    """Mon d HH:MM:SS of the given year; null if it is none."""
    return F.when(text.rlike(f"^{_MONTH} "), F.try_to_timestamp(F.concat(F.lit(f"{year} "), text), F.lit("yyyy MMM d HH:mm:ss"))).cast("timestamp_ntz")


def nginx_time(text: Column) -> Column:
    """yyyy/mm/dd HH:MM:SS; null if it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz")


def percent(done: Column, total: Column) -> Column:
    """Whole percent, 100 at most; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(0).cast("int")


def epoch(ts: Column, zone: str) -> Column:
    """Seconds since 1970 UTC of a time without a zone, read in `zone`; null for null."""
    return F.make_timestamp_ltz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts), F.lit(zone)).cast("long")
