"""Lines to normalised entries: parse, classify, filter by mode, normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import classify, parse
from .detect import source_formats, with_line_format, with_sticky_format

_FORMATS = {"APACHE": "apache", "JSON": "json", "SYSLOG": "syslog", "NGINX_ERROR": "nginx"}


def _made(lenient: bool, year: int | None, times: bool, checked: bool) -> Column:
    value = F.col("value")
    json = parse.json_lenient if lenient else parse.json
    structs = {"apache": parse.apache(value, lenient, times, checked), "json": json(value, times), "syslog": parse.syslog(value, year, times), "nginx": parse.nginx(value, times)}
    return F.explode(F.array(F.struct(*(F.when(F.col("format") == form, structs[name]).alias(name) for form, name in _FORMATS.items())))).alias("made")


def parsed(lines: DataFrame, lenient: bool = False, year: int | None = None, times: bool = True) -> DataFrame:
    """Lines (with format) that parse, and a struct for each grammar; only that of the line's format is computed.

    The structs come out of a generator of one row.  Filters on them do not move
    below it, so that a line is parsed once however often its fields are used.
    """
    rows = lines.where(parse.succeeds(F.col("format"), F.col("value"), lenient)).select("*", _made(lenient, year, times, True))
    rows = rows.select(*lines.columns, "made.*")
    return rows.where("format <> 'JSON' OR json IS NOT NULL") if lenient else rows


def _chosen(parts: dict[str, Column]) -> Column:
    out = None
    for form, name in _FORMATS.items():
        hit = F.col("format") == form
        out = F.when(hit, parts[name]) if out is None else out.when(hit, parts[name])
    return out


def events(rows: DataFrame, description: bool = True) -> DataFrame:
    """Rows of parsed() with event_types, severity and, on demand, description."""
    made = {name: getattr(classify, name)(F.col(name)) for name in _FORMATS.values()}
    columns = {"event_types": _chosen({k: v.event_types for k, v in made.items()}), "severity": _chosen({k: v.severity for k, v in made.items()})}
    if description:
        columns["description"] = _chosen({k: v.description for k, v in made.items()})
        columns["ts"] = _chosen({name: F.col(name)["ts"] for name in _FORMATS.values()})
    return rows.withColumns(columns)


def in_mode(rows: DataFrame, mode: str) -> DataFrame:
    """Events of a mode: any of its types; `full` keeps all, those without a type too."""
    bits = X.mode_bits(mode)
    return rows if bits == X.MODES["full"] else rows.where(F.col("event_types").bitwiseAND(bits) != 0)


def normalised(rows: DataFrame, lenient: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events as entries: format, level, http_status, ip, message."""
    by_severity = X.level_from_severity(F.col("severity"))
    level = _chosen({"apache": by_severity, "json": X.level_from_json_level(F.col("json.level")), "syslog": by_severity, "nginx": by_severity})
    address = lambda c: c if lenient else X.first_bytes(c, parse.IP_BYTES)
    ip = _chosen({"apache": address(F.col("apache.ip")), "json": address(F.col("json.ip")), "syslog": X.ipv4(F.col("syslog.message")), "nginx": address(F.col("nginx.client_ip"))})
    message = _chosen({"apache": F.col("apache.url"), "json": F.col("json.message"), "syslog": F.col("syslog.message"), "nginx": F.col("nginx.message")})
    status = F.when(F.col("format") == "APACHE", F.col("apache.status")).otherwise(0)
    return rows.select(*keep, "format", level.alias("level"), status.cast("int").alias("http_status"), ip.alias("ip"), X.first_bytes(message, parse.MESSAGE_BYTES).alias("message"))


def entries(lines: DataFrame, mode: str = "full", lenient: bool = False, year: int | None = None, keep: tuple[str, ...] = ("source",), sources: int | None = None) -> DataFrame:
    """Normalised entries of lines (source, pos, value) in a mode.

    Strict: a source has the format of its first line.  Lenient: each line has
    its own, users and agents of apache lines are read, and addresses are whole.
    sources: the most sources that there can be, if known.
    """
    formatted = with_line_format(lines) if lenient else with_sticky_format(lines, sources=sources)
    rows = events(parsed(formatted, lenient, year, times=False), description=False)
    return normalised(in_mode(rows, mode), lenient, keep)


def event_rows(lines: DataFrame, mode: str = "full", lenient: bool = False, year: int | None = None) -> DataFrame:
    """Whole events of lines: source, format, event_types, severity, description, ts and the four structs."""
    formatted = with_line_format(lines) if lenient else with_sticky_format(lines)
    return in_mode(events(parsed(formatted, lenient, year)), mode).drop("pos", "value")


#: Why a line is no entry.
REASONS = {"EMPTY": "empty", "UNKNOWN": "no known format", "APACHE": "not an apache line", "JSON": "broken json", "NGINX_ERROR": "no closing bracket"}


def sorted_out(lines: DataFrame, mode: str = "full", lenient: bool = False, year: int | None = None, keep: tuple[str, ...] = ("source", "pos")) -> DataFrame:
    """Every line once: `keep`, reason, the columns of its entry, and the line itself (value) where it is none.

    reason is null for an entry, and one of REASONS for a line that does not parse;
    the columns of the entry but format are null there.  Empty and null lines are
    rejected, and do not decide the format of their source; a source of nothing
    else has format UNKNOWN.  Repeated lines stay.  A mode other than `full` leaves
    out entries of other modes, and no rejected line.
    """
    if lenient:
        formatted = with_line_format(lines)
    elif "first" in lines.columns:
        formatted = with_sticky_format(lines)
    else:
        formatted = lines.join(source_formats(lines.where("value <> ''")), "source", "left").withColumn("format", F.coalesce("format", F.lit("UNKNOWN")))
    rows = formatted.select("*", _made(lenient, year, False, False)).select(*formatted.columns, "made.*")
    empty = F.coalesce(F.col("value") == "", F.lit(True))
    reason = F.when(empty, REASONS["EMPTY"]).when(F.col("format") == "UNKNOWN", REASONS["UNKNOWN"])
    for form in ("APACHE", "JSON", "NGINX_ERROR"):
        reason = reason.when((F.col("format") == form) & F.col(_FORMATS[form]).isNull(), REASONS[form])
    rows = events(rows.withColumn("reason", reason), description=False)
    bits = X.mode_bits(mode)
    if bits != X.MODES["full"]:
        rows = rows.where(F.col("reason").isNotNull() | (F.col("event_types").bitwiseAND(bits) != 0))
    out = normalised(rows, lenient, (*keep, "reason", "value"))
    entry = F.col("reason").isNull()
    return out.select(*keep, "reason", "format", *(F.when(entry, F.col(c)).alias(c) for c in ("level", "http_status", "ip", "message")), F.when(~entry, F.col("value")).alias("value"))
