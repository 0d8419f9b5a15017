"""Line grammars: a line to a struct of typed fields, or null where it does not parse.

Each grammar is one anchored pattern.  Its groups come out in a single pass: the
line is rewritten as its groups with a separator between them, and split.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as X

_CUT = "\x01"
APACHE = r'^([^ ]{0,45}) +-? *-? *\[([^\]]{0,63})\] *"([^ ]{0,15}) *([^ "]{0,511}) *(?:HTTP/([^"]{0,15}))?[^"]*"? *([0-9]*) *([0-9]*)'
#: Lenient: any user before the time, and referer and user agent after the size.
APACHE_LENIENT = r'^([^ ]{0,45}) +[^ \[]* *[^\[]*?\[([^\]]{0,63})\] *"([^ ]{0,15}) *([^ "]{0,511}) *(?:HTTP/([^"]{0,15}))?[^"]*"? *([0-9]*) *([0-9]*)-?(?: *"([^"]{0,511})"(?: *"([^"]{0,255})")?)?'
SYSLOG_HEAD = r"^(?:<([^>]*)>?)?([A-Za-z]{0,3}) *([0-9]*) *"
SYSLOG_TAIL = r"(?s)^\s*([^ ]{0,255})\s*([^\[:]{0,63})(?:\[([^\]]*)\]?)?:?\s*(.*)$"
# Level words of JSON lines and of nginx lines, in ascending order.
JSON_LEVEL_WORDS = [["DEBUG"], ["INFO"], ["WARN", "WARNING"], ["ERROR"], ["CRITICAL", "FATAL"]]
NGINX_LEVEL_WORDS = ["debug", "info", "notice", "warn", "error", "crit", "alert", "emerg"]
# Bytes of a syslog time, and those of a message that the normalised entry keeps.
SYSLOG_TIME_BYTES = 31
MESSAGE_BYTES, IP_BYTES = 255, 15


def _groups(line: Column, pattern: str, n: int) -> Column:
    whole = pattern if pattern.endswith("$") else pattern + "(?s:.*)$"
    return F.split(F.regexp_replace(line, whole, _CUT.join(f"${k}" for k in range(1, n + 1))), _CUT, -1)


def succeeds(form: Column, line: Column, lenient: bool = False) -> Column:
    """Whether a line parses by the grammar of its format; lenient JSON shows only when it is read."""
    return F.when(form == "APACHE", line.rlike(APACHE_LENIENT if lenient else APACHE)).when(form == "NGINX_ERROR", line.contains("]")).otherwise(form.isin("JSON", "SYSLOG") & line.isNotNull())


def apache(line: Column, lenient: bool = False, times: bool = True, checked: bool = False) -> Column:
    """times=False leaves ts null, for what needs no time; checked is for lines that are known to parse."""
    pattern, n = (APACHE_LENIENT, 9) if lenient else (APACHE, 7)
    g = _groups(line, pattern, n)
    g = g if checked else F.when(line.rlike(pattern), g)

    def of(parts: Column) -> Column:
        return F.struct(
            parts[0].alias("ip"),
            _time(X.apache_time(parts[1]), times).alias("ts"),
            parts[2].alias("method"),
            parts[3].alias("url"),
            parts[4].alias("http_version"),
            X.number(parts[5]).alias("status"),
            X.number(parts[6], "bigint").alias("size"),
            (parts[7] if lenient else F.lit("")).alias("referer"),
            (parts[8] if lenient else F.lit("")).alias("user_agent"),
        )

    return _once(g, of) if checked else F.when(g.isNotNull(), _once(g, of))


def _time(value: Column, wanted: bool) -> Column:
    return value if wanted else F.lit(None).cast("timestamp_ntz")


def _once(value: Column, of) -> Column:
    """of(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def json(line: Column, times: bool = True) -> Column:
    word = X.json_text(line, "level")
    level = F.lit(0)
    for k, words in reversed(list(enumerate(JSON_LEVEL_WORDS))):
        level = F.when(word.isin(words), k).otherwise(level)
    user = F.regexp_extract(X.json_text(line, "user_id", "metadata"), r"^\s*([0-9]*)", 1)
    return F.when(
        line.isNotNull(),
        F.struct(
            _time(X.iso_time(X.json_text(line, "timestamp")), times).alias("ts"),
            level.alias("level"),
            X.first_bytes(X.json_text(line, "service"), 63).alias("service"),
            X.json_text(line, "message").alias("message"),
            X.first_bytes(X.json_text(line, "ip", "metadata"), 45).alias("ip"),
            X.number(user).alias("user_id"),
        ),
    )


#: Jackson's leniencies that JSON's own rules do not have.
_JSON_RULES = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_lenient(line: Column, times: bool = True) -> Column:
    """An object by JSON's own rules; null where it is none.

    Escapes are read, keys count only at their own depth, the last of a repeated
    key holds, levels are words in any case.  A value that is itself an object is
    its text; metadata that is no object has no fields.  Text behind the object is
    not looked at.
    """
    whole = F.from_json(line, "timestamp string, level string, service string, message string, metadata string, _broken string", _JSON_RULES)

    def of(x: Column) -> Column:
        return F.when(x["_broken"].isNull(), _once(F.struct(x.alias("top"), F.from_json(x["metadata"], "ip string, user_id string, _broken string", _JSON_RULES).alias("inner")), fields))

    def fields(x: Column) -> Column:
        top, inner = x["top"], x["inner"]
        word = F.upper(top["level"])
        level = F.lit(0)
        for k, words in reversed(list(enumerate(JSON_LEVEL_WORDS))):
            level = F.when(word.isin(words), k).otherwise(level)
        sound = inner["_broken"].isNull()
        text = lambda c: F.coalesce(c, F.lit(""))
        return F.struct(
            _time(X.iso_time(text(top["timestamp"])), times).alias("ts"),
            level.alias("level"),
            X.first_bytes(text(top["service"]), 63).alias("service"),
            text(top["message"]).alias("message"),
            X.first_bytes(text(F.when(sound, inner["ip"])), 45).alias("ip"),
            X.number(F.regexp_extract(text(F.when(sound, inner["user_id"])), r"^\s*([0-9]*)", 1)).alias("user_id"),
        )

    return F.when(line.rlike(r"^\s*\{"), _once(whole, of))


def syslog(line: Column, year: int | None = None, times: bool = True) -> Column:
    year = datetime.date.today().year if year is None else year
    # head, clock and tail come one after the other, each found once: priority, month, day and rest; then the time and what follows it
    head = F.struct(_groups(line, SYSLOG_HEAD, 3).alias("g"), F.regexp_replace(line, SYSLOG_HEAD, "").alias("rest"))

    def clock(x: Column) -> Column:
        room = SYSLOG_TIME_BYTES - 2 - F.octet_length(x["g"][1]) - F.octet_length(x["g"][2])
        first = F.substring(x["rest"].cast("binary"), F.lit(1), room).cast("string")
        return F.struct(x["g"].alias("g"), x["rest"].alias("rest"), F.coalesce(F.nullif(F.regexp_extract(first, "^[^:]*:[^:]*:[0-9]*", 0), F.lit("")), first).alias("clock"))

    def tail(x: Column) -> Column:
        # the clock is part of the rest, so what follows it begins after its bytes
        text = F.substring(x["rest"].cast("binary"), F.octet_length(x["clock"]) + 1, F.octet_length(x["rest"])).cast("string")
        priority = X.number(F.regexp_extract(x["g"][0], r"^\s*([0-9]*)", 1))
        return F.struct(priority.alias("priority"), F.concat_ws(" ", x["g"][1], x["g"][2], x["clock"]).alias("stamp"), _groups(text, SYSLOG_TAIL, 4).alias("g"))

    def of(x: Column) -> Column:
        g = x["g"]
        return F.struct(
            x["priority"].alias("priority"),
            _time(X.syslog_time(x["stamp"], year), times).alias("ts"),
            g[0].alias("hostname"),
            g[1].alias("service"),
            X.number(F.regexp_extract(g[2], r"^\s*([0-9]*)", 1)).alias("pid"),
            g[3].alias("message"),
            g[3].rlike("authentication failure|Failed password|invalid user").alias("is_auth_failure"),
            g[1].contains("sudo").alias("is_sudo_attempt"),
            g[3].rlike("REJECT|DROP").alias("is_firewall_block"),
        )

    return F.when(line.isNotNull(), _once(_once(_once(head, clock), tail), of))


def nginx(line: Column, times: bool = True) -> Column:
    """Null without a closing bracket."""
    word = F.regexp_extract(line, r"^[^\[]*\[(" + "|".join(NGINX_LEVEL_WORDS) + ")", 1)
    level = F.lit(0)
    for k, name in enumerate(NGINX_LEVEL_WORDS[1:], 1):
        level = F.when(word == name, k).otherwise(level)
    ids = r"^[^\]]*\].([0-9]+)#([0-9]+)"
    pid = F.regexp_extract(line, r"^[^\]]*\].([0-9]+)", 1)
    return F.when(
        line.contains("]"),
        F.struct(
            _time(X.nginx_time(line), times).alias("ts"),
            level.alias("level"),
            X.number(pid).alias("pid"),
            X.number(F.regexp_extract(line, ids, 2)).alias("tid"),
            X.number(F.regexp_extract(line, r"^[^*]*\*([0-9]*)", 1), "bigint").alias("connection_id"),
            F.regexp_extract(line, r"(?s)^[^\]]*\].[^:]*:.(.*?)(?:, client:.*)?$", 1).alias("message"),
            F.regexp_extract(line, "client: ([^, ]{0,45})", 1).alias("client_ip"),
            F.lit("").alias("server"),
            F.lit("").alias("request"),
        ),
    )
