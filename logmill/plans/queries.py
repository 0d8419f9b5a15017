"""Registered queries of the log engine and the DuckDB SQL that each must equal.

The queries run over synthetic lines of the table events.  The SQL writes the
same lines in DuckDB's dialect and parses them again with its own regular
expressions; it never reads the columns that the lines were made from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import classify, detect, entries, metrics, parse
from ..sources import synthetic
from ..sources.files import clean_lines, line_counts, read_logs
from ..sources.scratch import scratch_folder
from ..streaming import logs
from . import live, quarantine, report

YEAR = 2024
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, parts: list[str]) -> str:
    return f"regexp_matches({column}, {_q('(?i)' + '|'.join(X.escaped(p) for p in parts))})"


# --- SQL of the grammars -------------------------------------------------------------------


def _int(text: str, kind: str = "INTEGER") -> str:
    return f"coalesce(TRY_CAST(nullif({text}, '') AS {kind}), 0)"


def _part(line: str, pattern: str, k: int) -> str:
    return f"regexp_extract({line}, {_q(pattern)}, {k})"


def _stamp(text: str, n: int, form: str) -> str:
    return f"try_strptime(substr({text}, 1, {n}), {_q(form)})"


def _json(line: str, key: str, after: str = "") -> str:
    lead = f'(?s)"{after}".*?' if after else ""
    pattern = f'{lead}"{key}":\\s*(?:"([^"]*)"|([^",}}][^,}}]*))?'
    return f"concat({_part(line, pattern, 1)}, {_part(line, pattern, 2)})"


def _cases(column: str, words: list[list[str]], otherwise: int = 0) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(map(_q, w))}) THEN {k}" for k, w in enumerate(words)) + f" ELSE {otherwise} END"


_JSON_WORDS = [["DEBUG"], ["INFO"], ["WARN", "WARNING"], ["ERROR"], ["CRITICAL", "FATAL"]]


def _fields(kind: str, v: str = "value", lenient: bool = False) -> dict[str, str]:
    """SQL of each field of a grammar."""
    if kind == "apache":
        g = lambda k: _part(v, parse.APACHE_LENIENT if lenient else parse.APACHE, k)
        return {"ip": g(1), "ts": _stamp(g(2), 20, "%d/%b/%Y:%H:%M:%S"), "method": g(3), "url": g(4), "http_version": g(5), "status": _int(g(6)), "size": _int(g(7), "BIGINT"), "referer": g(8) if lenient else "''", "user_agent": g(9) if lenient else "''"}
    if kind == "json" and lenient:
        j = lambda path: f"coalesce(CASE WHEN json_valid({v}) THEN json_extract_string({v}, '$.{path}') END, '')"
        return {"ts": _stamp(j("timestamp"), 19, "%Y-%m-%dT%H:%M:%S"), "level": _cases(f"upper({j('level')})", _JSON_WORDS), "service": f"substr({j('service')}, 1, 63)", "message": j("message"), "ip": f"substr({j('metadata.ip')}, 1, 45)", "user_id": _int(_part(j("metadata.user_id"), r"^\s*([0-9]*)", 1))}
    if kind == "json":
        return {"ts": _stamp(_json(v, "timestamp"), 19, "%Y-%m-%dT%H:%M:%S"), "level": _cases(_json(v, "level"), _JSON_WORDS), "service": f"substr({_json(v, 'service')}, 1, 63)", "message": _json(v, "message"), "ip": f"substr({_json(v, 'ip', 'metadata')}, 1, 45)", "user_id": _int(_part(_json(v, "user_id", "metadata"), r"^\s*([0-9]*)", 1))}
    if kind == "syslog":
        h = lambda k: _part(v, parse.SYSLOG_HEAD, k)
        rest = f"regexp_replace({v}, {_q(parse.SYSLOG_HEAD)}, '')"
        head = f"substr({rest}, 1, 29 - strlen({h(2)}) - strlen({h(3)}))"
        clock = f"coalesce(nullif({_part(head, '^[^:]*:[^:]*:[0-9]*', 0)}, ''), {head})"
        tail = f"substr({rest}, strlen({clock}) + 1)"
        t = lambda k: _part(tail, parse.SYSLOG_TAIL, k)
        return {
            "priority": _int(_part(h(1), r"^\s*([0-9]*)", 1)),
            "ts": f"try_strptime(concat('{YEAR} ', {h(2)}, ' ', {h(3)}, ' ', {clock}), '%Y %b %d %H:%M:%S')",
            "hostname": t(1),
            "service": t(2),
            "pid": _int(_part(t(3), r"^\s*([0-9]*)", 1)),
            "message": t(4),
            "is_auth_failure": f"regexp_matches({t(4)}, 'authentication failure|Failed password|invalid user')",
            "is_sudo_attempt": f"contains({t(2)}, 'sudo')",
            "is_firewall_block": f"contains({t(4)}, 'REJECT') OR contains({t(4)}, 'DROP')",
        }
    word = _part(v, r"^[^\[]*\[(" + "|".join(parse.NGINX_LEVEL_WORDS) + ")", 1)
    return {
        "ts": _stamp(v, 19, "%Y/%m/%d %H:%M:%S"),
        "level": _cases(word, [[w] for w in parse.NGINX_LEVEL_WORDS]),
        "pid": _int(_part(v, r"^[^\]]*\].([0-9]+)", 1)),
        "tid": _int(_part(v, r"^[^\]]*\].([0-9]+)#([0-9]+)", 2)),
        "connection_id": _int(_part(v, r"^[^*]*\*([0-9]*)", 1), "BIGINT"),
        "message": _part(v, r"(?s)^[^\]]*\].[^:]*:.(.*?)(?:, client:.*)?$", 1),
        "client_ip": _part(v, "client: ([^, ]{0,45})", 1),
        "server": "''",
        "request": "''",
    }


_PARSES = {"apache": f"regexp_matches(value, {_q(parse.APACHE)})", "json": "value IS NOT NULL", "syslog": "value IS NOT NULL", "nginx": "contains(value, ']')"}


_LENIENT_PARSES = {"apache": f"regexp_matches(value, {_q(parse.APACHE_LENIENT)})", "json": "json_valid(value)"}


def _format(lenient: bool) -> str:
    priority = "WHEN regexp_matches(value, '^<[0-9]+>') THEN 'SYSLOG'" if lenient else ""
    return f"""CASE WHEN value IS NULL OR value = '' THEN 'UNKNOWN' WHEN value[1] = '{{' THEN 'JSON'
      WHEN strlen(value) > 20 AND regexp_matches(value, '^[0-9]{{4}}/') THEN 'NGINX_ERROR' WHEN strlen(value) > 15 AND regexp_matches(value, '^[A-Za-z]{{3}} [0-9 ]') THEN 'SYSLOG' {priority}
      WHEN regexp_matches(value, '^[0-9]*\\.[0-9]*\\.[0-9]*\\.[0-9]* ') THEN 'APACHE' WHEN {_PARSES['apache']} THEN 'APACHE' ELSE '{"UNKNOWN" if lenient else "JSON"}' END"""


_FORMAT = _format(False)

# --- SQL of the rules: types and severity, over the fields' names with a prefix -------------


def _bits(*rules: tuple[str, int]) -> str:
    return " | ".join(f"(CASE WHEN {when} THEN {bits} ELSE 0 END)" for when, bits in rules)


def _types(kind: str, p: str = "") -> str:
    if kind == "apache":
        return _bits(
            (f"{p}status IN (401, 403) OR {_any(p + 'url', classify.SQL_INJECTION)} OR {_any(p + 'url', classify.SCRIPT)} OR contains({p}url, '../') OR contains({p}url, '..\\') OR {_any(p + 'user_agent', classify.SCANNERS)}", 1),
            (f"{p}size > 10485760", 2),
            (f"{p}status BETWEEN 500 AND 599", 10),
            ("true", 4),
        )
    if kind == "json":
        m, s = p + "message", p + "service"
        return _bits(
            (f"{_any(m, classify.JSON_DENIED)} OR {_any(s, classify.JSON_SECURITY_SERVICES)}", 1),
            (f"{_any(m, classify.JSON_SLOW)} OR ({_any(m, ['took'])} AND {_any(m, ['ms'])}) OR {_any(s, classify.JSON_STORES)}", 2),
            (_any(s, classify.JSON_GATEWAYS), 4),
            (_any(m, classify.JSON_LIMITS), 5),
            (f"{p}level >= 3", 8),
        )
    if kind == "syslog":
        m, s = p + "message", p + "service"
        return _bits(
            (f"{p}is_auth_failure OR {p}is_sudo_attempt OR {p}is_firewall_block OR regexp_matches({s}, '(?i)^(sshd|sudo|pam)$') OR {_any(s, ['firewall', 'iptables'])} OR {_any(m, classify.LOGIN_FAILED)}", 1),
            (f"{_any(m, classify.KERNEL)} OR {_any(m, classify.CRASH)}", 10),
            (f"{_any(s, classify.WEB_SERVERS)} OR {_any(m, classify.CONNECTIONS)}", 4),
        )
    m = p + "message"
    return _bits((f"{_any(m, classify.NGINX_DENIED)} OR {_any(m, classify.NGINX_TLS)}", 1), (f"{_any(m, classify.NGINX_UPSTREAM)} OR {_any(m, ['limiting requests', 'too large'])}", 2), ("true", 4))


def _severity(kind: str, p: str = "") -> str:
    """The last rule that holds, so the first in reverse order."""
    m, s = p + "message", p + "service"
    if kind == "apache":
        u = p + "url"
        return f"CASE WHEN {p}status = 404 THEN 1 WHEN {p}status = 503 THEN 4 WHEN {p}status BETWEEN 500 AND 599 THEN 3 WHEN {p}size > 10485760 THEN 2 WHEN contains({u}, '../') OR contains({u}, '..\\') OR {_any(u, classify.SCRIPT)} OR {_any(p + 'user_agent', classify.SCANNERS)} THEN 3 WHEN {_any(u, classify.SQL_INJECTION)} THEN 4 WHEN {p}status IN (401, 403) THEN 2 ELSE 0 END"
    if kind == "json":
        return f"CASE WHEN {_any(m, classify.JSON_DENIED)} THEN 3 ELSE {p}level END"
    if kind == "syslog":
        base = f"CASE {p}priority & 7 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 7 THEN 0 ELSE 1 END"
        return f"CASE WHEN {_any(m, classify.CRASH + classify.KERNEL + classify.LOGIN_FAILED)} THEN 4 WHEN {p}is_firewall_block THEN 2 WHEN {p}is_sudo_attempt AND {_any(m, classify.SUDO_FAILED)} THEN 4 WHEN {p}is_auth_failure THEN 3 ELSE {base} END"
    return f"CASE WHEN {_any(m, ['limiting requests'])} THEN 2 WHEN {_any(m, classify.NGINX_UPSTREAM)} THEN 3 WHEN {_any(m, classify.NGINX_DENIED)} THEN 2 WHEN {p}level >= 6 THEN 4 WHEN {p}level >= 4 THEN 3 WHEN {p}level = 3 THEN 2 WHEN {p}level >= 1 THEN 1 ELSE 0 END"


def _severity_name(column: str) -> str:
    return f"CASE {column} WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END"


def _description(kind: str) -> str:
    """Descriptions: in reverse order, as later rules write over earlier ones."""
    if kind == "apache":
        return f"""CASE WHEN status = 503 THEN 'Service unavailable: possible overload' WHEN status BETWEEN 500 AND 599 THEN concat('Server error ', status, ': ', substr(url, 1, 230))
          WHEN size > 10485760 THEN concat('Large response: ', size, ' bytes for ', substr(url, 1, 180)) WHEN contains(url, '../') OR contains(url, '..\\') THEN concat('Path traversal: ', substr(url, 1, 228))
          WHEN {_any('url', classify.SCRIPT)} THEN concat('XSS attempt: ', substr(url, 1, 230)) WHEN {_any('url', classify.SQL_INJECTION)} THEN concat('SQL Injection attempt: ', substr(url, 1, 220))
          WHEN status IN (401, 403) THEN concat('Unauthorized access: ', substr(url, 1, 100), ' from ', substr(ip, 1, 40)) WHEN status = 404 THEN concat('Not found: ', substr(url, 1, 240))
          ELSE concat(substr(method, 1, 15), ' ', substr(url, 1, 220), ' - Status ', status) END"""
    if kind == "json":
        return f"concat('[', substr(service, 1, 60), '] ', {_severity_name('level')}, ': ', substr(message, 1, 160))"
    if kind == "syslog":
        return "CASE WHEN is_auth_failure THEN concat('Auth failure: ', substr(message, 1, 228)) ELSE concat(substr(service, 1, 60), '[', pid, ']: ', substr(message, 1, 180)) END"
    return f"concat('Nginx [', {_severity_name('(' + _severity('nginx') + ')')}, ']: ', substr(message, 1, 180), ' (', substr(client_ip, 1, 40), ')')"


def _kind_sql(kind: str) -> str:
    """CTEs: lines of one kind, and `parsed` with their fields."""
    fields = ", ".join(f"{sql} AS {name}" for name, sql in _fields(kind).items())
    return f"WITH lines AS (SELECT event_id, {synthetic.line_sql(kind, synthetic.DUCKDB_DATES)} AS value FROM events), parsed AS (SELECT event_id, value, {fields} FROM lines WHERE {_PARSES[kind]})"


def _all_sql(mode: str = "full", lenient: bool = False, lines: str | None = None) -> str:
    """CTEs up to `entries`, the normalised entries of all lines (or of a query's) in a mode."""
    lines = lines or synthetic.lines_sql()
    names = {"apache": "APACHE", "json": "JSON", "syslog": "SYSLOG", "nginx": "NGINX_ERROR"}
    parts = []
    for kind, form in names.items():
        fields = ", ".join(f"{sql} AS {name}" for name, sql in _fields(kind, lenient=lenient).items() if name != "ts")
        parses = _LENIENT_PARSES.get(kind, _PARSES[kind]) if lenient else _PARSES[kind]
        level = "CASE severity WHEN 0 THEN 'INFO' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END"
        octet = X._OCTET
        quad = r"\.".join([octet] * 4) + "(?:[^0-9]|$)"
        cut = lambda c: c if lenient else f"substr({c}, 1, 15)"
        ip = {"apache": cut("ip"), "json": cut("ip"), "nginx": cut("client_ip"), "syslog": f"CASE WHEN regexp_matches(message, {_q(quad)}) THEN concat_ws('.', {', '.join(_part('message', quad, k) for k in (1, 2, 3, 4))}) ELSE '' END"}[kind]
        if kind == "json":
            level = "CASE level WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END"
        text = "url" if kind == "apache" else "message"
        status = "status" if kind == "apache" else "0"
        inner = f"SELECT source, pos, format, {fields} FROM formatted WHERE format = '{form}' AND {parses}"
        outer = f"SELECT *, CAST({_types(kind)} AS INTEGER) AS types, CAST({_severity(kind)} AS INTEGER) AS severity FROM ({inner})"
        parts.append(f"SELECT source, pos, format, types, {level} AS level, CAST({status} AS INTEGER) AS http_status, {ip} AS ip, substr({text}, 1, 255) AS message FROM ({outer})")
    bits = X.MODES[mode]
    keep = "true" if mode == "full" else f"types & {bits} <> 0"
    if lenient:
        return f"""WITH lines AS ({lines}), short AS (SELECT source, pos, substr(value, 1, 511) AS value FROM lines WHERE value <> ''),
          formatted AS (SELECT source, pos, {_format(True)} AS format, value FROM short),
          entries AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {keep})"""
    return f"""WITH lines AS ({lines}),
      first AS (SELECT source, arg_min(value, pos) AS value FROM lines WHERE value <> '' GROUP BY source), formats AS (SELECT source, {_FORMAT} AS format FROM first),
      formatted AS (SELECT source, pos, format, substr(value, 1, 511) AS value FROM lines JOIN formats USING (source) WHERE value <> ''),
      entries AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {keep})"""


_COUNT = "count(*) AS total_lines, " + ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS count_{x.lower()}" for x in metrics.LEVELS) + ", count(*) FILTER (WHERE http_status BETWEEN 400 AND 499) AS count_4xx, count(*) FILTER (WHERE http_status >= 500) AS count_5xx"

# --- queries ------------------------------------------------------------------------------


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, made once: the formats and the entries each read them."""
    path = scratch_folder(spark)
    synthetic.all_lines(spark, sf_dir).write.parquet(path)
    return clean_lines(spark.read.parquet(path))


def _entries(spark: SparkSession, sf_dir: str, mode: str = "full", **options) -> DataFrame:
    return entries.entries(_clean(spark, sf_dir), mode, year=YEAR, **options)


@_query("detect_format", f"WITH lines AS ({synthetic.lines_sql()}) SELECT source, pos, {_FORMAT} AS format FROM lines")
def detect_format(spark, sf_dir):
    return synthetic.all_lines(spark, sf_dir).select("source", "pos", detect.format_of(F.col("value")).alias("format"))


@_query("sticky_format", f"WITH lines AS ({synthetic.lines_sql()}), first AS (SELECT source, arg_min(value, pos) AS value FROM lines GROUP BY source) SELECT source, {_FORMAT} AS format FROM first")
def sticky_format(spark, sf_dir):
    return detect.source_formats(synthetic.all_lines(spark, sf_dir))


@_query("line_clean", f"WITH lines AS ({synthetic.lines_sql()}), long AS (SELECT pos, CASE WHEN pos % 13 = 0 THEN '' ELSE repeat(value, 1 + pos % 6) END AS value FROM lines) SELECT pos, substr(value, 1, 511) AS value FROM long WHERE value <> ''")
def line_clean(spark, sf_dir):
    lines = synthetic.all_lines(spark, sf_dir)
    return clean_lines(lines.select("pos", F.when(F.col("pos") % 13 == 0, "").otherwise(F.expr("repeat(value, cast(1 + pos % 6 AS int))")).alias("value")))


_GRAMMARS = {"apache": parse.apache, "json": parse.json, "syslog": lambda v: parse.syslog(v, YEAR), "nginx": parse.nginx}


def _parsed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return synthetic.kind_lines(spark, sf_dir, kind).select("event_id", _GRAMMARS[kind](F.col("value")).alias("e")).where("e IS NOT NULL")


for _kind in synthetic.KINDS:
    _names = [n for n in _fields(_kind) if n != "ts"]

    @_query(f"parse_{_kind}", f"{_kind_sql(_kind)} SELECT event_id, {', '.join(_names)}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM parsed")
    def _parse(spark, sf_dir, kind=_kind, names=tuple(_names)):
        return _parsed(spark, sf_dir, kind).select("event_id", *(f"e.{n}" for n in names), F.date_format("e.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))

    @_query(f"classify_{_kind}", f"{_kind_sql(_kind)} SELECT event_id, CAST({_types(_kind)} AS INTEGER) AS event_types, CAST({_severity(_kind)} AS INTEGER) AS severity FROM parsed")
    def _classify(spark, sf_dir, kind=_kind):
        made = getattr(classify, kind)(F.col("e"))
        return _parsed(spark, sf_dir, kind).select("event_id", made.event_types.alias("event_types"), made.severity.alias("severity"))

    @_query(f"describe_{_kind}", f"{_kind_sql(_kind)} SELECT event_id, substr({_description(_kind)}, 1, 255) AS description FROM parsed")
    def _describe(spark, sf_dir, kind=_kind):
        return _parsed(spark, sf_dir, kind).select("event_id", getattr(classify, kind)(F.col("e")).description.alias("description"))


_LAST = ", ".join(f"arg_max(v ->> '$', id) FILTER (WHERE key = '{k}') AS {k}" for k in ("timestamp", "level", "service", "message", "metadata"))
_INNER = lambda key: f"coalesce(CASE WHEN json_valid(metadata) THEN metadata ->> '$.{key}' END, '')"


@_query(
    "parse_json_lenient",
    f"""WITH lines AS (SELECT event_id, {synthetic.odd_json_sql(synthetic.DUCKDB_DATES)} AS value FROM events), good AS (SELECT * FROM lines WHERE json_valid(value)),
      pairs AS (SELECT event_id, e.key AS key, e.id AS id, e.value AS v FROM good, json_each(good.value) AS e), last AS (SELECT event_id, {_LAST} FROM pairs GROUP BY event_id)
      SELECT event_id, {_cases("upper(level)", _JSON_WORDS)} AS level, substr(coalesce(service, ''), 1, 63) AS service, coalesce(message, '') AS message, substr({_INNER("ip")}, 1, 45) AS ip, {_int(_part(_INNER("user_id"), "^[ ]*([0-9]*)", 1))} AS user_id, strftime({_stamp("timestamp", 19, "%Y-%m-%dT%H:%M:%S")}, '%Y-%m-%d %H:%M:%S') AS ts FROM last""",
)
def parse_json_lenient(spark, sf_dir):
    made = synthetic.odd_json_lines(spark, sf_dir).select("event_id", parse.json_lenient(F.col("value")).alias("e")).where("e IS NOT NULL")
    return made.select("event_id", *(f"e.{n}" for n in ("level", "service", "message", "ip", "user_id")), F.date_format("e.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _times_sql(dates: dict[str, str]) -> str:
    """Times of all grammars, and texts that are none, by event_id."""
    texts = [f"concat({dates['apache']}, ' +0000')", f"concat({dates['iso']}, 'Z')", dates["syslog"], dates["nginx"], f"concat('31/Feb', substr({dates['apache']}, 7))", "'junk'", f"lower({dates['apache']})"]
    return "(CASE event_id % 7" + "".join(f" WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END)"


@_query(
    "parse_timestamps",
    f"WITH t AS (SELECT event_id, {_times_sql(synthetic.DUCKDB_DATES)} AS text FROM events) SELECT event_id, text, " + ", ".join(f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {n}" for n, x in {"apache": "CASE WHEN regexp_matches(text, '^[0-9]{2}/[A-Z]') THEN " + _stamp("text", 20, "%d/%b/%Y:%H:%M:%S") + " END", "iso": _stamp("text", 19, "%Y-%m-%dT%H:%M:%S"), "syslog": f"try_strptime(concat('{YEAR} ', text), '%Y %b %d %H:%M:%S')", "nginx": _stamp("text", 19, "%Y/%m/%d %H:%M:%S")}.items()) + " FROM t",
)
def parse_timestamps(spark, sf_dir):
    t = F.col("text")
    made = {"apache": X.apache_time(t), "iso": X.iso_time(t), "syslog": X.syslog_time(t, YEAR), "nginx": X.nginx_time(t)}
    texts = synthetic.events(spark, sf_dir).select("event_id", F.expr(_times_sql(synthetic.SPARK_DATES)).alias("text"))
    return texts.select("event_id", "text", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in made.items()))


_QUAD = X.IPV4


@_query("extract_ipv4", f"{_kind_sql('syslog')} SELECT event_id, CASE WHEN regexp_matches(message, {_q(_QUAD)}) THEN concat_ws('.', {', '.join(_part('message', _QUAD, k) for k in (1, 2, 3, 4))}) ELSE '' END AS ip FROM parsed")
def extract_ipv4(spark, sf_dir):
    return _parsed(spark, sf_dir, "syslog").select("event_id", X.ipv4(F.col("e.message")).alias("ip"))


for _mode in X.MODES:

    @_query(f"mode_{_mode}", f"{_all_sql(_mode)} SELECT source, pos, format, level, http_status, ip, message FROM entries")
    def _in_mode(spark, sf_dir, mode=_mode):
        return _entries(spark, sf_dir, mode, keep=("source", "pos"))

    @_query(f"metrics_summary_{_mode}", f"{_all_sql(_mode)} SELECT {_COUNT}, count(*) FILTER (WHERE http_status >= 400) AS count_4xx_5xx FROM entries")
    def _summary(spark, sf_dir, mode=_mode):
        return metrics.errors_4xx_5xx(metrics.summary(_entries(spark, sf_dir, mode)))


_IPS = "ips AS (SELECT ip, count(*) AS hits FROM entries WHERE ip <> '' GROUP BY ip)"


@_query("ip_counts", f"{_all_sql()}, {_IPS} SELECT ip, hits FROM ips")
def ip_counts(spark, sf_dir):
    return metrics.ip_counts(_entries(spark, sf_dir))


@_query("top_ip", f"{_all_sql()}, {_IPS} SELECT coalesce((SELECT ip FROM ips ORDER BY hits DESC, ip LIMIT 1), '-') AS top_ip")
def top_ip(spark, sf_dir):
    return metrics.top_ip(_entries(spark, sf_dir))


@_query("top_ips_10", f"{_all_sql()}, {_IPS} SELECT ip, hits FROM ips ORDER BY hits DESC, ip LIMIT 10")
def top_ips_10(spark, sf_dir):
    return metrics.top_ips(_entries(spark, sf_dir), 10)


@_query("summary_and_ips", f"{_all_sql()} SELECT ip, {_COUNT}, CASE WHEN ip IS NOT NULL THEN count(*) ELSE 0 END AS hits FROM entries GROUP BY GROUPING SETS ((), (ip)) HAVING ip IS NULL OR ip <> ''")
def summary_and_ips(spark, sf_dir):
    return metrics.summary_and_ips(_entries(spark, sf_dir))


@_query("partial_merge", f"{_all_sql()} SELECT {_COUNT} FROM entries")
def partial_merge(spark, sf_dir):
    return metrics.merged(metrics.partial_summary(_entries(spark, sf_dir), "source"))


@_query("source_summary", f"{_all_sql()} SELECT source, {_COUNT} FROM entries GROUP BY source")
def source_summary(spark, sf_dir):
    return metrics.partial_summary(_entries(spark, sf_dir), "source")


@_query("progress", f"{_all_sql()}, done AS (SELECT source, count(*) AS done, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors FROM entries GROUP BY source), both_ AS (SELECT source, coalesce(done, 0) AS done, total, coalesce(errors, 0) AS errors FROM (SELECT source, count(*) AS total FROM lines GROUP BY source) LEFT JOIN done USING (source)), every AS (SELECT * FROM both_ UNION ALL SELECT NULL, sum(done), sum(total), sum(errors) FROM both_) SELECT source, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total, CAST(errors AS BIGINT) AS errors, CAST(least(100, done * 100 // total) AS INTEGER) AS percent FROM every")
def progress(spark, sf_dir):
    found = _entries(spark, sf_dir)
    done = found.groupBy("source").agg(F.count("*").alias("done"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"))
    return metrics.progress(done, synthetic.all_lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total")))


@_query("level_mapping", "SELECT event_id, CAST(event_id % 10 - 2 AS INTEGER) AS n, CASE event_id % 10 - 2 WHEN 0 THEN 'INFO' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS from_severity, CASE event_id % 10 - 2 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARN' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS from_json_level FROM events")
def level_mapping(spark, sf_dir):
    n = F.col("n")
    return synthetic.events(spark, sf_dir).select("event_id", F.expr("cast(event_id % 10 - 2 AS int)").alias("n")).select("event_id", "n", X.level_from_severity(n).alias("from_severity"), X.level_from_json_level(n).alias("from_json_level"))


@_query("severity_name", f"{_kind_sql('nginx')} SELECT event_id, {_severity_name('(' + _severity('nginx') + ')')} AS name FROM parsed")
def severity_name(spark, sf_dir):
    return _parsed(spark, sf_dir, "nginx").select("event_id", X.severity_name(classify.nginx(F.col("e")).severity).alias("name"))


_NAMED = "trim(concat(CASE WHEN types & 1 <> 0 THEN 'SECURITY ' ELSE '' END, CASE WHEN types & 2 <> 0 THEN 'PERFORMANCE ' ELSE '' END, CASE WHEN types & 4 <> 0 THEN 'TRAFFIC ' ELSE '' END, CASE WHEN types & 8 <> 0 THEN 'ERROR ' ELSE '' END, CASE WHEN types & 16 <> 0 THEN 'NORMAL ' ELSE '' END))"


@_query("event_type_name", f"{_kind_sql('syslog')}, typed AS (SELECT event_id, CAST({_types('syslog')} AS INTEGER) | CASE WHEN event_id % 3 = 0 THEN 16 ELSE 0 END AS types FROM parsed) SELECT event_id, CAST(types AS INTEGER) AS types, {_NAMED} AS name FROM typed")
def event_type_name(spark, sf_dir):
    """Names of the types of syslog lines, with NORMAL for every third one, which no rule gives."""
    types = classify.syslog(F.col("e")).event_types.bitwiseOR(F.when(F.col("event_id") % 3 == 0, X.NORMAL).otherwise(0))
    return _parsed(spark, sf_dir, "syslog").select("event_id", types.cast("int").alias("types")).select("event_id", "types", X.event_type_name(F.col("types")).alias("name"))


_WORDS = ["debug", "Info", "NOTICE", "warn", "Warning", "error", "ERR", "crit", "critical", "alert", "Emerg", "fatal", "", "criticalcriticalcritical", "warn "]
_WORD_SQL = f"(CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN upper({synthetic._pick('user_id', _WORDS)}) ELSE {synthetic._pick('user_id', _WORDS)} END)"


@_query("level_from_string", f"SELECT event_id, word, CASE upper(substr(word, 1, 15)) WHEN 'DEBUG' THEN 'DEBUG' WHEN 'INFO' THEN 'INFO' WHEN 'NOTICE' THEN 'INFO' WHEN 'WARN' THEN 'WARN' WHEN 'WARNING' THEN 'WARN' WHEN 'ERROR' THEN 'ERROR' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL' WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'ALERT' THEN 'CRITICAL' WHEN 'EMERG' THEN 'CRITICAL' ELSE 'UNKNOWN' END AS level FROM (SELECT event_id, {_WORD_SQL} AS word FROM events)")
def level_from_string(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_WORD_SQL).alias("word"))
    return words.select("event_id", "word", X.level_from_string(F.col("word")).alias("level"))


def _report_sql(layout: str, mode: str = "full") -> str:
    """(section, label, value), from literal labels."""
    parts = [f"SELECT '' AS section, '{report.TOTAL}' AS label, CAST(total_lines AS VARCHAR) AS value FROM m"]
    label = {"count_debug": "DEBUG", "count_info": "INFO", "count_warn": "WARNINGS", "count_error": "ERRORS", "count_critical": "CRITICAL", "count_4xx": "4xx" if layout == "pipes" else "HTTP 4xx", "count_5xx": "5xx" if layout == "pipes" else "HTTP 5xx", "count_4xx_5xx": "HTTP 4xx/5xx"}
    for section, counters in report.SECTIONS[layout]:
        parts += [f"SELECT '{section}', '{label[c]}', CAST({'count_4xx + count_5xx' if c == 'count_4xx_5xx' else c} AS VARCHAR) FROM m" for c in counters if c != "top_ip"]
    if layout == "sockets":
        parts.append(f"SELECT '{report.TRAFFIC}', '{report.TOP_IP}', (SELECT ip FROM ips ORDER BY hits DESC, ip LIMIT 1)")
    if layout == "prodcons":
        parts.append(f"SELECT '{report.IPS}', ip, CAST(hits AS VARCHAR) FROM (SELECT ip, hits FROM ips ORDER BY hits DESC, ip LIMIT 10)")
    return f"{_all_sql(mode)}, {_IPS}, m AS (SELECT {_COUNT} FROM entries) {' UNION ALL '.join(parts)}"


for _layout in report.TITLES:

    @_query(f"report_{_layout}", _report_sql(_layout))
    def _report(spark, sf_dir, layout=_layout):
        return report.frame(layout, "full", *metrics.of_report(metrics.report_rows(_entries(spark, sf_dir))))


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_folder(spark)
    synthetic.write_logs(synthetic.all_lines(spark, sf_dir), path)
    return path


@_query("file_metrics", f"{_all_sql()} SELECT {_COUNT} FROM entries")
def file_metrics(spark, sf_dir):
    return metrics.summary(entries.entries(read_logs(spark, _log_folder(spark, sf_dir)), year=YEAR))


@_query("stream_metrics", f"{_all_sql()} SELECT {_COUNT} FROM entries")
def stream_metrics(spark, sf_dir):
    return logs.run(spark, _log_folder(spark, sf_dir), scratch_folder(spark), files_per_batch=4)


@_query("lenient_metrics", f"{_all_sql(lenient=True)} SELECT {_COUNT} FROM entries")
def lenient_metrics(spark, sf_dir):
    return metrics.summary(_entries(spark, sf_dir, lenient=True))


@_query("lenient_security", f"{_all_sql('security', lenient=True)} SELECT source, pos, format, level, http_status FROM entries")
def lenient_security(spark, sf_dir):
    return _entries(spark, sf_dir, "security", lenient=True, keep=("source", "pos")).drop("ip", "message")


@_query("line_counts", f"WITH lines AS ({synthetic.lines_sql()}) SELECT source, count(*) AS total FROM lines GROUP BY source")
def files_line_counts(spark, sf_dir):
    return line_counts(spark, _log_folder(spark, sf_dir)).withColumn("source", F.regexp_extract("source", "([^/]*)$", 1))


_MODE_SQL = synthetic._pick("(event_id + user_id)", ["Security", "PERFORMANCE", "traffic", "full", "everything"])


@_query("mode_words", f"{_kind_sql('syslog')}, typed AS (SELECT event_id, {_MODE_SQL} AS word, CAST({_types('syslog')} AS INTEGER) AS types FROM parsed JOIN events USING (event_id)), bits AS (SELECT *, CASE lower(word) WHEN 'security' THEN 1 WHEN 'performance' THEN 2 WHEN 'traffic' THEN 4 WHEN 'full' THEN 15 END AS bits FROM typed) SELECT event_id, word, CAST(coalesce(bits, 0) AS INTEGER) AS bits, bits IS NOT NULL AND (bits = 15 OR types & bits <> 0) AS kept FROM bits")
def mode_words(spark, sf_dir):
    """A mode's word for each event, and whether the event's syslog line is kept in it."""
    words = synthetic.events(spark, sf_dir)
    lines = words.select("event_id", F.expr(_MODE_SQL).alias("word"), F.explode(F.array(F.expr(synthetic.line_sql("syslog", synthetic.SPARK_DATES)))).alias("value"))
    types = classify.syslog(F.col("e")).event_types
    made = lines.select("event_id", "word", X.mode_bits_of(F.col("word")).alias("bits"), F.explode(F.array(parse.syslog(F.col("value"), YEAR))).alias("e"))
    return made.select("event_id", "word", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce((F.col("bits") == X.MODES["full"]) | (types.bitwiseAND(F.col("bits")) != 0), F.lit(False)).alias("kept"))


def _quarantine_sql(lenient: bool) -> str:
    reason = "WHEN e.pos IS NOT NULL THEN NULL WHEN l.value = '' THEN 'empty' WHEN f.format = 'UNKNOWN' THEN 'no known format' WHEN f.format = 'APACHE' THEN 'not an apache line' WHEN f.format = 'JSON' THEN 'broken json' ELSE 'no closing bracket'"
    form = f"SELECT source, pos, {_format(True)} AS format FROM lines" if lenient else "SELECT source, pos, format FROM lines JOIN formats USING (source)"
    return f"""{_all_sql(lenient=lenient, lines=synthetic.damaged_lines_sql())}, formed AS ({form})
      SELECT l.source, l.pos, CASE {reason} END AS reason, f.format, e.level, coalesce(e.http_status, -1) AS http_status, e.ip, e.message, CASE WHEN e.pos IS NULL THEN l.value END AS value
      FROM lines l JOIN formed f ON f.source = l.source AND f.pos = l.pos LEFT JOIN entries e ON e.source = l.source AND e.pos = l.pos"""


for _lenient in (False, True):

    @_query("quarantine_lenient" if _lenient else "quarantine", _quarantine_sql(_lenient))
    def _quarantine(spark, sf_dir, lenient=_lenient):
        """Both parts as they were written: every line once; http_status is -1 where the line is no entry."""
        made = quarantine.sort_out(synthetic.damaged_lines(spark, sf_dir), scratch_folder(spark), lenient=lenient, year=YEAR)
        both = made.entries.unionByName(made.rejected, allowMissingColumns=True)
        return both.withColumn("http_status", F.coalesce("http_status", F.lit(-1)))


@_query("live_progress", f"{_all_sql()}, done AS (SELECT source, count(*) AS entries, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors FROM entries GROUP BY source), both_ AS (SELECT source, lines, coalesce(entries, 0) AS entries, coalesce(errors, 0) AS errors FROM (SELECT source, count(*) AS lines FROM lines GROUP BY source) LEFT JOIN done USING (source)) SELECT source, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(errors) AS BIGINT) AS errors, CAST(100 AS INTEGER) AS percent FROM both_ GROUP BY GROUPING SETS ((source), ())")
def live_progress(spark, sf_dir):
    """What the progress of a watched run over the files shows at its end."""
    made = live.run(spark, _log_folder(spark, sf_dir), scratch_folder(spark), year=YEAR)
    return live.final(made).withColumn("source", F.regexp_extract("source", "([^/]*)$", 1))


@_query("event_epoch", f"{_kind_sql('nginx')} SELECT event_id, CAST(epoch(ts) AS BIGINT) AS utc, CAST(epoch(ts) AS BIGINT) - 19800 AS kolkata FROM parsed")
def event_epoch(spark, sf_dir):
    made = _parsed(spark, sf_dir, "nginx")
    return made.select("event_id", X.epoch(F.col("e.ts"), "UTC").alias("utc"), X.epoch(F.col("e.ts"), "Asia/Kolkata").alias("kolkata"))
