"""Synthetic log lines, made from the table `events` by SQL that Spark and DuckDB both take.

The same seedless arithmetic on event_id gives every grammar and every rule
lines; the texts differ from engine to engine only in how a time is written.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How each engine writes event times.
SPARK_DATES = {"apache": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "syslog": "concat(date_format(ts, 'MMM'), ' ', cast(day(ts) AS string), ' ', date_format(ts, 'HH:mm:ss'))", "nginx": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')"}
DUCKDB_DATES = {"apache": "strftime(ts, '%d/%b/%Y:%H:%M:%S')", "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "syslog": "concat(strftime(ts, '%b'), ' ', cast(day(ts) AS string), ' ', strftime(ts, '%H:%M:%S'))", "nginx": "strftime(ts, '%Y/%m/%d %H:%M:%S')"}

_IP = "concat('10.', cast(user_id % 4 AS string), '.', cast(user_id % 8 AS string), '.', cast(user_id % 256 AS string))"


def _pick(number: str, values: list[str]) -> str:
    """The value at a number modulo how many there are."""
    cases = " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values))
    return f"(CASE {number} % {len(values)} {cases} END)"


def _quoted(text: str) -> str:
    """A SQL literal that both engines read alike: without a backslash or a quote in it."""
    if not text:
        return "''"
    parts = [p for c in text.replace("\\", "\x00").replace("'", "\x01").split("\x00") for p in ("\x00", c)][1:]
    out = []
    for p in parts:
        if p == "\x00":
            out.append("chr(92)")
            continue
        for k, q in enumerate(p.split("\x01")):
            out += (["chr(39)"] if k else []) + ([f"'{q}'"] if q else [])
    return f"concat({', '.join(out)})" if len(out) != 1 or out[0].startswith("chr") else out[0]


#: Own sentences: for each rule some with its words, in several cases, and some that no rule knows.
APACHE_PATHS = ["/", "/start.html", "/shop/basket", "/../secret.txt", "/find?n=1=1", "/find?n=<SCRIPT>", "/enter?who=admin'--", "/go?to=javascript:7", "/docs/..\\note.txt", "/pic?onerror=2", "/old-page", "/enter", "/b c UNION SELECT", "/video"]
JSON_SERVICES = ["auth-desk", "people", "database-north", "cache-2", "parcel-proxy", "firewall", "ticket Gateway", "calendar", "redis-07", "night-security", "printer"]
JSON_MESSAGES = ["the door was opened", "Access denied at gate 4", "counting took 31ms", "Out of memory on shelf 5", "Rate limit of guest 3 is used up", "no answer, Timeout", "Invalid credentials were shown", "nothing to tell", "caller throttled for now", "High latency on the way north", "UNAUTHORIZED visitor", "a slow query was cut", "permission denied by the guard", "all of the cpu is busy", "Connection pool exhausted again", "sorting took long", "authentication failed twice"]
SYSLOG_SERVICES = ["sshd", "sudo", "kernel", "clockd", "cron", "nginx", "apache2", "SSHD", "my firewall", "httpd", "pam"]
SYSLOG_MESSAGES = ["a key of {IP} fits", "Failed password at {IP}, third try", "the connection to {IP} is over", "helper : runs as root in /srv", "door(sudo): authentication failure of guest", "gate 2 says REJECT to {IP}", "DROP of all from 1{IP}", "the evening shift begins", "Out of memory, job 1 must go", "segmentation fault in cell 0", "the child died", "invalid user guest from 256.1.1.1", "Kernel panic in the lab", "the room is full", "incorrect password for the safe", "from 010.001.002.003 and 1.2.3.1234", "core dumped to disk 3", "the scale crashed"]
NGINX_MESSAGES = ["no path (Connection refused) to the store", "the upstream timed out at noon", "line cut (Connection reset by the far side)", "no live upstreams are left", "SSL greeting went wrong", "limiting requests of guest 15", "a body too large for the door: 9 bytes", "the header of the store is too big", "listing this folder is forbidden", "no such page was found", "access forbidden to guests", "this verb is not allowed", "the certificate is torn"]
NGINX_LEVELS = ["error", "warn", "crit", "notice", "info", "emerg", "alert", "debug", "other"]


def _with_ip(messages: list[str], number: str) -> str:
    return f"replace({_pick(number, messages)}, '{{IP}}', {_IP})"


def line_sql(kind: str, dates: dict[str, str]) -> str:
    """SQL expression over events for a line of a kind."""
    if kind == "apache":
        client = f"(CASE WHEN event_id % 29 = 0 THEN '2001:db8::12:34:56:78' WHEN event_id % 31 = 0 THEN 'host.example' ELSE {_IP} END)"
        user = "(CASE WHEN event_id % 37 = 0 THEN 'frank' ELSE '-' END)"
        method = _pick("event_id", ["GET", "POST", "GET", "PUT", "DELETE", "GET", "HEAD"])
        path = f"concat({_pick('event_id', APACHE_PATHS)}, CASE WHEN event_id % 43 = 0 THEN '?' ELSE '' END)"
        status = _pick("(event_id * 7 + user_id)", ["200", "404", "500", "503", "401", "403", "200", "302", "600", "200", "499", "200"])
        size = "(CASE WHEN event_id % 41 = 0 THEN '-' ELSE cast(event_id % 97 * 150000 AS string) END)"
        return f"""concat({client}, ' - ', {user}, ' [', {dates['apache']}, ' +0000] "', {method}, ' ', {path}, ' HTTP/1.1" ', {status}, ' ', {size}, ' "-" "', CASE WHEN event_id % 47 = 0 THEN 'sqlmap/1.0' ELSE 'Mozilla/5.0' END, '"')"""
    if kind == "json":
        level = _pick("event_id", ["INFO", "WARN", "ERROR", "CRITICAL", "DEBUG", "FATAL", "WARNING", "error", "NONE"])
        space = "(CASE WHEN event_id % 53 = 0 THEN ' ' ELSE '' END)"
        return f"""concat('{{"timestamp":"', {dates['iso']}, 'Z","level"', {space}, ':"', {level}, '","service":"', {_pick('event_id', JSON_SERVICES)}, '","message":"', {_pick('(event_id + user_id)', JSON_MESSAGES)}, '","metadata":{{"ip":"', {_IP}, '","user_id":', CASE WHEN event_id % 59 = 0 THEN '"x"' ELSE cast(user_id AS string) END, '}}}}')"""
    if kind == "syslog":
        return f"""concat(CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('<', cast(event_id % 48 AS string), '>') END, {dates['syslog']}, ' host', cast(event_id % 7 AS string), ' ', {_pick('event_id', SYSLOG_SERVICES)}, CASE WHEN event_id % 5 = 0 THEN ': ' ELSE concat('[', cast(event_id % 30000 AS string), ']: ') END, {_with_ip(SYSLOG_MESSAGES, '(event_id + user_id)')})"""
    if kind == "nginx":
        rest = f"""CASE WHEN event_id % 61 = 0 THEN '' ELSE concat(', client: ', {_IP}, ', server: example.com, request: "GET / HTTP/1.1"') END"""
        return f"""concat({dates['nginx']}, CASE WHEN event_id % 67 = 0 THEN ' [error ' ELSE concat(' [', {_pick('event_id', NGINX_LEVELS)}, '] ') END, cast(event_id % 30000 AS string), '#', cast(event_id % 9 AS string), ': *', cast(event_id AS string), ' ', {_pick('(event_id + user_id)', NGINX_MESSAGES)}, {rest})"""
    raise ValueError(kind)


KINDS = ["apache", "json", "syslog", "nginx"]


def odd_json_sql(dates: dict[str, str]) -> str:
    """SQL expression over events for a JSON line that a search for keys misreads, or that is no JSON (cases 5 and 9)."""
    slash = _quoted("\\")
    time = f"""concat('"timestamp":"', {dates['iso']}, 'Z"')"""
    level = f"""concat('"level":"', {_pick('(event_id + user_id)', ['Info', 'warn', 'ERROR', 'Fatal', 'debug', 'Warning', 'other'])}, '"')"""
    service = f"""concat('"service":"', {_pick('event_id', JSON_SERVICES)}, '"')"""
    text = _pick("(event_id * 3 + user_id)", JSON_MESSAGES)
    message = f"""concat('"message":"', {text}, '"')"""
    escaped = f"""concat('"message":"', {slash}, '"', {text}, {slash}, '" ', {slash}, 'u00e9', {slash}, 'n{{', {slash}, '"level', {slash}, '":1}}"')"""
    inner = f"""concat('"metadata":{{"level":"CRITICAL","message":"inner","ip":"', {_IP}, '","user_id":', cast(user_id AS string), '}}')"""
    blank = "concat(chr(32), chr(9))"
    cases = [
        ["'{'", time, "','", level, "','", service, "','", message, "','", inner, "'}'"],
        ["'{'", inner, "','", message, "','", level, "','", time, "','", service, "'}'"],
        ["'{'", time, "','", level, "','", service, "','", escaped, "','", inner, "'}'"],
        ["""'{"level":"CRITICAL","message":"first",'""", inner, "','", inner.replace('"ip":"', '"ip":"9'), "','", level, "','", message, "'}'"],
        ["'{'", blank, time, blank, "','", blank, level, "','", blank, message, "'}'", blank],
        ["'{'", time, "','", level, "','", service, "','", inner],
        ["""'{"level":null,"service":7,'""", message, "','", inner, "'}'"],
        ["'{'", level, "','", message, "','", time, """',"metadata":"none"}'"""],
        ["""'{"level":3,"message":null,"metadata":{"ip":null,"user_id":"12 or so"},'""", service, "'}'"],
        ["'{'", level, message, "'}'"],
    ]
    return "(CASE event_id % 10" + "".join(f" WHEN {k} THEN concat({', '.join(parts)})" for k, parts in enumerate(cases)) + " END)"


def damaged_sql(value: str) -> str:
    """SQL expression for a line that may be cut, without a bracket, or with a comma too many, by event_id."""
    return f"(CASE WHEN event_id % 17 = 0 THEN substr({value}, 1, 10) WHEN event_id % 19 = 0 THEN replace({value}, ']', '') WHEN event_id % 23 = 0 THEN replace({value}, ',', ',,') WHEN event_id % 101 = 0 THEN '' ELSE {value} END)"


SOURCE_SQL = f"concat({_pick('event_id', [*KINDS, 'mixed'])}, '-', cast(event_id % 3 AS string), '.log')"


def value_sql(dates: dict[str, str], divide: str) -> str:
    """SQL expression for a line: of the source's kind, or in a mixed source of each kind in turn."""
    by_kind = lambda number: f"CASE {number}" + "".join(f" WHEN {k} THEN {line_sql(kind, dates)}" for k, kind in enumerate(KINDS)) + " END"
    return f"CASE WHEN event_id % 5 < 4 THEN {by_kind('event_id % 5')} ELSE {by_kind(f'event_id % 60 {divide} 5 % 4')} END"


def lines_sql() -> str:
    """DuckDB query over events: source, pos, value.  Three sources of each kind, and three that mix all kinds."""
    return f"SELECT {SOURCE_SQL} AS source, event_id AS pos, {value_sql(DUCKDB_DATES, '//')} AS value FROM events"


def damaged_lines_sql() -> str:
    """DuckDB query over events: the lines of lines_sql(), some of them damaged."""
    return f"SELECT source, pos, {damaged_sql('value')} AS value FROM (SELECT *, pos AS event_id FROM ({lines_sql()}))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines are made from, spread over all cores: the table is often one file."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").repartition(spark.sparkContext.defaultParallelism)


def generated(spark: SparkSession, n: int, seed: int = 0, begin: str = "2024-01-01 00:00:00", seconds: int = 1) -> DataFrame:
    """n events (event_id, user_id, ts) of their own for kind_lines_of() and all_lines_of(): the same for the same seed, at any number of tasks."""
    hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    ts = F.to_timestamp(F.lit(begin)) + F.make_dt_interval(secs=F.col("id") * seconds)
    return spark.range(n).select(hashed.alias("event_id"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(100_000)).alias("user_id"), ts.alias("ts"))


def _made(events: DataFrame, sql: str, *columns) -> DataFrame:
    """The line comes out of a generator, so that it is made once however often it is used."""
    return events.select(*columns, F.explode(F.array(F.expr(sql))).alias("value"))


def kind_lines_of(events: DataFrame, kind: str) -> DataFrame:
    """(event_id, value): a line of one kind for every event."""
    return _made(events, line_sql(kind, SPARK_DATES), "event_id")


def all_lines_of(events: DataFrame) -> DataFrame:
    """(source, pos, value) of all kinds."""
    return _made(events, value_sql(SPARK_DATES, "DIV"), F.expr(SOURCE_SQL).alias("source"), F.col("event_id").alias("pos"))


def weighted_lines_of(events: DataFrame, weights: dict[str, float], sources: int = 1) -> DataFrame:
    """(source, pos, value): lines of the kinds in proportion to their weights, each kind in so many sources."""
    bad = set(weights) - set(KINDS)
    total = sum(weights.values())
    if bad or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights are of apache, json, syslog and nginx, none below zero")
    # a hash of the event's number, as a share of all hashes, tells the kind
    share, low, case = F.pmod(F.xxhash64("event_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)), 0.0, None
    for kind, weight in weights.items():
        low += weight / total
        case = F.when(share < low, F.lit(kind)) if case is None else case.when(share < low, F.lit(kind))
    events = events.withColumn("kind", case.otherwise(F.lit([k for k, w in weights.items() if w][-1])))
    lines = "CASE kind" + "".join(f" WHEN '{kind}' THEN {line_sql(kind, SPARK_DATES)}" for kind in weights) + " END"
    return _made(events, lines, F.concat("kind", F.lit("-"), F.pmod(F.xxhash64("event_id", F.lit(2)), F.lit(sources)).cast("string"), F.lit(".log")).alias("source"), F.col("event_id").alias("pos"))


def kind_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return kind_lines_of(events(spark, sf_dir), kind)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_lines_of(events(spark, sf_dir))


def odd_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): a line of odd_json_sql() for every event."""
    return _made(events(spark, sf_dir), odd_json_sql(SPARK_DATES), "event_id")


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, pos, value): all_lines(), some of them damaged."""
    return all_lines(spark, sf_dir).withColumn("event_id", F.col("pos")).select("source", "pos", F.expr(damaged_sql("value")).alias("value"))


def write_logs(lines: DataFrame, path: str) -> None:
    """Generator: lines (source, pos, value) as one file for each source, named by it, in the order of pos."""
    spark = lines.sparkSession
    folder = f"{path}/_parts"
    lines.repartition("source").sortWithinPartitions("source", "pos").select("source", "value").write.mode("overwrite").partitionBy("source").text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for source in store.listStatus(at):
        if source.isDirectory():
            name = source.getPath().getName().removeprefix("source=")
            for part in store.listStatus(source.getPath()):
                store.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    store.delete(at, True)


def main(args: list[str] | None = None) -> int:
    """Command line: writes a directory of log files for tests of load."""
    p = argparse.ArgumentParser(prog="logmill.sources.synthetic", description="Writes synthetic log files")
    p.add_argument("directory")
    p.add_argument("lines", type=int)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--files", type=int, default=1, help="files of each kind")
    for kind in KINDS:
        p.add_argument(f"--{kind}", type=float, default=1.0, help="weight of these lines")
    a = p.parse_args(args)
    try:
        spark = SparkSession.builder.appName("logmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if a.lines < 0 or a.files < 1:
            raise ValueError("lines are 0 or more, files 1 or more")
        write_logs(weighted_lines_of(generated(spark, a.lines, a.seed), {k: getattr(a, k) for k in KINDS}, a.files), a.directory)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
