"""Parsing and classification against cases worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from logmill.functions import scalars as X
from logmill.operators import classify, detect, entries, parse

TIME = "[13/Feb/2024:10:23:45 +0000]"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "value string").select(column(F.col("value")).alias("x")).first()["x"]


def many(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, value string").select("k", column(F.col("value")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["k"])]


def test_detection(spark):
    cases = {
        None: "UNKNOWN", "": "UNKNOWN", "{x": "JSON", "2024/02/13 10:23:45 [error]": "NGINX_ERROR", "2024/02/13": "JSON", "Feb 13 10:23:45 host x": "SYSLOG", "Feb  3 10:23:45 host x": "SYSLOG", "Feb 13 short": "JSON",
        "1.2.3.4 anything": "APACHE", "1.2.3 x": "JSON", f'::1 - - {TIME} "GET / HTTP/1.1" 200 1': "APACHE", "<34>Feb 13 10:23:45 host sshd: x": "JSON", "ERROR: plain text": "JSON", "1.2.3.4": "JSON",
    }
    assert many(spark, list(cases), detect.format_of) == list(cases.values())
    lenient = many(spark, ["<34>Feb 13 10:23:45 host", "ERROR: plain", "{x"], lambda c: detect.format_of(c, True))
    assert lenient == ["SYSLOG", "UNKNOWN", "JSON"]


def test_apache_lines(spark):
    lines = [
        f'192.168.1.100 - - {TIME} "GET /api/users HTTP/1.1" 200 1234 "https://example.com" "Mozilla/5.0"',
        f'1.1.1.1 - frank {TIME} "GET / HTTP/1.1" 200 1',
        f'1.1.1.1 - - {TIME} "-" 408 0 "-" "ua"',
        f'1.1.1.1 - - {TIME} "GET /a UNION SELECT b HTTP/1.1" 404 -',
        "x" * 46 + f' - - {TIME} "GET / HTTP/1.1" 200 1',
        f'h - - {TIME} "GET /' + "u" * 600 + ' HTTP/1.1" 200 1',
        "no match",
        None,
    ]
    a, user, dash, union, long_ip, long_url, none, null = many(spark, lines, parse.apache)
    assert (a["ip"], a["ts"], a["method"], a["url"], a["http_version"], a["status"], a["size"], a["user_agent"]) == ("192.168.1.100", datetime.datetime(2024, 2, 13, 10, 23, 45), "GET", "/api/users", "1.1", 200, 1234, "")
    assert user is None and long_ip is None and none is None and null is None
    assert (dash["method"], dash["url"], dash["status"], dash["size"]) == ('-"', "408", 0, 0)
    assert (union["url"], union["status"], union["size"]) == ("/a", 404, 0)
    assert len(long_url["url"]) == 511
    got = many(spark, lines[:2], lambda c: parse.apache(c, lenient=True))
    assert got[0]["user_agent"] == "Mozilla/5.0" and got[0]["referer"] == "https://example.com"
    assert got[1]["ip"] == "1.1.1.1" and got[1]["status"] == 200


GOLDEN_APACHE = [("/", 200, 10, 4, 0), ("/admin", 403, 10, 5, 2), ("/x", 400, 10, 4, 0), ("/x", 404, 10, 4, 1), ("/x?q=1=1", 200, 10, 5, 4), ("/x?q=1=1", 404, 10, 5, 1), ("/x?q=<script>", 401, 10, 5, 3), ("/../etc", 200, 10, 5, 3), ("/big", 200, 10485760, 4, 0), ("/big", 200, 10485761, 6, 2), ("/x", 500, 10, 14, 3), ("/x", 503, 10, 14, 4), ("/../x", 503, 10, 15, 4), ("/x", 600, 10, 4, 0)]


def entry_of(spark, lines, **options):
    rows = [(f"s{k}", k, v) for k, v in enumerate(lines)]
    got = entries.entries(spark.createDataFrame(rows, "source string, pos long, value string"), keep=("pos",), **options).collect()
    return {r["pos"]: r for r in got}


def test_apache_rules(spark):
    lines = [f'1.1.1.1 - - {TIME} "GET {u} HTTP/1.1" {s} {n}' for u, s, n, _, _ in GOLDEN_APACHE]
    got = many(spark, lines, lambda c: classify.apache(parse.apache(c)).struct())
    assert [(g["event_types"], g["severity"]) for g in got] == [g[3:] for g in GOLDEN_APACHE]
    assert got[1]["description"] == "Unauthorized access: /admin from 1.1.1.1"
    assert got[3]["description"] == "Not found: /x"
    assert got[5]["description"] == "SQL Injection attempt: /x?q=1=1"
    assert got[11]["description"] == "Service unavailable: possible overload"
    assert got[0]["description"] == "GET / - Status 200"
    counted = entry_of(spark, lines)
    assert [counted[k]["level"] for k in range(len(lines))] == [X.SEVERITY_LEVELS[g[4]] for g in GOLDEN_APACHE]


GOLDEN_JSON = [("INFO", "auth-api", "User authentication successful", 5, 1, "INFO"), ("INFO", "user-service", "access denied", 1, 3, "INFO"), ("INFO", "user-service", "Database query took 12ms", 2, 1, "INFO"), ("CRITICAL", "cache-manager", "Out of memory allocating 5 bytes", 10, 4, "CRITICAL"), ("WARN", "load-balancer", "Rate limit exceeded for user 3", 5, 2, "WARN"), ("ERROR", "database-proxy", "Connection timeout after 3s", 14, 3, "ERROR"), ("error", "user-service", "x", 0, 0, "DEBUG"), ("FATAL", "user-service", "x", 8, 4, "CRITICAL")]


def test_json_rules(spark):
    lines = [f'{{"timestamp":"2024-02-13T10:23:45Z","level":"{v}","service":"{s}","message":"{m}","metadata":{{"ip":"10.1.2.3","user_id":77}}}}' for v, s, m, *_ in GOLDEN_JSON]
    got = many(spark, lines, lambda c: classify.json(parse.json(c)).struct())
    assert [(g["event_types"], g["severity"]) for g in got] == [g[3:5] for g in GOLDEN_JSON]
    counted = entry_of(spark, lines)
    assert [(counted[k]["level"], counted[k]["ip"], counted[k]["http_status"]) for k in range(len(lines))] == [(g[5], "10.1.2.3", 0) for g in GOLDEN_JSON]
    assert got[1]["description"] == "[user-service] LOW: access denied"


def test_json_by_search(spark):
    got = many(spark, ['{"level" : "ERROR"}', '{"ip":"9.9.9.9"}', "plain", '{"a":{"level":"WARN"},"level":"ERROR"}', r'{"message":"a\"b","level":  "FATAL"}', '{"metadata":{"user_id":"12x","ip":unquoted}}', '{"message":"open'], parse.json)
    assert [g["level"] for g in got] == [0, 0, 0, 2, 4, 0, 0]
    assert got[1]["ip"] == "" and got[4]["message"] == "a\\" and got[6]["message"] == ""
    assert (got[5]["user_id"], got[5]["ip"]) == (12, "unquoted")


GOLDEN_SYSLOG = [("<38>", "sshd", "Accepted publickey for x", 1, 1), ("<38>", "sshd", "Failed password for x", 1, 4), ("<38>", "sshd", "Connection closed by x", 5, 1), ("<44>", "sudo", "admin : TTY=x", 1, 2), ("<44>", "sudo", "x authentication failure x", 1, 4), ("<36>", "kernel", "iptables: REJECT", 1, 2), ("<46>", "systemd", "Started User Manager", 0, 1), ("<46>", "cron", "session opened", 0, 1), ("<38>", "nginx", "limiting requests", 4, 1), ("<38>", "apache2", "client denied", 4, 1), ("", "systemd", "Started x", 0, 4)]


def test_syslog_rules(spark):
    lines = [f"{p}Feb 13 10:23:45 web01 {s}[12]: {m}" for p, s, m, *_ in GOLDEN_SYSLOG]
    got = many(spark, lines, lambda c: classify.syslog(parse.syslog(c, 2024)).struct())
    assert [(g["event_types"], g["severity"]) for g in got] == [g[3:] for g in GOLDEN_SYSLOG]
    p = one(spark, lines[1], lambda c: parse.syslog(c, 2023))
    assert (p["priority"], p["ts"], p["hostname"], p["service"], p["pid"], p["message"], p["is_auth_failure"], p["is_sudo_attempt"]) == (38, datetime.datetime(2023, 2, 13, 10, 23, 45), "web01", "sshd", 12, "Failed password for x", True, False)
    odd = many(spark, ["Feb 13 10:23:45 h my svc: text: more", "Feb 13 10:23:45", "Feb 13 no colons in this line at all, none", "<7"], lambda c: parse.syslog(c, 2024))
    assert (odd[0]["service"], odd[0]["message"]) == ("my svc", "text: more")
    assert odd[1]["hostname"] == ""
    assert odd[3]["priority"] == 7


GOLDEN_NGINX = [("connect() failed (111: Connection refused)", "error", 6, 3), ("upstream timed out", "error", 6, 3), ("recv() failed (104: Connection reset by peer)", "error", 6, 3), ("no live upstreams", "crit", 6, 3), ("SSL_do_handshake() failed", "error", 5, 3), ("limiting requests", "warn", 6, 2), ("client intended to send too large body", "error", 6, 3), ("upstream sent too big header", "error", 4, 3), ("directory index is forbidden", "error", 4, 3), ("open() failed (2: No such file)", "error", 4, 3)]


def test_nginx_rules(spark):
    lines = [f'2024/02/13 10:23:45 [{v}] 77#5: *99 {m}, client: 10.0.0.9, server: example.com, request: "GET / HTTP/1.1"' for m, v, *_ in GOLDEN_NGINX]
    got = many(spark, lines, lambda c: classify.nginx(parse.nginx(c)).struct())
    assert [(g["event_types"], g["severity"]) for g in got] == [g[2:] for g in GOLDEN_NGINX]
    p = one(spark, lines[3], parse.nginx)
    assert (p["ts"], p["level"], p["pid"], p["tid"], p["connection_id"], p["message"], p["client_ip"]) == (datetime.datetime(2024, 2, 13, 10, 23, 45), 5, 77, 5, 99, "*99 no live upstreams", "10.0.0.9")
    assert got[3]["description"] == "Nginx [HIGH]: *99 no live upstreams (10.0.0.9)"
    assert one(spark, "2024/02/13 10:23:45 [error 77#5: x", parse.nginx) is None


def test_ipv4(spark):
    cases = {"from 1192.168.1.1": "192.168.1.1", "256.1.1.1": "56.1.1.1", "010.001.002.003": "10.1.2.3", "1.2.3.1234": "", "x": "", "a 1.2.3.4 b 5.6.7.8": "1.2.3.4", "1.2.3": ""}
    assert many(spark, list(cases), X.ipv4) == list(cases.values())


def test_modes(spark):
    assert [X.mode_bits(m) for m in ("Security", "PERFORMANCE", "traffic", "full")] == [1, 2, 4, 15]
    for bad in ("", "all", None):
        with pytest.raises(ValueError):
            X.mode_bits(bad)


def test_sticky_format(spark):
    json_line = '{"level":"ERROR","message":"x"}'
    apache_line = f'1.1.1.1 - - {TIME} "GET / HTTP/1.1" 200 1'
    rows = [("a", 1, apache_line), ("a", 2, json_line), ("b", 1, json_line), ("b", 2, apache_line)]
    lines = spark.createDataFrame(rows, "source string, pos long, value string")
    strict = sorted((r["source"], r["level"]) for r in entries.entries(lines).collect())
    assert strict == [("a", "INFO"), ("b", "DEBUG"), ("b", "ERROR")]
    assert entries.entries(lines, lenient=True).count() == 4


def test_bytes(spark):
    assert one(spark, "é" * 10, lambda c: F.octet_length(X.first_bytes(c, 7))) == 7
    long = "/" + "ü" * 300
    got = entry_of(spark, [f'1.1.1.1 - - {TIME} "GET {long} HTTP/1.1" 200 1', f'2001:db8::12:34:56:78 - - {TIME} "GET / HTTP/1.1" 200 1'])
    assert len(got[0]["message"].encode("utf-8", "surrogateescape")) <= 257
    assert got[1]["ip"] == "2001:db8::12:34"
    assert entry_of(spark, [f'2001:db8::12:34:56:78 - - {TIME} "GET / HTTP/1.1" 200 1'], lenient=True)[0]["ip"] == "2001:db8::12:34:56:78"
