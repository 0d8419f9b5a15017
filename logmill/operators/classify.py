"""Classification by rule tables: event types, severity and description of a parsed line.

A rule is a condition, the types that it adds, the severity that it sets (none:
it keeps the one so far) and a description.  Rules apply in order: types add up,
the last severity wins, and the first description stays unless a later rule
writes over it.  Both expressions are generated from the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.scalars import ERROR, PERFORMANCE, SECURITY, TRAFFIC
from .parse import MESSAGE_BYTES

DESCRIPTION_BYTES = MESSAGE_BYTES
#: Bytes from which a response counts as large.
LARGE = 10_485_760

# Texts that the rules look for.  The first table's are URLs, the others' messages or services.
SQL_INJECTION = ["' OR '", "UNION SELECT", "DROP TABLE", "1=1", "admin'--"]
SCRIPT = ["<script", "javascript:", "onerror=", "onload="]
TRAVERSAL = ["../", "..\\"]
SCANNERS = ["nikto", "sqlmap", "nmap", "masscan"]
JSON_DENIED = ["authentication failed", "invalid credentials", "unauthorized", "access denied", "permission denied"]
JSON_SECURITY_SERVICES = ["auth", "security", "firewall"]
JSON_SLOW = ["timeout", "slow query", "high latency", "connection pool exhausted", "out of memory", "cpu"]
JSON_STORES = ["database", "cache", "redis", "postgres", "mysql"]
JSON_GATEWAYS = ["api", "gateway", "proxy"]
JSON_LIMITS = ["rate limit", "throttled"]
SUDO_FAILED = ["authentication failure", "incorrect password"]
LOGIN_FAILED = ["Failed password", "invalid user"]
KERNEL = ["kernel panic", "out of memory", "OOM"]
CRASH = ["segmentation fault", "core dumped", "died", "crashed"]
WEB_SERVERS = ["nginx", "apache", "http"]
CONNECTIONS = ["connection", "connect"]
NGINX_DENIED = ["access forbidden", "denied", "not allowed"]
NGINX_TLS = ["SSL", "certificate"]
NGINX_UPSTREAM = ["upstream timed out", "connection refused", "connection reset", "no live upstreams"]


@dataclass
class Rule:
    when: Column
    types: int = 0
    severity: int | None = None
    text: Column | None = None
    only_if_empty: bool = False


@dataclass
class Classified:
    event_types: Column
    severity: Column
    description: Column

    def struct(self) -> Column:
        return F.struct(self.event_types.alias("event_types"), self.severity.alias("severity"), self.description.alias("description"))


def _applied(rules: list[Rule], base: Column, otherwise: Column) -> Classified:
    types = reduce(lambda a, b: a.bitwiseOR(b), (F.when(r.when, r.types).otherwise(0) for r in rules if r.types), F.lit(0))
    severity = base
    for r in rules:
        if r.severity is not None:
            severity = F.when(r.when, r.severity).otherwise(severity)
    text = F.lit("")
    for r in rules:
        if r.text is not None:
            text = F.when((r.when & (text == "")) if r.only_if_empty else r.when, r.text).otherwise(text)
    text = F.when(text == "", otherwise).otherwise(text)
    return Classified(types.cast("int"), severity.cast("int"), X.first_bytes(text, DESCRIPTION_BYTES))


def _text(label: str, value: Column, most: int) -> Column:
    return F.concat(F.lit(label), X.first_bytes(value, most))


def apache(e: Column) -> Classified:
    status, url, size = e["status"], e["url"], e["size"]
    rules = [
        Rule(status.isin(401, 403), SECURITY, 2, F.concat(_text("Unauthorized access: ", url, 100), _text(" from ", e["ip"], 40))),
        Rule(X.has(url, *SQL_INJECTION), SECURITY, 4, _text("SQL Injection attempt: ", url, 220)),
        Rule(X.has(url, *SCRIPT), SECURITY, 3, _text("XSS attempt: ", url, 230)),
        Rule(url.contains(TRAVERSAL[0]) | url.contains(TRAVERSAL[1]), SECURITY, 3, _text("Path traversal: ", url, 228)),
        Rule(X.has(e["user_agent"], *SCANNERS), SECURITY, 3, _text("Scanner detected: ", e["user_agent"], 230)),
        Rule(size > LARGE, PERFORMANCE, 2, F.concat(F.lit("Large response: "), size.cast("string"), _text(" bytes for ", url, 180))),
        Rule((status >= 500) & (status < 600), PERFORMANCE | ERROR, 3, F.concat(F.lit("Server error "), status.cast("string"), _text(": ", url, 230))),
        Rule(status == 503, PERFORMANCE, 4, F.lit("Service unavailable: possible overload")),
        Rule(F.lit(True), TRAFFIC),
        Rule(status == 404, TRAFFIC, 1, _text("Not found: ", url, 240), only_if_empty=True),
        Rule(e["method"].isin("POST", "PUT", "DELETE"), TRAFFIC),
    ]
    plain = F.concat(X.first_bytes(e["method"], 15), _text(" ", url, 220), F.lit(" - Status "), status.cast("string"))
    return _applied(rules, F.lit(0), plain)


def json(e: Column) -> Classified:
    message, service = e["message"], e["service"]
    rules = [
        Rule(X.has(message, *JSON_DENIED), SECURITY, 3),
        Rule(X.has(service, *JSON_SECURITY_SERVICES), SECURITY),
        Rule(X.has(message, *JSON_SLOW) | (X.has(message, "took") & X.has(message, "ms")), PERFORMANCE),
        Rule(X.has(service, *JSON_STORES), PERFORMANCE),
        Rule(X.has(service, *JSON_GATEWAYS), TRAFFIC),
        Rule(X.has(message, *JSON_LIMITS), TRAFFIC | SECURITY),
        Rule(e["level"] >= X.JSON_LEVELS.index("ERROR"), ERROR),
    ]
    plain = F.concat(_text("[", service, 60), F.lit("] "), X.severity_name(e["level"]), _text(": ", message, 160))
    return _applied(rules, e["level"], plain)


def syslog(e: Column) -> Classified:
    message, service = e["message"], e["service"]
    low = e["priority"].bitwiseAND(7)
    base = F.when(low <= 1, 4).when(low <= 3, 3).when(low == 4, 2).when(low <= 6, 1).otherwise(0)
    rules = [
        Rule(e["is_auth_failure"], SECURITY, 3, _text("Auth failure: ", message, 228)),
        Rule(e["is_sudo_attempt"], SECURITY),
        Rule(e["is_sudo_attempt"] & X.has(message, *SUDO_FAILED), SECURITY, 4),
        Rule(e["is_firewall_block"], SECURITY, 2),
        Rule(service.rlike("(?i)^(?:sshd|sudo|pam)$") | X.has(service, "firewall", "iptables"), SECURITY),
        Rule(X.has(message, *LOGIN_FAILED), SECURITY, 4),
        Rule(X.has(message, *KERNEL), PERFORMANCE | ERROR, 4),
        Rule(X.has(message, *CRASH), PERFORMANCE | ERROR, 4),
        Rule(X.has(service, *WEB_SERVERS), TRAFFIC),
        Rule(X.has(message, *CONNECTIONS), TRAFFIC),
    ]
    plain = F.concat(X.first_bytes(service, 60), F.lit("["), e["pid"].cast("string"), _text("]: ", message, 180))
    return _applied(rules, base, plain)


def nginx(e: Column) -> Classified:
    message, level = e["message"], e["level"]
    base = F.when(level >= 6, 4).when(level >= 4, 3).when(level == 3, 2).when(level >= 1, 1).otherwise(0)
    rules = [
        Rule(X.has(message, *NGINX_DENIED), SECURITY, 2),
        Rule(X.has(message, *NGINX_TLS), SECURITY),
        Rule(X.has(message, *NGINX_UPSTREAM), PERFORMANCE, 3),
        Rule(X.has(message, "limiting requests"), PERFORMANCE | TRAFFIC, 2),
        Rule(X.has(message, "too large"), PERFORMANCE | TRAFFIC),
        Rule(F.lit(True), TRAFFIC),
    ]
    done = _applied(rules, base, F.lit(""))
    text = F.concat(F.lit("Nginx ["), X.severity_name(done.severity), _text("]: ", message, 180), _text(" (", e["client_ip"], 40), F.lit(")"))
    return Classified(done.event_types, done.severity, X.first_bytes(text, DESCRIPTION_BYTES))
