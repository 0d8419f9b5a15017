"""Text reports in four layouts, and where they go."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import NO_IP

# Titles and labels of the reports.
TITLES = {"pipes": "RELATORIO FINAL", "sockets": "RELATORIO FINAL ({mode})", "threads": "RELATORIO FINAL THREADS ({mode})", "prodcons": "RELATORIO FINAL PRODUTOR-CONSUMIDOR ({mode})"}
CLOSING = {"pipes": "", "sockets": "=" * 33 + "\n", "threads": "=" * 33 + "\n\n", "prodcons": "=" * 48 + "\n"}
SECURITY, TRAFFIC, IPS = "ALERTAS DE SEGURANCA", "ESTATISTICAS DE TRAFEGO", "TOP IPs"
TOTAL, TOP_IP = "Total de linhas", "IP Mais Frequente"
LABELS = {"count_debug": "DEBUG", "count_info": "INFO", "count_warn": "WARNINGS", "count_error": "ERRORS", "count_critical": "CRITICAL", "count_4xx": "HTTP 4xx", "count_5xx": "HTTP 5xx", "count_4xx_5xx": "HTTP 4xx/5xx"}
#: Section, and counters in it, of each layout; a section is printed in its mode and in full.
SECTIONS = {
    "pipes": [("", ["count_debug", "count_info", "count_warn", "count_error", "count_critical", "count_4xx", "count_5xx"])],
    "sockets": [(SECURITY, ["count_warn", "count_error", "count_critical", "count_4xx_5xx"]), (TRAFFIC, ["count_info", "count_debug", "top_ip"])],
    "threads": [(SECURITY, ["count_warn", "count_error", "count_critical"]), (TRAFFIC, ["count_info", "count_4xx_5xx"])],
    "prodcons": [(SECURITY, ["count_debug", "count_info", "count_warn", "count_error", "count_critical"]), (TRAFFIC, ["count_4xx", "count_5xx"]), (IPS, [])],
}
_MODE_OF = {SECURITY: "security", TRAFFIC: "traffic", IPS: None}


def _shown(section: str, mode: str) -> bool:
    return not section or mode == "full" or _MODE_OF[section] == mode


def rows(layout: str, mode: str, metrics: dict, top_ip: str, top_ips: list[tuple[str, int]]) -> list[tuple[str, str, str]]:
    """(section, label, value) of a report in order."""
    values = metrics | {"count_4xx_5xx": metrics["count_4xx"] + metrics["count_5xx"]}
    out = [("", TOTAL, str(metrics["total_lines"]))]
    for section, counters in SECTIONS[layout]:
        if not _shown(section, mode):
            continue
        for c in counters:
            label = LABELS.get(c, TOP_IP)
            if layout == "pipes":
                label = label.removeprefix("HTTP ")
            out.append((section, label, (top_ip or "N/A") if c == "top_ip" else str(values[c])))
        if section == IPS:
            out += [(section, ip, str(hits)) for ip, hits in top_ips] or [(section, "", "")]
    return out


def text(layout: str, mode: str, metrics: dict, top_ip: str = NO_IP, top_ips: list[tuple[str, int]] = ()) -> str:
    """The printed report."""
    out, last = [f"\n=== {TITLES[layout].format(mode=mode)} ===\n"], ""
    for section, label, value in rows(layout, mode, metrics, top_ip, list(top_ips)):
        if section != last:
            out.append(f"\n--- {section} ---\n")
            last = section
        if section == IPS:
            out.append(f"{label} : {value} accesos\n" if label else "")
        else:
            out.append(f"{label:<16}: {value}\n")
    return "".join(out) + CLOSING[layout]


def emit(report: str, output: str | None = None, stream: Callable[[str], None] = sys.stdout.write) -> None:
    """Writes a report to a file, made or emptied; to the stream if there is none or it cannot be written."""
    if output:
        try:
            with open(output, "w", encoding="utf-8") as f:
                f.write(report)
            stream(f"\n[INFO] A gravar relatorio no ficheiro: {output}\n")
            return
        except OSError as e:
            stream(f"Erro ao criar ficheiro de output: {e}\n")
    stream(report)


def frame(layout: str, mode: str, summary: DataFrame, top: DataFrame | None = None, ips: DataFrame | None = None) -> DataFrame:
    """(section, label, value) of a report as rows, without bringing the counters to the driver."""
    values = summary.withColumn("count_4xx_5xx", F.col("count_4xx") + F.col("count_5xx"))
    cells = [F.struct(F.lit("").alias("section"), F.lit(TOTAL).alias("label"), F.col("total_lines").cast("string").alias("value"))]
    for section, counters in SECTIONS[layout]:
        if _shown(section, mode):
            name = lambda c: LABELS[c].removeprefix("HTTP ") if layout == "pipes" else LABELS[c]
            cells += [F.struct(F.lit(section).alias("section"), F.lit(name(c)).alias("label"), F.col(c).cast("string").alias("value")) for c in counters if c != "top_ip"]
    out = values.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if layout == "sockets" and _shown(TRAFFIC, mode) and top is not None:
        out = out.unionByName(top.select(F.lit(TRAFFIC).alias("section"), F.lit(TOP_IP).alias("label"), F.col("top_ip").alias("value")))
    if layout == "prodcons" and mode == "full" and ips is not None:
        out = out.unionByName(ips.select(F.lit(IPS).alias("section"), F.col("ip").alias("label"), F.col("hits").cast("string").alias("value")))
    return out
