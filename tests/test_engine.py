"""Files, counters, reports, stream and command line; registered queries against DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from logmill.functions import scalars
from logmill.operators import entries, metrics
from logmill.plans import queries, report
from logmill.plans.analyze import analyze, dashboard, main, progress
from logmill.sources import synthetic
from logmill.sources.files import NoLogs, line_counts, log_files, read_logs, source_lines
from logmill.sources.scratch import scratch_folder
from logmill.streaming import logs

A = '192.168.1.{} - - [13/Feb/2024:10:23:45 +0000] "GET {} HTTP/1.1" {} 1234 "https://example.com" "Mozilla/5.0"'


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_bundled_shapes(spark, tmp_path):
    path = write(tmp_path / "a", {f"t{k}.log": A.format(100, "/api/users", 200) for k in range(3)})
    for mode, total in {"full": 3, "Traffic": 3, "security": 0, "performance": 0}.items():
        r = analyze(spark, path, mode)
        row = r.metrics.first()
        assert (row["total_lines"], row["count_info"]) == (total, total)
        assert [tuple(x) for x in r.top_ips.collect()] == ([("192.168.1.100", 3)] if total else [])
    path = write(tmp_path / "b", {"1.log": "INFO: Sistema arrancou com sucesso", "2.log": "ERROR: Base de dados não responde\n", "3.log": "CRITICAL: Falha geral no servidor"})
    assert analyze(spark, path).metrics.first()["count_debug"] == 3
    assert analyze(spark, path, "traffic").metrics.first()["total_lines"] == 0
    assert analyze(spark, path, strict=False).metrics.first()["total_lines"] == 0


def test_lines_of_files(spark, tmp_path):
    path = write(tmp_path / "a", {"x.log": b"a\rb\r\nc\n\n\nd", "long.log": b"y" * 600 + b"\n", ".log": b"no", "note.txt": b"no", "_hidden.log": b"h\ni\n", ".x.log": b"j", "UPPER.LOG": b"no", "empty.log": b""})
    (tmp_path / "a" / "sub").mkdir()
    (tmp_path / "a" / "sub" / "deep.log").write_text("no")
    assert [os.path.basename(p) for p in log_files(spark, path)] == [".x.log", "_hidden.log", "empty.log", "long.log", "x.log"]
    rows = read_logs(spark, path).orderBy("source", "pos").collect()
    assert [r["value"] for r in rows] == ["j", "h", "i", "y" * 511, "a", "b", "c", "d"]
    assert {os.path.basename(r["source"]): r["total"] for r in line_counts(spark, path).collect()} == {".x.log": 0, "_hidden.log": 2, "long.log": 1, "x.log": 4}
    with pytest.raises(FileNotFoundError):
        read_logs(spark, str(tmp_path / "none"))
    (tmp_path / "void").mkdir()
    with pytest.raises(NoLogs):
        read_logs(spark, str(tmp_path / "void"))


def test_first_line_of_a_split_file(spark, tmp_path):
    text = '{"level":"ERROR","message":"first"}\n' + "\n".join(A.format(k % 9, "/x", 404) for k in range(4000))
    path = write(tmp_path / "a", {"big.log": text})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = read_logs(spark, path)
        assert lines.rdd.getNumPartitions() > 8
        assert metrics.summary(entries.entries(lines)).first()["count_debug"] == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_counters_do_not_depend_on_layout(spark, tables):
    lines = synthetic.all_lines(spark, tables)
    base = metrics.summary(entries.entries(lines)).first().asDict()
    assert sum(base[c] for c in metrics.COUNTERS[1:6]) == base["total_lines"]
    assert all(base[c] > 0 for c in metrics.COUNTERS)
    again = metrics.summary(entries.entries(lines.repartition(7).orderBy(F.rand(1)))).first().asDict()
    assert again == base
    for mode in ("security", "performance", "traffic"):
        part = metrics.summary(entries.entries(lines, mode)).first().asDict()
        assert all(part[c] <= base[c] for c in base)
    assert metrics.summary(entries.entries(lines.limit(0))).first().asDict() == dict.fromkeys(metrics.COUNTERS, 0)


def test_every_rule_has_hits(spark, tables):
    from logmill.operators import classify

    for kind in synthetic.KINDS:
        rules = []
        keep, classify._applied = classify._applied, lambda rs, *a, f=classify._applied: rules.extend(rs) or f(rs, *a)
        try:
            getattr(classify, kind)(F.col("e"))
        finally:
            classify._applied = keep
        e = queries._parsed(spark, tables, kind)
        hits = e.agg(*(F.count_if(r.when).alias(f"r{k}") for k, r in enumerate(rules))).first()
        dead = [k for k in range(len(rules)) if not hits[k]]
        assert dead == ([4] if kind == "apache" else []), kind  # agents are read in lenient mode only


def test_reports(tmp_path, capsys):
    m = dict(zip(metrics.COUNTERS, [6, 0, 3, 2, 1, 0, 2, 1]))
    ips = [("192.168.1.1", 3), ("192.168.1.2", 2), ("192.168.1.3", 1)]
    full = report.text("prodcons", "full", m, "192.168.1.1", ips)
    assert full.startswith("\n=== RELATORIO FINAL PRODUTOR-CONSUMIDOR (full) ===\nTotal de linhas : 6\n\n--- ALERTAS DE SEGURANCA ---\nDEBUG           : 0\nINFO            : 3\nWARNINGS        : 2\n")
    assert "\n--- TOP IPs ---\n192.168.1.1 : 3 accesos\n192.168.1.2 : 2 accesos\n" in full
    assert report.text("prodcons", "performance", m).count("\n") == 4
    assert "HTTP 4xx/5xx    : 3\n" in report.text("sockets", "security", m) and "DEBUG" not in report.text("sockets", "security", m)
    assert "IP Mais Frequente: -\n" in report.text("sockets", "traffic", m)
    assert "IP Mais Frequente: N/A\n" in report.text("sockets", "traffic", m, "")
    assert "5xx             : 1\n" in report.text("pipes", "security", m)
    assert "HTTP 4xx/5xx    : 3\n" in report.text("threads", "traffic", m)
    report.emit(full, str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == full
    out = []
    report.emit(full, str(tmp_path / "none" / "r.txt"), out.append)
    assert out[-1] == full


def test_files_stream_and_progress(spark, tables):
    path = scratch_folder(spark)
    synthetic.write_logs(synthetic.all_lines(spark, tables), path)
    batch = metrics.summary(entries.entries(read_logs(spark, path), year=2024)).first()
    assert batch == metrics.summary(entries.entries(synthetic.all_lines(spark, tables), year=2024)).first()
    state = scratch_folder(spark)
    assert logs.run(spark, path, state, files_per_batch=2).first() == batch
    # a second run finds nothing new, and counts nothing twice
    assert logs.run(spark, path, state, files_per_batch=2).first() == batch
    assert logs.run(spark, path, scratch_folder(spark), files_per_batch=2, follow=False).first() == batch
    ips = {tuple(r) for r in logs.ip_totals(spark, state).collect()}
    assert ips == {tuple(r) for r in metrics.ip_counts(entries.entries(read_logs(spark, path))).collect()}
    rows = [r.asDict() for r in progress(spark, path).collect()]
    assert rows and rows[-1]["source"] is None or any(r["source"] is None for r in rows)
    text = dashboard(rows, 3725)
    assert "Total: [" in text and text.endswith("01:02:05\n")


def test_command_line(spark, tmp_path, capsys):
    path = write(tmp_path / "a", {"x.log": "\n".join(A.format(k, "/x", 500) for k in range(5))})
    assert main([path, "FULL", "--output", str(tmp_path / "out.txt"), "--parquet", str(tmp_path / "e"), "--progress"]) == 0
    assert "ERRORS          : 5" in (tmp_path / "out.txt").read_text()
    assert spark.read.parquet(str(tmp_path / "e")).count() == 5
    assert "x.log: [####################] 100%" in capsys.readouterr().out
    assert main([path, "everything"]) == 1
    assert main([path, "full", "--workers", "0"]) == 1
    assert main([str(tmp_path / "none"), "full"]) == 1
    (tmp_path / "void").mkdir()
    assert main([str(tmp_path / "void"), "full"]) == 0


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, tables, name):
    got = queries.QUERIES[name](spark, tables).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
    assert len(got)


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["total_lines"] > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_generator_of_lines(spark, tmp_path):
    """The same lines for a seed at any number of tasks; files of the kinds by weight."""
    events = synthetic.generated(spark, 3000, seed=5)
    weights = {"apache": 3, "json": 0, "syslog": 1}
    lines = synthetic.weighted_lines_of(events, weights, sources=2)
    assert sorted(lines.collect()) == sorted(synthetic.weighted_lines_of(synthetic.generated(spark, 3000, seed=5).repartition(7), weights, sources=2).collect())
    assert sorted(lines.collect()) != sorted(synthetic.weighted_lines_of(synthetic.generated(spark, 3000, seed=6), weights, sources=2).collect())
    counts = {r["source"]: r["count"] for r in lines.groupBy("source").count().collect()}
    assert set(counts) == {f"{kind}-{k}.log" for kind in ("apache", "syslog") for k in (0, 1)}
    assert 0.72 < (counts["apache-0.log"] + counts["apache-1.log"]) / 3000 < 0.78
    with pytest.raises(ValueError, match="weights"):
        synthetic.weighted_lines_of(events, {"csv": 1})
    assert synthetic.main([str(tmp_path / "logs"), "400", "--seed", "5", "--json", "0", "--files", "2"]) == 0
    found = {r["source"].rpartition("/")[2]: r["total"] for r in line_counts(spark, str(tmp_path / "logs")).collect()}
    assert sum(found.values()) == 400
    assert {n.partition("-")[0] for n in found} == {"apache", "syslog", "nginx"}
    assert synthetic.main([str(tmp_path / "none"), "-1"]) == 1


def test_epoch_of_event_times(spark):
    rows = spark.createDataFrame([("2024-02-13 10:23:45",), (None,)], "t string").selectExpr("cast(t AS timestamp_ntz) AS ts")
    got = rows.select(scalars.epoch(F.col("ts"), "UTC"), scalars.epoch(F.col("ts"), "Europe/Lisbon"), scalars.epoch(F.col("ts"), "America/New_York")).collect()
    assert list(map(tuple, got)) == [(1707819825, 1707819825, 1707837825), (None, None, None)]


def test_report_rows_of_no_entries(spark, tables):
    none = entries.entries(synthetic.all_lines(spark, tables), year=2024).limit(0)
    summary, top, ips = metrics.of_report(metrics.report_rows(none))
    assert set(summary.first()) == {0}
    assert (top.first()[0], ips.collect()) == (metrics.NO_IP, [])


def test_hidden_files_are_read_under_their_names(spark, tmp_path):
    path = write(tmp_path / "h", {"_a.log": b"one\ntwo", ".b.log": b"three\n", "c.log": b"four\n"})
    got = sorted((r["source"].rpartition("/")[2], r["value"]) for r in read_logs(spark, path).collect())
    assert got == [(".b.log", "three"), ("_a.log", "one"), ("_a.log", "two"), ("c.log", "four")]
    assert {r["source"].rpartition("/")[2]: r["total"] for r in line_counts(spark, path).collect()} == {"_a.log": 1, ".b.log": 1, "c.log": 1}
    assert {r["source"] for r in read_logs(spark, path).collect()} == {r["source"] for r in line_counts(spark, path).collect()}


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    state = str(tmp_path / "state")
    (tmp_path / "s").mkdir()
    # an empty folder, then files of all names, then one that grows under the format of its first line
    assert set(logs.run(spark, str(tmp_path / "s"), state).first()) == {0}
    path = write(tmp_path / "s", {"_a.log": A.format(1, "/a", 404) + "\n", ".b.log": A.format(2, "/b", 200), "c.log": '{"level":"ERROR"}\n'})
    assert logs.run(spark, path, state).first() == metrics.summary(entries.entries(read_logs(spark, path))).first()
    with open(tmp_path / "s" / "c.log", "a") as file:
        file.write(A.format(3, "/c", 500) + "\n")
    whole = metrics.summary(entries.entries(read_logs(spark, path))).first()
    assert logs.run(spark, path, state).first() == whole
    assert (whole["total_lines"], whole["count_debug"], whole["count_4xx"], whole["count_5xx"]) == (4, 1, 1, 0)


def test_ranges_of_bytes_hold_each_line_once(spark, tmp_path):
    lines = [f"{k:03d}" * (k % 7 + 1) for k in range(60)]
    path = write(tmp_path / "r", {"x.log": "\r\n".join(lines), "_y.log": "\n\n".join(lines) + "\n"})
    for size in (1, 5, 64, 1000):
        got = [r["value"] for r in source_lines(spark, path, range=str(size), workers="3").collect()]
        assert sorted(got) == sorted(lines * 2), size
    cut = read_logs(spark, path, partitions=3)
    assert cut.rdd.getNumPartitions() == 3 and "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
