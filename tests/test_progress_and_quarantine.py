"""Lenient JSON, lines sorted into entries and rejected ones, and progress while a job runs."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logmill.functions import scalars
from logmill.operators import entries, metrics, parse
from logmill.plans import live
from logmill.plans.analyze import analyze, bar, main
from logmill.plans.quarantine import sort_out
from logmill.sources.files import NoLogs, read_logs, source_lines

A = '10.0.0.{} - - [13/Feb/2024:10:23:45 +0000] "GET {} HTTP/1.1" {} 12'


def folder(path: Path, files: dict[str, str]) -> str:
    path.mkdir(exist_ok=True)
    for name, text in files.items():
        (path / name).write_text(text)
    return str(path)


def plain_json(line):
    """(level, service, message, ip, user_id) by Python's own reader, or None; the text behind the object is not looked at."""
    try:
        top, _ = json.JSONDecoder().raw_decode(line)
    except ValueError:
        return None
    words = {"DEBUG": 0, "INFO": 1, "WARN": 2, "WARNING": 2, "ERROR": 3, "CRITICAL": 4, "FATAL": 4}
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    inner = top.get("metadata")
    inner = inner if isinstance(inner, dict) else {}
    digits = text(inner.get("user_id")).strip()
    n = len(digits) - len(digits.lstrip("0123456789"))
    return words.get(text(top.get("level")).upper(), 0), text(top.get("service")), text(top.get("message")), text(inner.get("ip")), int(digits[:n] or 0)


LINES = [
    '{"level":"info","service":"a","message":"x","metadata":{"ip":"1.2.3.4","user_id":5}}',
    '{"level":"INFO","level":"Fatal"}',
    '{"metadata":{"level":"ERROR","ip":"9.9.9.9"},"level":"debug"}',
    '{"message":"\\"level\\":\\"ERROR\\" \\u00e9\\n"}',
    '{"message":"\\ud83d\\ude00 tab\\t"}',
    '{"metadata":[1,2],"message":{"a":[1,{"b":"c"}]},"service":true}',
    '{"metadata":{"user_id":"12x"},"level":3}',
    '{"metadata":null,"level":null}',
    "{}",
    '{"level":"ERROR"} behind',
    '{"level":"ERROR"',
    '{"level" "ERROR"}',
    "{'level':'ERROR'}",
    '{"level":"ERROR","metadata":{"ip":"1"}',
    '{"a":NaN,"level":ERROR}',
    "",
    "text",
]


def test_lenient_json(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(LINES + [None])], "k int, value string")
    got = {r["k"]: r["e"] for r in rows.select("k", parse.json_lenient(F.col("value")).alias("e")).collect()}
    for k, line in enumerate(LINES):
        want = plain_json(line)
        assert (got[k] and tuple(got[k])[1:]) == want, line
    assert got[len(LINES)] is None


def test_lines_are_entries_or_rejected(spark, tmp_path):
    texts = {"a.log": ["nothing", "\x00"], "b.log": [A.format(1, "/x", 404), "junk", "", "2001 - -"], "c.log": ["2024/02/13 10:23:45 [error] 1#2: *3 text", "2024/02/13 no bracket here"], "d.log": ['{"level":"error"}', '{"level"', "<3>Feb 3 10:23:45 host sshd: text"]}
    lines = spark.createDataFrame([(s, k, v, 7) for s, vs in texts.items() for k, v in enumerate([*vs, None])] + [("b.log", 1, "junk", 7)], "source string, pos long, value string, reason int").drop("reason")
    for lenient in (False, True):
        made = sort_out(lines, str(tmp_path / f"q{lenient}"), lenient=lenient, year=2024)
        good, bad = made.entries.collect(), made.rejected.collect()
        assert made.counts == {"lines": lines.count(), "entries": len(good), "rejected": len(bad)} and len(good) + len(bad) == lines.count()
        clean = lines.where("value <> ''")
        want = entries.entries(clean, lenient=lenient, year=2024, keep=("source", "pos"))
        key = lambda rows: sorted(map(str, rows))
        assert key(r.asDict() for r in made.entries.select(want.columns).collect()) == key(r.asDict() for r in want.collect())
        assert {(r["source"], r["pos"]): r["reason"] for r in bad if r["source"] == "b.log"}[("b.log", 1)] == ("no known format" if lenient else "not an apache line")
        assert [r["reason"] for r in bad if r["value"] is None or r["value"] == ""] == ["empty"] * 5
    assert {r["reason"] for r in bad} == {"empty", "no known format", "broken json", "no closing bracket"}
    # a mode leaves out entries of others, and no rejected line
    some = sort_out(lines, str(tmp_path / "m"), "security", lenient=True, year=2024)
    assert some.counts["rejected"] == len(bad) and some.counts["entries"] < len(good)
    none = sort_out(lines.limit(0), str(tmp_path / "none"))
    assert (none.entries.count(), none.rejected.count(), none.counts) == (0, 0, {"lines": 0, "entries": 0, "rejected": 0})


def test_progress_moves_while_the_one_job_runs(spark, tmp_path):
    path = folder(tmp_path / "logs", {f"{k}.log": "\n".join(A.format(k, "/x", 500 + k) for _ in range(50)) + "\n" for k in range(12)})
    reads = spark.sparkContext.accumulator(0)

    def slow(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            time.sleep(0.4)
            yield batch

    lines = source_lines(spark, path, workers="12", line="0")
    shots = []
    made = live.run(spark, path, str(tmp_path / "counts"), show=shots.append, every=0.1, lines=lines.mapInArrow(slow, lines.schema))
    assert reads.value == 600  # one read of each line
    sums = [s.rows[-1] for s in shots]
    assert [r["done"] for r in sums] == sorted(r["done"] for r in sums) and len({r["percent"] for r in sums}) > 2
    assert [r["errors"] for r in sums] == sorted(r["errors"] for r in sums) and len({r["errors"] for r in sums}) > 2
    assert len({s.tasks_done for s in shots}) > 2
    assert (sums[-1]["percent"], sums[-1]["lines"], sums[-1]["errors"]) == (100, 600, 600)
    assert any(0 < r["percent"] < 100 for s in shots for r in s.rows)
    assert bar(shots[-1]).startswith("[####################] 100% 600 lines, errors 600")
    rows = {r["source"] and r["source"].rpartition("/")[2]: tuple(r)[1:] for r in live.final(made).collect()}
    assert rows == {None: (600, 600, 600, 100)} | {f"{k}.log": (50, 50, 50, 100) for k in range(12)}


@pytest.mark.parametrize("mode", ["full", "Security", "performance"])
def test_watched_counts_are_those_of_a_batch(spark, tmp_path, mode):
    path = folder(tmp_path / "logs", {"a.log": "\n".join([A.format(1, "/x", 401), "junk", A.format(2, "/x", 503), A.format(1, "/y", 200)]), "_b.log": '{"level":"ERROR","service":"auth"}\n\n{"level":"INFO"}\r\n', "empty.log": ""})
    made = live.run(spark, path, str(tmp_path / "counts"), mode, year=2024)
    whole = analyze(spark, path, mode, year=2024)
    assert metrics.merged(made).first() == whole.metrics.first()
    assert live.text(made, mode) == whole.text()
    last = live.final(made).where("source is null").first()
    assert (last["lines"], last["entries"]) == (read_logs(spark, path).count(), whole.entries.count())
    (tmp_path / "void").mkdir()
    for none in ("void", "nowhere"):
        with pytest.raises(NoLogs):
            live.run(spark, str(tmp_path / none), str(tmp_path / "c"))


def test_command_line_shows_progress_and_sorts_out(spark, tmp_path, capsys):
    path = folder(tmp_path / "logs", {"x.log": "\n".join([A.format(1, "/x", 500), "junk", A.format(2, "/x", 200)])})
    assert main([path, "full", "--progress", "--quarantine", str(tmp_path / "q"), "--output", str(tmp_path / "r.txt")]) == 0
    out = capsys.readouterr()
    assert "lines 3, entries 2, rejected 1" in out.err and "100% 3 lines, errors 1" in out.err
    assert "Total: [####################] 100% (3/3) errors 1" in out.out
    assert (tmp_path / "r.txt").read_text() == analyze(spark, path).text()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "q")).where("part = 'rejected'").select("reason", "value").collect()] == [("not an apache line", "junk")]


def test_words_of_modes(spark):
    rows = spark.createDataFrame([("Security",), ("FULL",), ("none",), (None,)], "w string")
    assert [r[0] for r in rows.select(scalars.mode_bits_of(F.col("w"))).collect()] == [1, 15, None, None]
