import random

import pytest

from logmill.llm import line_dedup
from logmill.llm import textkernel as K
from logmill.llm.line_dedup import LineRuns, dedup_batch, dedup_lines

BLANK = " \t\n\v\f\r"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def key(line):
    return line.strip(BLANK).translate(A_Z)


def brute(rows, least_docs, least_chars):
    docs = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            if k is not None and len(key(line)) >= least_chars:
                docs.setdefault(key(line), set()).add(k)
    keeper = {x: max(ks) for x, ks in docs.items() if len(ks) >= least_docs}
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if k is None or keeper.get(key(x), k) == k]
        out.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    pool = ["".join(r.choice("abc déÉß") for _ in range(r.choice([5, 39, 40, 41, 90]))) for _ in range(60)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(r.choice([0, 1, 3, 12])):
            line = r.choice(pool[: r.choice([4, 60])])
            line = line.upper() if r.random() < 0.2 and "ß" not in line and "é" not in line else line
            lines.append(r.choice(["", "", " ", "\t\v"]) + line + r.choice(["", "", "\r", "  "]))
            if r.random() < 0.2:
                lines.append("")
        rows.append((k * 7 % 1009, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("told", "hot", "least_docs", "least_chars"), [(1 << 20, 1_000, 5, 40), (0, 1_000, 5, 40), (0, 1 << 40, 3, 20)])
def test_brute_force(spark, monkeypatch, told, hot, least_docs, least_chars):
    """With told=0 lines to drop are joined, and all of them in parts with the last value of hot."""
    monkeypatch.setattr(line_dedup, "MOST_TOLD", told)
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", hot)
    rows = corpus(3) + [(None, "x" * 50), (7, "x" * 50), (7, "x" * 50), (8, "X" * 50 + " \n"), (9, "x" * 50), (10, "\tx" + "X" * 49), (2000, "x" * 50), (2000, "y\n" + "x" * 50)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h1", "'a' AS n_lines")
    got = sorted(map(tuple, dedup_lines(docs, least_docs=least_docs, least_chars=least_chars).collect()), key=str)
    assert got == brute(rows, least_docs, least_chars)
    assert sum(r[2] for r in got) > 100


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (None, None), (4, "a" * 10_000_000)], SCHEMA)
    got = {r[0]: tuple(r)[1:3] for r in dedup_lines(docs).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0), None: (1, 0), 4: (1, 0)}
    assert dedup_lines(docs.limit(0)).collect() == []


def test_batches_against_runs(spark):
    """Each batch loses what earlier ones hold; runs are merged on the way and found again in their folder."""
    folder = K.new_folder(spark)
    runs, seen = LineRuns(spark, folder, fanout=2, buckets=3), set()
    for seed in range(5):
        rows = corpus(seed, 30)
        got = sorted(map(tuple, dedup_batch(runs, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
        held = {}
        for k, text in rows:
            for line in text.split("\n"):
                if len(key(line)) >= 40:
                    held[key(line)] = max(k, held.get(key(line), k))
        want = []
        for k, text in rows:
            lines = text.split("\n")
            kept = [x for x in lines if len(key(x)) < 40 or key(x) not in seen and held[key(x)] == k]
            want.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
        assert got == sorted(want, key=str)
        seen |= set(held)
        assert len(runs.runs) <= 3
        assert runs.held().count() == runs.held().select("h1", "h2").distinct().count() == len(seen)
        if seed == 2:
            runs = LineRuns(spark, folder, fanout=2, buckets=3)
    assert max(level for level, *_ in runs.runs) == 2


def test_runs_are_not_shuffled(spark):
    """A merge-anti-join exchanges the batch only, however many runs it meets."""
    runs = LineRuns(spark, K.new_folder(spark), fanout=9, buckets=4)
    for k in range(3):
        runs.add(spark.range(k * 10, k * 10 + 10).selectExpr("id AS h1", "-id AS h2", "id AS doc_id"))
    fresh = runs.fresh(spark.range(5, 50).selectExpr("id AS h1", "-id AS h2", "id AS doc_id"))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(r[0] for r in fresh.collect()) == list(range(30, 50))
    runs.delete()
    assert runs.held().collect() == []
