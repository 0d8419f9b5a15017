import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from logmill.llm import periodic_runs
from logmill.llm.periodic_runs import find_runs, folded, most_periodic, op13_periodic_runs, runs


def brute(w, least_words=24, least_periods=3):
    """(start, end, period) by the definition."""
    out = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(least_words, least_periods * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e, q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequence(r):
    n = r.choice([0, 1, 2, 5, 30, 60, 120, 250])
    w = [r.randrange(r.choice([1, 2, 2, 3, 6])) for _ in range(n)]
    for _ in range(r.choice([0, 1, 2])):
        if n > 3:
            a = r.randrange(n)
            b, p = r.randint(a, n), r.randint(1, max(1, (n - a) // 2))
            w = [w[a + (i - a) % p] if a <= i < b else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize(("least_words", "least_periods"), [(24, 3), (2, 2), (6, 3), (10, 4)])
def test_all_runs(least_words, least_periods):
    r = random.Random(least_words)
    for _ in range(150):
        docs = [sequence(r) for _ in range(r.randint(1, 4))]
        want, base = [], 0
        for d in docs:
            want += [(s + base, e + base, q) for s, e, q in brute(d, least_words, least_periods)]
            base += len(d)
        got = runs(np.array(sum(docs, []), dtype=np.uint64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least_words, least_periods)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_fibonacci_word():
    """Many runs of many periods in one word."""
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    got = runs(np.array(b, dtype=np.uint64), np.zeros(len(b), dtype=np.int64), 2, 2)
    assert list(zip(*(x.tolist() for x in got))) == brute(b, 2, 2)


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda x: (-Fraction(x[1] - x[0], x[2]), x[0], x[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in found)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(kept)))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n\t"), (4, "é " * 30), (4, "é " * 30), (-12, "x y z " * 9)]
    for k in range(100, 300):
        words = [r.choice("abcdefgh") * r.choice([1, 1, 3]) for _ in range(r.choice([1, 30, 120]))]
        if k % 2:
            at = r.randint(0, len(words))
            words[at:at] = [r.choice("XYé") for _ in range(r.randint(1, 9))] * r.randint(3, 9)
        rows.append((k, r.choice([" ", "\n", " \t"]).join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_runs", "'x' AS runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*x) for x in rows), key=str)
    assert sum(x[1] for x in got) > 60


def test_long_text_and_parameters(spark):
    text = " ".join(f"w{k % 70_000}" for k in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, "a a a")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in find_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 400_000, 70_000)]
    assert got[1]["collapsed"] == " ".join(f"w{k}" for k in range(70_000))
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "a a a"
    assert [tuple(x) for x in find_runs(docs.where("doc_id = 2"), least_words=3, least_periods=3).first()["runs"]] == [(0, 3, 1)]
    assert find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two"):
        find_runs(docs, least_periods=1)
    assert most_periodic([(9, 60, 20), (4, 30, 10), (2, 29, 10)]) == (4, 30, 10)
    assert folded(0, 1).tolist() == []


def test_ties_between_orders():
    """Both orders of the letters give a root to some run of this word."""
    w = ([1, 2] * 13 + [3] + [2, 1] * 13 + [0]) * 2
    got = periodic_runs.runs(np.array(w, dtype=np.uint64), np.zeros(len(w), dtype=np.int64))
    assert list(zip(*(x.tolist() for x in got))) == brute(w)
