import random

import numpy as np
import pytest

from logmill.llm import decontamination
from logmill.llm.decontamination import align, clean, contaminated


def plain(p, q):
    h = np.zeros((len(p) + 1, len(q) + 1))
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if p[i - 1] == q[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    r = np.random.default_rng(0)
    for _ in range(200):
        p, q = r.integers(0, 5, r.integers(1, 40)), r.integers(0, 5, r.integers(1, 30))
        score, begin, end = align(p, q)
        assert score == plain(p, q)
        if score:
            assert plain(p[begin:end], q) == score


def test_least_kept_against_all_alignments():
    """Of a short item, every document over its words and one other that can reach the threshold keeps that many pairs."""
    for n, threshold in ((5, 0.5), (6, 0.5), (5, 0.7)):
        kept = decontamination.least_kept(n, 2 * n * threshold)
        item = list(range(n))
        r = random.Random(n)
        for _ in range(4000):
            doc = []
            for w in item:
                doc += [[w], [], [99], [w, 99], [w, 99, 99]][r.choices(range(5), [5, 1, 1, 3, 1])[0]]
            if align(np.array(doc, dtype=np.int64), np.array(item))[0] >= 2 * n * threshold if doc else False:
                pairs = sum(any(doc[k] == a and b in doc[k + 1 : k + 3] for k in range(len(doc))) for a, b in zip(item, item[1:]))
                assert pairs >= kept


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{int(r.expovariate(0.01))}"
    items = [(k, " ".join(word() for _ in range(r.randint(16, 60)))) for k in range(30)]
    rows, want = [], set()
    for k in range(200):
        words = [word() for _ in range(r.choice([0, 5, 200, 3000]))]
        if r.random() < 0.4:
            i, text = r.choice(items)
            copy = text.split()
            for _ in range(int(len(copy) * r.choice([0, 0.05, 0.15]))):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], [word()], [word(), copy[at]]])
            copy = [c.upper() + r.choice([",", "", "."]) for c in copy]
            at = r.randint(0, len(words))
            words[at:at] = copy
            want.add((k, i))
        rows.append((k, " ".join(words)))
    return items, rows, want


@pytest.mark.parametrize("hot", [10_000, 1 << 40])
def test_edited_copies(spark, monkeypatch, hot):
    """With the second value every seed is joined in parts."""
    monkeypatch.setattr(decontamination, "HOT_WORDS", hot)
    items, rows, want = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS score")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    texts, tests = dict(rows), dict(items)
    for r in got:
        passage = texts[r["doc_id"]].encode()[r["begin"] : r["end"]].decode().lower().replace(",", "").replace(".", "").split()
        item = tests[r["item_id"]].split()
        assert r["score"] == plain(passage, item) / (2 * len(item)) >= 0.5
    assert {r["doc_id"] for r in clean(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def test_edges(spark):
    items = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "two words"), (None, "no id of this item at all"), (5, "!!")]
    rows = [(1, None), (2, ""), (3, "Alpha, beta gamma DELTA epsilon."), (3, "Alpha, beta gamma DELTA epsilon."), (4, "Two words"), (5, "two words more"), (None, "alpha beta gamma delta epsilon"), (6, "no id of this item at all")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["score"]) for r in contaminated(docs, bench).collect())
    assert got == [(3, 1, 1.0), (3, 1, 1.0), (4, 4, 1.0), (5, 4, 1.0)]
    assert sorted((r["doc_id"] or 0) for r in clean(docs, bench).collect()) == [0, 1, 2, 6]
    assert contaminated(docs.limit(0), bench).collect() == []
    assert contaminated(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("verbatim", [False, True])
def test_heavy_edits_against_brute_force(spark, verbatim):
    r = random.Random(11)
    word = lambda: f"w{int(r.expovariate(0.002))}"
    items = [(k, [word() for _ in range(r.randint(8, 60))]) for k in range(20)]
    rows = [(1000 + k, list(text)) for k, text in items] if verbatim else []
    for k in range(240):
        copy = list(r.choice(items)[1])
        edit, every = k % 4, r.choice([3, 4, 5])
        if edit == 0:
            copy = [word() if n % every == every - 1 else w for n, w in enumerate(copy)]
        elif edit == 1:
            copy = [w for n, w in enumerate(copy) if n % every != every - 1]
        elif edit == 2:
            copy = [x for n, w in enumerate(copy) for x in ([w, word()] if n % (every - 2) == 0 else [w])]
        else:
            copy = [word() if r.random() < 0.3 else w for w in copy]
        before, after = ([word() for _ in range(r.choice([0, 40, 300]))] for _ in "ab")
        rows.append((k, [*before, *copy, *after]))
    want = aligned(rows, items)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in contaminated(docs, bench).collect()} == want
    assert len(want) > 150


def aligned(rows, items, threshold=0.5):
    """Scores of all pairs that reach the threshold, each aligned whole."""
    numbers: dict[str, int] = {}
    number = lambda words: np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    want = {}
    for k, text in rows:
        for i, item in items:
            score = align(number(text), number(item))[0] / (2 * len(item)) if text else 0
            if score >= threshold:
                want[k, i] = score
    return want


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_short_items_against_brute_force(spark, threshold):
    """Items of one to seven words, some of which stand in most documents, verbatim and edited."""
    r = random.Random(17)
    word = lambda: f"w{int(r.expovariate(0.01))}"
    items = [(k, [word() for _ in range(k % 7 + 1)]) for k in range(42)] + [(90, ["w1", "w1", "w2"]), (91, ["w3"] * 6)]
    rows = []
    for k in range(260):
        copy = list(r.choice(items)[1])
        for _ in range(r.choice([0, 1, 1, 2])):
            at = r.randrange(len(copy) + 1)
            copy[at : at + r.choice([0, 1])] = r.choice([[], [word()], [word(), word()]])
        before, after = ([word() for _ in range(r.choice([0, 3, 60]))] for _ in "ab")
        rows.append((k, [*before, *copy, *after]))
    want = aligned(rows, items, threshold)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in contaminated(docs, bench, threshold=threshold).collect()} == want
    assert len({i for _, i in want}) > 35


def test_repeated_rows(spark):
    """A row a thousand times gives its pair a thousand times."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(k % 2, text + " and so on") for k in range(2000)], "doc_id long, text string").repartition(8)
    got = contaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).groupBy("doc_id", "item_id", "score", "seeds").count().collect()
    assert sorted((r["doc_id"], r["item_id"], r["score"], r["count"]) for r in got) == [(0, 1, 1.0, 1000), (1, 1, 1.0, 1000)]
