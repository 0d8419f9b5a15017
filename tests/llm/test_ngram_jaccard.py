import random
import re
import time

import pytest

from logmill.llm import ngram_jaccard
from logmill.llm.ngram_jaccard import first_of_each, jaccard_join

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted((k, len(s), least[top(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def copies(seed):
    r = random.Random(seed)
    words = [f"w{int(r.expovariate(0.02))}" for _ in range(4000)]
    rows = []
    for _ in range(40):
        at = r.randrange(3000)
        base = words[at : at + r.choice([2, 3, 8, 40, 120])]
        for _ in range(r.choice([1, 1, 2, 5, 25])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = f"e{r.randrange(6)}"
            rows.append((len(rows) * 3 % 100003, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in text)))
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_brute_force(spark, size, percent, seed):
    rows = copies(seed)
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, size, percent)


@pytest.mark.parametrize(("meet", "meet_all", "pairs"), [(2_000, 50_000, 1 << 16), (2_000, 50_000, 0), (7, 11, 100)])
def test_frequent_tokens_without_links(spark, monkeypatch, meet, meet_all, pairs):
    """Tokens in the prefix of many sets of which few link; the small blocks split each of them."""
    monkeypatch.setattr(ngram_jaccard, "MEET", meet)
    monkeypatch.setattr(ngram_jaccard, "MEET_ALL", meet_all)
    monkeypatch.setattr(ngram_jaccard, "PAIRS", pairs)
    r = random.Random(8)
    common = [f"c{k}" for k in range(24)]
    rows = [(k, " ".join(r.sample(common, 9) + ["hot"] * (k % 3 == 0))) for k in range(400)]
    got = sorted(map(tuple, jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), size=1, percent=75).collect()))
    assert got == brute(rows, 1, 75)
    assert 50 < len({c for *_, c in got}) < 399
    with pytest.raises(ValueError, match="50"):
        jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=40)


def test_edges(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(5, None, "a"), (6, "", "a"), (7, " \n\t", "a"), (8, "one two", "a"), (3, "One  two", "a"), (3, "One  two", "a"), (None, "one two", "a"), (9, long, None), (4, long + " y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, jaccard_join(docs, size=3, percent=90).collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None), (9, 29998, 4), (4, 29999, 4)], key=str)
    kept = first_of_each(docs, size=3, percent=90)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted([5, 6, 7, 3, 4, None], key=str)
    assert jaccard_join(docs.limit(0)).collect() == []


def test_repeated_rows_of_linked_texts(spark):
    """Whole sets of repeated rows, and of exact copies under other ids, are joined once: ten thousand take no more than some time over one."""
    base = [f"w{k}" for k in range(60)]
    pair = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"]))]
    began = time.monotonic()
    one = jaccard_join(spark.createDataFrame(pair, "doc_id long, text string"), size=3, percent=90).collect()
    once = time.monotonic() - began
    assert sorted(map(tuple, one)) == [(1, 58, 1), (2, 58, 1)]
    docs = spark.range(20_000).selectExpr("IF(id < 10000, id % 2 + 1, id) AS doc_id", "id % 2 AS odd")
    docs = docs.join(spark.createDataFrame([(k - 1, text) for k, text in pair], "odd long, text string"), "odd").select("doc_id", "text").repartition(8)
    began = time.monotonic()
    got = jaccard_join(docs, size=3, percent=90).groupBy("n_shingles", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(58, 1, 20_000)]
    assert time.monotonic() - began < 2 * once + 10
