"""Language, toxicity and quality: held-out accuracy on generated texts, brute-force forward-backward, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logmill.llm import language_id, quality, toxicity
from logmill.llm.wordmodel import bare_spans, chosen, distinct, grams, labelled, lowered, sample
from logmill.llm.textkernel import buffers

R = random.Random(7)
SYLLABLES = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ich", "ß"], "cc": ["eau", "é", "tion", "le"]}


def prose(lang, n):
    return " ".join("".join(R.choices(SYLLABLES[lang], k=R.randint(1, 3))) for _ in range(n))


def is_held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_forward_backward():
    r = np.random.default_rng(1)
    counts = np.array([3, 0, 70, 1, 200, 32, 64])
    scores, a = r.normal(size=(counts.sum(), 3)) * 3, np.exp(r.normal(size=(3, 3)))
    got, at = language_id.posteriors(scores, counts, a), 0
    for n in counts:
        emit = np.exp(scores[at : at + n])
        ahead, m = [], np.ones(3) / 3
        for e in emit:
            m = (m @ a) * e
            m /= m.sum()
            ahead.append(m)
        b = np.ones(3)
        for t in range(n - 1, -1, -1):
            want = ahead[t] * b
            assert np.allclose(got[at + t], want / want.sum())
            b = a @ (emit[t] * b)
            b /= b.sum()
        at += n


def test_grams_are_those_of_each_word():
    data, offsets = buffers(pa.array(["«Été!», THE the -- b", None, "the"]))
    data = lowered(data)
    starts, ends, counts = bare_spans(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words[1:] == ["the", "the", "b", "the"]
    assert counts.tolist() == [4, 0, 1]
    hashes, first, number = distinct(data, starts, ends)
    bucket, begin = grams(data, hashes, starts[first], ends[first], (3, 4, 5), 1 << 20)
    sizes = np.diff(np.append(begin, len(bucket)))
    assert sizes[number[1]] == 3 + 2 + 1 + 1  # of "<the>" 3, 4 and 5 long, and the word
    assert sizes[number[3]] == 1 + 1
    assert number[1] == number[2] == number[4]


EDGES = [(1, None), (2, ""), (3, "12 !? 34"), (4, "— € …"), (5, "thewhing ing the " * 20000), (6, "漢字"), (None, "the whing ou"), (8, "the the"), (8, "the the")]


def test_language(spark):
    rows = []
    for k in range(240):
        lang = R.choice(list(SYLLABLES))
        rows.append((k, prose(lang, R.randint(5, 200)), None if k % 40 == 0 else lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == 240
    right = [got[k]["lang_pred"] == lang for k, _, lang in rows if lang and is_held_out(k)]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[k]["held_out"] == is_held_out(k) and 0 <= got[k]["score"] <= 1 for k in got)
    model = language_id.train([t for _, t, x in rows if x], [x for _, _, x in rows if x])
    edge = language_id.identify(spark.createDataFrame(EDGES, "doc_id long, text string"), model=model).collect()
    assert len(edge) == len(EDGES)
    by = {r["doc_id"]: r for r in edge}
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["und"] * 4
    assert by[5]["lang_pred"] == by[None]["lang_pred"] == "aa"
    assert by[6]["lang_pred"] in SYLLABLES
    mixed = prose("aa", 40) + " " + prose("bb", 60)
    runs = language_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model=model, runs=True).first()["runs"]
    assert [r["lang"] for r in runs] == ["aa", "bb"]
    assert (runs[0]["begin"], runs[1]["end"]) == (0, len(mixed.encode()))
    assert language_id.identify(docs.limit(0)).collect() == []
    unlabelled = language_id.identify(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_scores(spark, kind):
    rows, labels = [], []
    for k in range(400):
        words = prose("aa", R.randint(20, 300)).split()
        label = int(R.random() < 0.4)
        if label and kind == "toxic":
            for _ in range(2):
                words[R.randrange(len(words))] = R.choice(["vilefoe", "vilefoes!", "VILEFOE", "vilefooe"])
        if not label and kind == "quality":
            words = [w + R.choice(["$$$", "###"]) for w in words] if k % 2 else [R.choice(words[:2]) for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, label, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "1 AS quality", "'x' AS score")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    run = toxicity.score_toxicity if kind == "toxic" else quality.score_quality
    got = {r["doc_id"]: r for r in run(docs, marks).collect()}
    right = [got[k]["predicted"] == y for k, y, _ in labels if is_held_out(k)]
    assert sum(right) >= 0.95 * len(right)
    edge = run(spark.createDataFrame(EDGES, "doc_id long, text string"), marks).collect()
    assert len(edge) == len(EDGES)
    assert all(0 <= r["score"] <= 1 for r in edge)
    assert run(docs.limit(0), marks).collect() == []
    assert {r["score"] for r in run(docs, marks.limit(0)).collect()} == {0.5}


def test_insult_in_a_long_text(spark):
    texts = [prose("aa", 100) for _ in range(300)]
    labels = np.array([k % 3 == 0 for k in range(300)], dtype=int)
    texts = [t + " vilefoe " + prose("aa", 5) if y else t for t, y in zip(texts, labels)]
    model = toxicity.train(texts, labels)
    long = prose("aa", 9000)
    got = toxicity.score_toxicity(spark.createDataFrame([(1, long), (2, long + " vilefo3e, " + long), (3, "ou " * 500)], "doc_id long, text string"), model=model).collect()
    assert [r["predicted"] for r in got] == [0, 1, 0]
    assert abs(got[1]["at_byte"] - len(long.encode())) < 200


def test_sample_is_bounded_and_exact(spark):
    """Null ids, an id that stands many times, many rows of a label, few of another, long texts only."""
    rows = spark.range(200_000).selectExpr("if(id < 100000, null, if(id < 150000, 7, id)) AS doc_id", "if(id < 100000, concat('t', id), if(id < 150000, 'same', concat('u', id))) AS text", "if(id % 2 = 0, 'a', 'b') AS kind")
    few = spark.createDataFrame([(k, "z" * 5000 + str(k), "few") for k in range(10)], "doc_id long, text string, kind string")
    texts, kinds = sample(chosen(rows.unionByName(few), "kind", ["doc_id", "text"], 20), "kind", 20, 12_000)
    assert {k: kinds.count(k) for k in set(kinds)} == {"a": 20, "b": 20, "few": 2}
    assert len(set(texts)) == len(texts) - ("same" in texts[:20] and "same" in texts[20:40])
    assert all(len(t) > 5000 for t in texts[40:])
    again = sample(chosen(rows.unionByName(few).repartition(7), "kind", ["doc_id", "text"], 20), "kind", 20, 12_000)
    assert (texts, kinds) == again


def test_labels_of_copied_and_long_documents(spark):
    docs = spark.range(50_000).selectExpr("if(id < 15000, 3L, id) AS doc_id", "if(id < 40000, 'x', repeat('long ', 300)) AS text", "0 AS toxic")
    labels = spark.range(50_000).selectExpr("id AS doc_id", "if(id >= 40000, 1, 0) AS toxic", "0 AS quality").unionByName(spark.createDataFrame([(3, 0, 0), (3, None, 0), (None, 1, 0), (3, 2, 0)], "doc_id long, toxic int, quality int"))
    texts, marks = labelled(docs, labels, "toxic", 50, 1_000_000)
    assert (marks.count(0), marks.count(1)) == (50, 50)
    assert all(len(t) == 1500 for t, y in zip(texts, marks) if y)


def test_labels_of_absent_documents(spark):
    """A thousand times as many labels of documents that are not there, or have no text, change nothing."""
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(600, 900).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', null) AS text"))
    mine = spark.range(600).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS quality")
    others = spark.range(600, 600_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    want = labelled(docs, mine, "quality", 100, 1_000_000)
    assert labelled(docs, mine.unionByName(others), "quality", 100, 1_000_000) == want
    assert (want[1].count(0), want[1].count(1)) == (100, 100)


@pytest.mark.parametrize("labelled", [False, True])
def test_no_language_to_learn(spark, labelled):
    rows = [(k, prose("aa", 20), "aa" if labelled and is_held_out(k) else None) for k in range(30)]
    none = [(100, None, None), (101, "", None), (102, "12 ?!", None)]
    docs = spark.createDataFrame(rows + none, "doc_id long, text string, lang string")
    assert sorted(map(tuple, language_id.in_a_language(docs).collect())) == rows
