"""The pipeline's stages against plain versions, on a small table with planted cases."""

import random

import pytest

import corpus_pipeline
from logmill.llm.decontamination import clean
from logmill.llm.language_id import in_a_language
from logmill.llm.ngram_jaccard import first_of_each
from logmill.llm.pii import EXAMPLE_KEY, Pseudonyms, luhn, without_pii
from logmill.llm.textkernel import saved, without, written

SYLLABLES = {"aa": ["the", "ing", "wh", "ou", "an"], "bb": ["sch", "ung", "ich", "ß", "ver"]}


def rows_and_items():
    r = random.Random(11)
    prose = lambda lang, n: ["".join(r.choices(SYLLABLES[lang], k=r.randint(2, 5))) for _ in range(n)]
    items = [(k, " ".join(prose("aa", 30))) for k in range(5)]
    rows, kind = [], {}
    for k in range(0, 300, 3):
        lang = r.choice("ab") * 2
        words = prose(lang, r.randint(80, 300))
        body = "".join(r.choices("0123456789", k=15))
        if k % 7 == 0:
            words.insert(5, body + str(luhn(body)))
        kind[k] = "clean"
        if k % 10 == 0:
            words[10:10] = r.choice(items)[1].split()
            kind[k] = "leak"
        rows.append((k, " ".join(words), lang if k % 9 else None, f"s{k % 4}", len(" ".join(words))))
        if k % 4 == 0:
            copy = list(words)
            copy[len(copy) // 2] = "changed"
            rows.append((k + 1, " ".join(copy), lang, "copy", 1))
            kind[k + 1] = "copy"
    for k, text in enumerate(["12 34", "", None, "?!"]):
        rows.append((1000 + k, text, None, "s", 0))
        kind[1000 + k] = "none"
    return rows, items, kind


def test_stages(spark, tmp_path):
    rows, items, kind = rows_and_items()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.conf.set(corpus_pipeline.PII_KEY, "a key of the test")
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after[name])
    assert set(after["language"]) == {k for k, v in kind.items() if v != "none"}
    assert all(r["lang"] in SYLLABLES for r in after["language"].values())
    assert set(after["near_duplicates"]) == {k for k, v in kind.items() if v in ("clean", "leak")}
    assert set(after["benchmark"]) == set(after["personal_data"]) == {k for k, v in kind.items() if v == "clean"}
    plain = Pseudonyms(b"a key of the test")
    texts = {k: t for k, t, *_ in rows}
    for k, r in after["personal_data"].items():
        assert r["text"] == plain.replaced(texts[k], [])
        assert (r["source"], r["n_chars"]) == (after["language"][k]["source"], after["language"][k]["n_chars"])
    direct = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    whole = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, whole))
    assert {r["doc_id"] for r in whole} == set(after["personal_data"])


@pytest.mark.parametrize("n", [0, 50])
def test_without(spark, n):
    rows = [(k % 40 if k % 11 else None, f"t{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame([(k, k % 2 == 0) for k in range(0, min(n, 20))], "marked_id long, goes boolean")
    got = without(docs, "doc_id", marked).collect()
    ids = [k for k, _ in rows]
    for k in set(ids):
        want = ids.count(k) if k is None or k >= min(n, 20) else 0 if k % 2 == 0 else 1
        assert sum(r["doc_id"] == k for r in got) == want


ODD = {"goes": "1", "marked_id": "'x'", "marked_text": "2L", "__id": "3", "id": "4", "__0": "5", "a.b": "6", "kinds": "array('k')", "score": "0.5D", "token": "'t'", "wide": "named_struct(" + ",".join(f"'f{k}',{k}" for k in range(40)) + ")"}


def odd_rows(spark):
    """Repeated rows, ids and texts, nulls, empty texts, a long one, and columns of names that are used inside."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices(SYLLABLES["aa"], k=3)) for _ in range(n))
    a, b, c, long = prose(60), prose(60), prose(60), prose(40_000)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(1, a), (1, a), (2, a), (3, near), (4, b), (4, c), (5, c), (6, None), (6, None), (7, ""), (None, a), (None, a), (None, None), (8, long), (9, long), (10, "two words"), (11, b), (11, a), (12, near), (12, near + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "'aa' AS lang", *(f"{v} AS `{k}`" for k, v in ODD.items()))
    return docs, {"a": a, "b": b, "c": c, "near": near, "long": long}


def test_odd_columns_and_rows(spark):
    docs, t = odd_rows(spark)
    items = spark.createDataFrame([(1, t["b"]), (None, t["a"]), (2, None), (3, "")], "item_id long, text string").selectExpr("*", "1 AS goes")
    stages = {"language": in_a_language, "near": first_of_each, "benchmark": lambda d: clean(d, items), "pii": lambda d: without_pii(d, b"key")}
    got = {}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got[name] = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
        assert all(x["a.b"] == 6 and x["goes"] == 1 for x in out.collect())
        assert stage(docs.limit(0)).collect() == []
    every = sorted(((x["doc_id"], x["text"]) for x in docs.collect()), key=str)
    assert got["pii"] == every
    assert got["language"] == [x for x in every if x[1]]
    assert got["benchmark"] == [x for x in every if x[0] is None or x[1] != t["b"]]
    # 4 and 11 hold unlike texts: b and c of 4 are the first of their kind, and so is neither text of 11
    assert got["near"] == sorted([(1, t["a"]), (4, t["b"]), (4, t["c"]), (6, None), (7, ""), (None, t["a"]), (None, t["a"]), (None, None), (8, t["long"]), (10, "two words")], key=str)


def test_written_deletes_what_was_saved_on_the_way(spark, tmp_path):
    inner = []

    def make():
        inner.append(saved(spark.range(5)))
        return inner[0].where("id > 2")

    out = written(make)
    assert out.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(inner[0]._saved_at).count()


def test_the_example_key_is_refused(spark):
    with pytest.raises(ValueError, match="example key"):
        without_pii(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), EXAMPLE_KEY)
