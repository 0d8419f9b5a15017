import random
import re
from itertools import permutations

from logmill.llm.filter_audit import audit

SCHEMA = "doc_id long, lang string, text string"


def fails(rows):
    """What each row fails, by the conditions themselves."""
    out = []
    for k, _, text in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        copy = k is not None and any(i is not None and i < k and (t or "") == text for i, _, t in rows)
        tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        out.append({f for f, t in zip("ABCDE", tests) if t})
    return out


def brute(rows, labels):
    """Applies all orders to the rows one after the other."""
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    failed, out = fails(rows), {}
    for part in {p or "" for _, p, _ in rows}:
        mine = [(k, f) for (k, p, _), f in zip(rows, failed) if (p or "") == part]
        total = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, before = [r for r in left if f in r[1]], len(left)
                left = [r for r in left if f not in r[1]]
                total[f] = total.get(f, 0) + len(gone)
                redundant = sum(f in x for _, x in mine) - (before - len(left))
                out[part, order, step] = [len(left), len(gone), redundant, sum(x == {f} for _, x in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "ñandú", "字"]
    texts = [None, "", " \t\n"]
    for _ in range(60):
        text = [r.choice(words[: r.choice([40, 300, 303])]) for _ in range(r.choice([1, 99, 100, 140]))]
        text = [w.upper() + "QQ" if r.random() < 0.3 else w for w in text] if r.random() < 0.4 else text
        texts.append(r.choice([" ", "\v", "\n\t"]).join(text) + r.choice(["", "", " a&b", "|"]))
    rows = [(k * 37 % 101, r.choice(["de", "en", None, ""]), r.choice(texts)) for k in range(140)]
    return rows


def test_brute_force(spark):
    rows = corpus(1) + [(500, "en", "one text"), (500, "en", "one text"), (500, "fr", "another"), (501, "en", "one text"), (None, "en", "one text"), (None, "xx", None)]
    labels = [(k, k % 2, k % 3 == 0 and 1) for k in range(90)] + [(3, 1, 1), (3, 0, None), (None, 1, 1), (500, None, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS n", "true AS E", "1 AS part")
    got = audit(docs, spark.createDataFrame([(k, int(q) if q is not None else None, int(t) if t is not None else None) for k, q, t in labels], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS lang"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = got.collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 5
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want


def test_hot_copies_and_empty(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'en' AS lang", "IF(id % 3 = 0, 'same', cast(id as string)) AS text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (row["kept"], row["removed"], row["unique_fails"]) == (2000 - 666, 666, 0)
    assert audit(docs.limit(0), labels).collect() == []
