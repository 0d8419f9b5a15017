import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from logmill.llm.packing import _Packer, default_vocabulary, pack


def test_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    alphabet = ["the", "Straße", "ÉÈ", "don't", "x1y22", "—!!", " ", "́", "", "naïve b", "漢字", "<|endoftext|>", "İ", "a\x1cb", "J̌", "'VE", "Å", "가", "×2", "x\u00a0y", "&&&|"]
    rows = [(k, r.choice([" ", "\n", "  ", "\t"]).join(r.choices(alphabet, k=r.choice([0, 1, 7, 300, 3000])))) for k in range(60)]
    rows += [(100, None), (101, ""), (101, ""), (None, "no id"), (102, "w" * 20000), (103, "of the " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS start", "'x' AS ids")
    got = pack(docs, default_vocabulary()).collect()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        assert x["doc_tokens"] == len(want[x["doc_id"]])
        assert np.frombuffer(x["ids"], "<u4").tolist() == want[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        pieces[x["doc_id"]].append((x["start"], x["length"]))
        sequences[x["sequence_id"]].append((x["offset"], x["length"], x["tier"]))
    for k, ids in want.items():
        times = 2 if k == 101 else 1
        assert sum(n for _, n in pieces[k]) == times * len(ids)
    for s in sequences.values():
        at = 0
        for offset, n, tier in sorted(s):
            assert offset == at
            at += n
        assert at == tier <= 4096
        assert not tier & (tier - 1)
    assert sum(n for p in pieces.values() for _, n in p) == sum(map(len, want.values())) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), default_vocabulary()).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_all_sequences_are_full(seed):
    r = random.Random(seed)
    packer, out, sizes = _Packer((512, 1024, 2048, 4096)), [], []
    for k in range(400):
        sizes.append(int(r.paretovariate(0.8) * 50) + 1)
        out += packer.add(k, sizes[-1])
        if k % 90 == 0:
            out += packer.sequences(False)
    out += packer.sequences(True)
    seen = defaultdict(set)
    for s in out:
        n = sum(p[2] for p in s)
        assert n <= 4096
        assert not n & (n - 1)
        for doc, start, length in s:
            piece = set(range(start, start + length))
            assert not piece & seen[doc]
            seen[doc] |= piece
    assert all(seen[k] == set(range(n)) for k, n in enumerate(sizes))
    assert sum(sum(p[2] for p in s) < 512 for s in out) <= 10
