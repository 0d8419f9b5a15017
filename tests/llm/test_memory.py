"""Passes need little memory beside a batch of rows, as two workers share an executor's memory with its JVM."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from logmill.llm import language_id, ngram_jaccard, packing, textkernel
from logmill.llm.textkernel import BATCH_BYTES, buffers, kept, shingles, slices, spans, word_hashes


def texts(total: int) -> list[str]:
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(5000)]
    out = []
    while total > 0:
        out.append(" ".join(r.choices(words, k=r.randint(50, 500))))
        total -= len(out[-1])
    return out


def peak(run, batches) -> tuple[int, list[pa.RecordBatch]]:
    tracemalloc.start()
    try:
        out = list(run(iter(batches)))
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_language_of_a_full_batch():
    r = np.random.default_rng(0)
    model = language_id.LanguageModel(list("abcde"), r.normal(size=(language_id.BUCKETS, 5)).astype(np.float32), np.exp(np.eye(5)))
    some = texts(BATCH_BYTES)
    some[3] = None
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["doc_id", "text"])
    most, out = peak(language_id._predict_pass(model, False), [batch])
    assert most < 40 << 20, most
    got = pa.Table.from_batches(out).to_pydict()
    assert got["doc_id"] == list(range(len(some)))
    # each text has the language it has alone
    for k in (0, 3, len(some) // 2, len(some) - 1):
        alone = next(language_id._predict_pass(model, False)(iter([batch.slice(k, 1)]))).to_pydict()
        assert alone["lang_pred"] == [got["lang_pred"][k]] and alone["n_words"] == [got["n_words"][k]]
        assert abs(alone["score"][0] - got["score"][k]) < 1e-9


def test_counts_of_repeated_shingles():
    once = texts(BATCH_BYTES)
    batch = pa.RecordBatch.from_arrays([pa.array(once + once[::2] + once[::4])], ["text"])
    # two copies of _FLUSH numbers, and not more
    most, _ = peak(ngram_jaccard._count_pass(5), [batch] * 6)
    assert most < 24 * ngram_jaccard._FLUSH, most
    out = list(ngram_jaccard._count_pass(5)(iter([batch] * 2)))
    data, offsets = buffers(batch.column(0))
    starts, ends, counts = spans(data, offsets)
    keys, n = np.unique(shingles(word_hashes(data, starts, ends), counts, 5)[0], return_counts=True)
    got = pa.Table.from_batches(out).to_pydict()
    found = {}
    for frequent, key, k in zip(got["frequent"], got["key"], got["n"]):
        if frequent:
            found[key] = found.get(key, 0) + k
    assert found == dict(zip(keys.view(np.int64).tolist(), (2 * n).tolist()))


def test_the_encoder_goes_with_its_stage():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])
    first = packing._encoder(packing.default_vocabulary())
    kept("encoder", packing._encoder.cache_clear)
    list(slices(batch, 1, keep="encoder"))
    assert packing._encoder(packing.default_vocabulary()) is first
    list(slices(batch, 1))
    assert not packing._encoder.cache_info().currsize and not textkernel._KEPT
