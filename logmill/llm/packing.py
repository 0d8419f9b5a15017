"""Hierarchical multi-length packing of tokenised documents.

A document is cut into whole windows of the longest tier and one remainder,
which is routed to the shortest tier that holds it.  Tiers are packed from the
longest to the shortest: each sequence begins with a document of its own tier,
takes the longest documents that still fit from any shorter tier, and closes
its last gap with the head of one more document, whose tail goes back to its
new tier.  So each sequence is full.  What is left when a task ends is cut at
powers of two, which need no padding.  Each task packs the documents of its own
input split, a bounded number of tokens at a time: nothing is shuffled.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import wordmodel as M

TIERS = (512, 1024, 2048, 4096)
#: Tokens that are held and packed at once, and parts of words whose ids a worker remembers.
GROUP_TOKENS = 1_000_000
REMEMBERED = 1 << 20
#: Bytes of text that are encoded at once.
_PART = 500_000
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Parts | _Whole:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    form = json.loads(tokenizer.to_str())
    parted = [form["normalizer"], form["pre_tokenizer"]] == _PARTED and form["model"].get("end_of_word_suffix")
    return _Parts(tokenizer, form) if parted else _Whole(tokenizer)


# The normalizer and the splits of tokenizers that drop white space and part words into letters, single digits and signs.
_PARTED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: Kinds of bytes in words that the parts of such a tokenizer can be told of byte by byte: white space, letters, digits, signs; 4 is any other, as are apostrophe (contractions) and bar (names of special tokens).
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[K.SEPARATOR], _KIND[0x21:0x7F], _KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B] = 0, 3, 2, 1, 1
_KIND[[0x27, 0x7C]] = 4
_TOGETHER = 500


class _Whole:
    """Ids of texts by a tokenizer of any kind, text by text."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        raw, at = data.tobytes(), offsets.tolist()
        got = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *got]), np.array([len(x) for x in got], dtype=np.int64)


class _Parts:
    """Ids of texts by a tokenizer that treats the parts of words apart: a part is looked up by a 64-bit hash, and encoded once if it is new.

    Words of ASCII and accented Latin-1 letters, digits and signs fall into
    parts byte by byte; any other word is a part of its own, in the case it has.
    New parts are encoded many at a time: the last id of a part is one of those
    that end a part, so the ids fall back into parts.
    """

    def __init__(self, tokenizer, form: dict) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer
        suffix = form["model"]["end_of_word_suffix"]
        self.closing = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        for token, k in tokenizer.get_vocab().items():
            self.closing[k] = token.endswith(suffix)
        # parts are in lower case and composed already, and blanks part them
        bytewise = form["pre_tokenizer"]["pretokenizers"][-1]
        self.plain = Tokenizer.from_str(json.dumps(form | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytewise]}}))
        self._forget()

    def _forget(self) -> None:
        """An empty open hash table: the number of the entry in each slot, and entries' hash, first id and number of ids."""
        self.slots = np.full(4 * REMEMBERED, -1, dtype=np.int32)
        self.entries, self.held = 0, 0
        self.hash = np.zeros(2 * REMEMBERED, dtype=np.uint64)
        self.begin, self.size = np.zeros(2 * REMEMBERED, dtype=np.int64), np.zeros(2 * REMEMBERED, dtype=np.int64)
        self.flat = np.zeros(1 << 20, dtype="<u4")

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out, left, at = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            entry = self.slots[at].astype(np.int64)
            same = (entry >= 0) & (self.hash[entry] == hashes[left])
            out[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, at = left[on], (at[on] + 1) % len(self.slots)
        return out

    def _insert(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        new = np.arange(self.entries, self.entries + len(hashes))
        while 2 * (self.entries + len(hashes)) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int32)
            self._place(np.arange(self.entries))
        while self.held + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.held : self.held + len(ids)] = ids
        if new[-1] >= len(self.hash):  # one slice has more new parts than there is room for
            more = np.zeros(len(hashes), dtype=np.uint64)
            self.hash, self.begin, self.size = np.append(self.hash, more), np.append(self.begin, more.view(np.int64)), np.append(self.size, more.view(np.int64))
        self.hash[new], self.begin[new], self.size[new] = hashes, self.held + np.cumsum(sizes) - sizes, sizes
        self.entries, self.held = self.entries + len(hashes), self.held + len(ids)
        self._place(new)

    def _place(self, new: np.ndarray) -> None:
        at = self._slot(self.hash[new])
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            on = self.slots[at] != new
            new, at = new[on], (at[on] + 1) % len(self.slots)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after the other, and how many each has."""
        raw, sizes = data.tobytes(), np.zeros(len(starts), dtype=np.int64)
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        got: list[np.ndarray] = []
        order: list[np.ndarray] = []
        other = [np.flatnonzero(~plain)]
        some = np.flatnonzero(plain)
        for at in (some[k : k + _TOGETHER] for k in range(0, len(some), _TOGETHER)):
            ids = np.array(self.plain.encode_batch_fast([" ".join([words[k] for k in at])], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.closing[ids]) + 1
            if len(last) != len(at) or last[-1] != len(ids):
                other.append(at)
                continue
            sizes[at] = np.diff(last, prepend=0)
            got.append(ids)
            order.append(at)
        at = np.concatenate(other)
        each = [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast([words[k] for k in at], add_special_tokens=False)]
        sizes[at] = [len(x) for x in each]
        order = np.concatenate([*order, at])
        return order, np.concatenate([np.zeros(0, "<u4"), *got, *each]), sizes[order]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        starts, ends, counts = K.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), counts
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(lead + 1 < len(data))]
        after = data[lead + 1]
        lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        odd = np.zeros(len(starts), dtype=bool)
        odd[np.searchsorted(starts, np.flatnonzero(kind == 4), "right") - 1] = True
        lower = M.lowered(data)
        at = np.flatnonzero(odd)
        n = (ends - starts)[at]
        inside = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lower[inside] = data[inside]
        # a part begins where the kind changes and at each digit; in odd words only at their begin
        opens = np.zeros(len(data), dtype=bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        opens[kind == 0] = False
        opens[inside] = False
        opens[starts] = True
        begin = np.flatnonzero(opens)
        word = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), ends[word])
        hashes = K.word_hashes(lower, begin, end, lower=False)
        if self.entries > REMEMBERED:
            self._forget()
        entry = self._find(hashes)
        fresh, first = np.unique(hashes[entry < 0], return_index=True)
        if len(fresh):
            first = np.flatnonzero(entry < 0)[first]
            order, ids, sizes = self._learn(lower, begin[first], end[first], ~odd[word[first]])
            self._insert(fresh[order], ids, sizes)
            entry = self._find(hashes)
        sizes = self.size[entry]
        done = np.cumsum(sizes)
        out = self.flat[np.repeat(self.begin[entry] - (done - sizes), sizes) + np.arange(done[-1])]
        before = np.concatenate([[0], done])[np.searchsorted(begin, offsets)]
        return out, np.diff(before)


class _Packer:
    """Cuts documents into pieces (document, start, length) and these into full sequences."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers, self.longest = tiers, tiers[-1]
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, doc: int, length: int) -> list[list[tuple[int, int, int]]]:
        whole = length // self.longest
        if length % self.longest:
            insort(self.pool, (length % self.longest, doc, whole * self.longest))
        return [[(doc, k * self.longest, self.longest)] for k in range(whole)]

    def sequences(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        for tier, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
            while self.pool and self.pool[-1][0] > below:
                taken, gap = [], tier
                while self.pool and gap:
                    k = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
                    if k >= 0:
                        length, doc, start = self.pool.pop(k)
                    else:
                        length, doc, start = self.pool.pop(0)
                        insort(self.pool, (length - gap, doc, start + gap))
                        length = gap
                    taken.append((doc, start, length))
                    gap -= length
                if gap:
                    if last:
                        yield from _powers_of_two(taken)
                    else:
                        self.pool = sorted((length, doc, start) for doc, start, length in taken)
                        return
                else:
                    yield taken


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    left = sum(p[2] for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, length = pieces.pop()
            if length > room:
                pieces.append((doc, start + room, length - room))
                length = room
            out.append((doc, start, length))
            room -= length
        yield out


def _steps(lengths: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence: the longest first, always to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, -(-sum(lengths) // step_tokens)))]
    heapify(groups)
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        held, g = groups[0]
        out[k] = g
        heapreplace(groups, (held + lengths[k], g))
    return out


def _pack_pass(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        encoder, packer = _encoder(path), _Packer(tiers)
        K.kept("encoder", _encoder.cache_clear)
        docs: dict[int, tuple[int | None, np.ndarray]] = {}  # id and ids of documents that are not all packed yet
        n_docs = n_sequences = n_steps = held = 0
        ready: list[list[tuple[int, int, int]]] = []

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal n_sequences, n_steps
            full = ready + list(packer.sequences(last))
            ready.clear()
            lengths = [sum(p[2] for p in s) for s in full]
            steps = _steps(lengths, step_tokens)
            rows = []
            for s, length, step in zip(full, lengths, steps):
                offset = 0
                for doc, start, n in s:
                    doc_id, ids = docs[doc]
                    rows.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), base + n_sequences, offset, length, base + n_steps + step))
                    offset += n
                n_sequences += 1
            n_steps += max(steps, default=-1) + 1
            open_docs = {p[1] for p in packer.pool}
            for doc in [d for d in docs if d not in open_docs]:
                del docs[doc]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            for part in K.slices(batch, 1, _PART, keep="encoder"):
                ids, sizes = encoder.ids(*K.buffers(part.column(1)))
                at = [0, *np.cumsum(sizes).tolist()]
                for doc_id, a, b in zip(part.column(0).to_pylist(), at, at[1:]):
                    docs[n_docs] = (doc_id, np.concatenate([ids[a:b], end]))
                    held += b - a + 1
                    ready += packer.add(n_docs, b - a + 1)
                    n_docs += 1
                    if held >= GROUP_TOKENS:
                        yield emit(False)
                        held = 0
        yield emit(True)

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 32768) -> DataFrame:
    """Pieces of all documents, packed into sequences: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset, tier, step_group.

    A document's ids are those of the tokenizer file `vocabulary` and `end_id`;
    a null text is empty, and so a document of one token.  tier is the length of
    the sequence: one of `tiers`, or for what is left at a task's end a smaller
    power of two.  A step group holds about step_tokens tokens of sequences.
    Rows without an id and repeated rows are documents of their own.  Other
    columns are not read; an empty table gives no pieces.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pack_pass(vocabulary, end_id, tiers, step_tokens), _SCHEMA)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
