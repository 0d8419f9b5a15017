"""Exact n-gram Jaccard join by prefix filtering.

Shingles of a document are put in one order that all documents share, rarest
first.  Two sets that are similar enough share a shingle among the first few of
each, so only those prefixes are joined; length, positional and suffix filters
thin the candidates, and each remaining pair is verified once on whole sets.
The suffix filter bounds the distance of two sets from below by a bitmap of hash
slots, 1.5 or more for each shingle, that tells which hold an odd number of them.
Any shared order gives the same links, so rarity may be estimated: frequent
shingles by counts merged from all documents, the others by their rarest word.

A token that many documents have in their prefix is not expanded into pairs.
Its members are compared with one leader, and then only those that the leader
did not bring into its component are compared with the rest, so that the
components are exactly those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

#: Hash buckets of the word counts and most entries of the table of frequent shingles: the bounds of what is sent to executors.
WORD_BUCKETS = 1 << 17
FREQUENT = 1 << 18
#: Members of a prefix token up to which all pairs are candidates at once.
SMALL = 8
#: Most pairs of a token that are made at once, and members that meet in one block otherwise: those outside its leader's component, and all.
PAIRS, MEET, MEET_ALL = 1 << 16, 2_000, 50_000
_FLUSH = 4_000_000


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1).astype(np.float64)) * 8).astype(np.uint16)


def _count_pass(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(WORD_BUCKETS, dtype=np.int64)
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            same = np.zeros(len(values) + 1, dtype=bool)  # as the value before
            np.equal(values[1:], values[:-1], out=same[1:-1])
            first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
            return _counted(True, values[first].view(np.int64), last - first + 1)

        n = 0
        for batch in batches:
            for part in K.slices(batch, 0):
                data, offsets = K.buffers(part.column(0))
                starts, ends, counts = K.spans(data, offsets)
                hashes = K.word_hashes(data, starts, ends)
                words += np.bincount((hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=WORD_BUCKETS)
                held.append(K.shingles(hashes, counts, size)[0])
                n += len(held[-1])
                if n >= _FLUSH:
                    yield repeated()
                    n = 0
        if held:
            yield repeated()
        at = np.flatnonzero(words)
        yield _counted(False, at, words[at])

    return run


def _counted(frequent: bool, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), frequent)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["frequent", "key", "n"])


def rarity(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level of each word bucket, and the frequent shingles with their levels; of bounded size whatever the input."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_pass(size), "frequent boolean, key long, n long")
    counts = K.saved(counts.groupBy("frequent", "key").agg(F.sum("n").alias("n")).where("not frequent or n >= 8"))
    by_size = counts.where("frequent").groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    least, room = 1 << 30, FREQUENT
    for row in by_size:
        if row["rows"] > room:
            break
        least, room = row["level"], room - row["rows"]
    words = counts.where("not frequent").select("key", "n").toArrow()
    often = counts.where("frequent").where(F.floor(F.log2("n") * 8) >= int(least)).select("key", "n").toArrow()
    K.dropped(counts)
    table = np.zeros(WORD_BUCKETS, dtype=np.int64)
    table[words["key"].to_numpy()] = words["n"].to_numpy()
    keys = often["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return _level(table), keys[order], _level(often["n"].to_numpy().astype(np.int64)[order])


def _ordered_sets(text: pa.Array, size: int, order: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, rarest first, their texts' numbers and each text's count."""
    word_level, often, often_level = order
    data, offsets = K.buffers(text)
    starts, ends, counts = K.spans(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    value, owner, at = K.shingles(hashes, counts, size)
    by_word = word_level[(hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)]
    level = by_word[at]
    last = (np.cumsum(counts) - 1)[owner]
    for k in range(1, size):
        level = np.minimum(level, by_word[np.minimum(at + k, last)])
    if len(often):
        level = np.minimum(level, often_level.min())
        seen = np.zeros(1 << 22, dtype=bool)
        seen[(often >> np.uint64(42)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(value >> np.uint64(42)).astype(np.int64)])
        near = np.minimum(np.searchsorted(often, value[maybe]), len(often) - 1)
        hit = often[near] == value[maybe]
        level[maybe[hit]] = often_level[near[hit]]
    by = np.lexsort((value, (owner.astype(np.uint64) << np.uint64(16)) | level))
    value, owner = value[by], owner[by]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, owner, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def _digests(value: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = value.tobytes(), np.cumsum(sizes) * 8
    return [hashlib.blake2b(raw[e - 8 * n : e], digest_size=16).digest() for e, n in zip(ends.tolist(), sizes.tolist())]


def _sign_pass(size: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, 1):
                value, owner, sizes = _ordered_sets(part.column(1), size, order)
                keep = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
                place = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                slots = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1) * 1.5)).astype(np.int64))
                base = np.cumsum(slots) - slots
                odd = np.bincount(base[owner] + ((value >> np.uint64(20)).astype(np.int64) & (slots[owner] - 1)), minlength=int(slots.sum())) & 1
                odd = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
                first = value[place < keep[owner]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(_digests(value, sizes), pa.binary()), pa.array(sizes), K.lists(pa.array(odd), slots // 64), K.lists(pa.array(first), keep)],
                    ["doc_id", "text_hash", "digest", "n", "odd", "prefix"],
                )

    return run


def _set_pass(size: int, order, wanted: np.ndarray):
    """Whole sets of documents whose id may be wanted; those of repeated rows once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(K.falls_on(wanted, ids)))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            once = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    once.append(k)
            batch = batch.take(pa.array(once, pa.int64()))
            for part in K.slices(batch, 1):
                value, _, sizes = _ordered_sets(part.column(1), size, order)
                yield pa.RecordBatch.from_arrays([pa.array(_digests(value, sizes), pa.binary()), K.lists(pa.array(value.view(np.int64)), sizes)], ["digest", "members"])

    return run


def _post_pass(bits: np.ndarray):
    """Places of prefix tokens that fall on a set bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(2)
            sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
            values = tokens.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(K.falls_on(bits, values))
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place[keep].astype(np.int32)), pa.array(values[keep])], ["cid", "n", "place", "token"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every end of `links` (a, b): root is the smallest id that links reach.

    Large-star and small-star steps alternate until no link changes; each step
    groups and joins by key, and no component is gathered anywhere.
    """
    edges = K.saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = K.saved(small.distinct())
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        K.dropped(edges)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    return F.ceil((na + nb) * percent / (100.0 + percent) - 1e-9)


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length filter and positional filter for the first shingle that two prefixes share."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa_, nb - pb) >= _least_overlap(na, nb, percent))


def _folded(own: str, other: str) -> Column:
    """Odd slots of a set in as many as the other's: the halves of twice as many are added."""
    m = F.size(other)
    halves = F.zip_with(F.slice(own, 1, m), F.slice(own, m + 1, m), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(own) > m, halves).otherwise(F.col(own))


def _near_slots(percent: int) -> Column:
    """Suffix filter: hash slots with an odd count in one set and an even one in the other hold a shingle that only one has."""
    apart = F.aggregate(F.zip_with(_folded("odd_a", "odd_b"), _folded("odd_b", "odd_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    return apart <= F.col("n_a") + F.col("n_b") - 2 * _least_overlap(F.col("n_a"), F.col("n_b"), percent)


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int, order, classes: DataFrame) -> None:
        self.docs, self.size, self.percent, self.order, self.classes = docs, size, percent, order, classes
        self.temporary: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.temporary.append(K.saved(df))
        return self.temporary[-1]

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that link."""
        some = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        side = self.keep(K.falling(self.classes.select("cid", "doc_id", "digest", "n", "odd"), "cid", K.maybe(some, "cid")))
        for end in "ab":
            pairs = pairs.join(side.select(*(F.col(c).alias(end if c == "cid" else f"{c}_{end}") for c in side.columns)), end)
        pairs = self.keep(pairs.where(_near_slots(self.percent)).select("a", "b", "n_a", "n_b", "digest_a", "digest_b", "doc_id_a", "doc_id_b"))
        if pairs.isEmpty():
            return pairs.select("a", "b")
        ends = [pairs.select(F.col(f"doc_id_{e}").alias("doc_id")) for e in "ab"]
        table = K.maybe(ends[0].unionByName(ends[1]).distinct(), "doc_id")
        # whole sets are read again from the texts, for the documents of some pair only and without a shuffle
        sets = self.docs.where("doc_id is not null").mapInArrow(_set_pass(self.size, self.order, table), "digest binary, members array<long>")
        sets = self.keep(sets.withColumn("row", F.monotonically_increasing_id()))
        # equal sets of several rows are one: its first row is told before whole sets are joined, so that copies neither meet nor gather
        firsts = sets.groupBy("digest").agg(F.min("row").alias("row"))
        found = pairs.select("a", "b", "n_a", "n_b", "digest_a", "digest_b")
        for end in "ba":
            found = found.join(firsts.select(F.col("digest").alias(f"digest_{end}"), F.col("row").alias(f"row_{end}")), f"digest_{end}").drop(f"digest_{end}")
        for end in "ba":
            found = found.join(sets.select(F.col("row").alias(f"row_{end}"), F.col("members").alias(f"members_{end}")), f"row_{end}").drop(f"row_{end}")
        common = F.size(F.array_intersect("members_a", "members_b"))
        return found.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * self.percent).select("a", "b").distinct()


    def met(self, rooted: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of a token that are in different components, one of them outside its leader's, and that pass the filters.

        Where these are up to PAIRS, they come out if their lengths and places
        allow a link.  Members of other tokens meet in blocks of at most about MEET
        of those outside and MEET_ALL of all, so no task has a token's all pairs, and
        their odd slots are compared as they meet, so few pairs come out.
        """
        sizes = rooted.groupBy("token").agg(F.count_if("outside").alias("out"), F.count("*").alias("all")).where("out > 0")
        sizes = self.keep(sizes.select("token", (F.col("out") * F.col("all") > PAIRS).alias("large"), F.ceil(F.col("out") / MEET).alias("turns"), F.ceil(F.col("all") / MEET_ALL).alias("blocks")))
        members = self.keep(rooted.join(sizes, "token"))
        few = self._met(members.where("not large"), ["token"])
        members = members.where("large")
        if members.isEmpty():
            return few
        members = members.join(K.falling(self.classes.select("cid", "odd"), "cid", K.maybe(members.select("cid").distinct(), "cid")), "cid")
        one = members.where("outside").withColumn("turn", F.pmod(F.xxhash64("cid"), F.col("turns"))).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        other = members.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks"))).withColumn("turn", F.explode(F.expr("sequence(0L, turns - 1)")))
        return few.unionByName(self._met(one, ["token", "turn", "block"], other)).distinct()

    def _met(self, one: DataFrame, by: list[str], other: DataFrame | None = None) -> DataFrame:
        columns = ["cid", "n", "place", "root", "outside", *(["odd"] if other is not None else [])]
        other = one if other is None else other
        one = one.where("outside").select(*by, *(F.col(c).alias(f"{c}_a") for c in columns))
        both = one.join(other.select(*by, *(F.col(c).alias(f"{c}_b") for c in columns)), by)
        both = both.where((F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("cid_a") < F.col("cid_b"))))
        both = both.where(_may_link(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"), self.percent))
        if "odd" in columns:
            both = both.where(_near_slots(self.percent))
        return both.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are runs of other characters than space and TAB to CR, with A-Z
    lower-cased; a text's set holds its runs of `size` words, or all words if
    there are fewer.  Two texts link if 100 * common >= percent * all.
    component_id is the smallest id that links reach.  A null or empty text or
    one without words has no shingles and links with nothing.  Equal sets link;
    repeated rows each give a row, with the same result.  A row without an id
    gives a row without a component.  Other columns are not read.  Sets compare
    by 64-bit hashes of their shingles.
    """
    return K.written(lambda: _components_of_rows(docs, id_col, text_col, size, percent).select("doc_id", "n_shingles", "component_id"))


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """What jaccard_join() returns, a hash of each row's text, and a number for its component."""
    if not 50 <= percent <= 100:
        raise ValueError("the filters hold for 50 to 100 percent")
    docs = K.bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    order = rarity(docs, "text", size)
    signed = K.saved(docs.mapInArrow(_sign_pass(size, percent, order), "doc_id long, text_hash long, digest binary, n long, odd array<long>, prefix array<long>"))
    classes = signed.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "odd", "prefix")))
    classes = K.saved(classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    job = _Join(docs, size, percent, order, classes)

    shared = job.keep(classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("members")).where("members > 1"))
    # most tokens are one document's only: those that are not, and a few more, are joined
    posted = classes.select("cid", "n", "prefix").mapInArrow(_post_pass(K.maybe(shared, "token")), "cid long, n long, place int, token long")
    posted = job.keep(posted.join(shared, "token"))
    few = posted.where(F.col("members") <= SMALL).groupBy("token").agg(F.collect_list(F.struct("cid", "n", "place")).alias("xs"))
    few = few.select(F.explode(F.flatten(F.transform("xs", lambda x, i: F.transform(F.filter("xs", lambda y: (y["cid"] > x["cid"]) & _may_link(x["n"], x["place"], y["n"], y["place"], percent)), lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b"))))))).select("col.*")
    many = posted.where(F.col("members") > SMALL)
    leader = job.keep(many.groupBy("token").agg(F.min(F.struct("place", "cid", "n")).alias("lead")))
    star = many.join(leader, "token").where(F.col("cid") != F.col("lead.cid")).where(_may_link(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place"), percent))
    star = star.select(F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b"))
    pairs = job.keep(few.unionByName(star).distinct())
    links = job.keep(job.verified(pairs))
    roots = K.saved(components(links))

    rooted = many.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    at = leader.select("token", F.col("lead.cid").alias("cid")).join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("token", F.coalesce("root", "cid").alias("lead_root"))
    rooted = job.keep(rooted.join(at, "token").select("token", "cid", "n", "place", "root", (F.col("root") != F.col("lead_root")).alias("outside")))
    rest = job.keep(job.met(rooted).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = job.keep(job.verified(rest))
        if not more.isEmpty():
            K.dropped(roots)
            roots = K.saved(components(links.unionByName(more)))
    named = classes.select("cid", "digest", "doc_id").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = K.saved(named.join(least, "root").select("digest", "component_id", "root"))
    K.dropped(roots, classes, *job.temporary)
    out = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    return out.select("doc_id", "text_hash", "root", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` whose id is the smallest of their component.

    Of repeated rows one stays, as does one of several near copies under one id;
    rows that share an id but are no near copies stay.  A row without shingles is
    alone with its id; rows without an id stay.  Other columns pass, whatever
    their names.
    """
    def make() -> DataFrame:
        rows = _components_of_rows(docs, id_col, text_col, size, percent).where("doc_id is not null").groupBy("doc_id", "text_hash")
        return rows.agg(F.count("*").alias("n"), F.min(F.col("doc_id") == F.col("component_id")).alias("first"), F.max("root").alias("root"))

    rows = K.written(make)
    marked = rows.where("n > 1 or not first").select("doc_id", "text_hash", (~F.col("first")).alias("goes"))
    # of several texts of a component that are under its smallest id, that of the smallest hash stays
    firsts = rows.where("first and root is not null")
    rivals = firsts.groupBy("doc_id", "root").agg(F.min("text_hash").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    rivals = firsts.join(rivals, ["doc_id", "root"]).where("text_hash <> kept").select("doc_id", "text_hash", F.lit(True).alias("goes"))
    return K.without(docs, id_col, marked.unionByName(rivals).withColumnsRenamed({"doc_id": "marked_id", "text_hash": "marked_text"}), text_col)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90)
