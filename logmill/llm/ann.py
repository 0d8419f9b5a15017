"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split by balanced clustering, level by level, into lists of
about equal size.  A vector goes into the list of its nearest centroid, and near
a boundary also into others about as near, unless a centroid that already has it
lies between.  Centroids are searched through a neighbour graph in memory.  A
query opens the lists whose centroids are nearly as near as the nearest; how
nearly, and how near to a boundary copies are worth their place, is learned from
the sample's own neighbours, so that the recall holds whether the vectors are
clustered or not.  A query is compared with the entries of the lists it opens and
no others, exactly and in double precision; small lists that lie side by side are
searched by one task, large ones in blocks.

Equal vectors are one entry with its smallest ids, as many as a result can hold;
so copies in any number neither fill a list nor hide other neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as K

#: Most lists, vectors of a list where that allows it, and vectors that the centroids are learned from, at least and for each list.
MOST_LISTS, LIST = 32_768, 64
SAMPLE, SAMPLE_A_LIST = 20_000, 4
#: A vector enters at most so many lists, no farther than a ratio of the nearest centroid's distance, one of these, and none whose centroid lies within this share of its distance from one that has the vector.
COPIES, BOUNDARIES, APART = 2, (1.003, 1.02, 1.1), 0.4
#: Share of sampled neighbours that the learned pruning ratio reaches, queries that it is learned from, and least entries of the lists that a query opens.
REACH, TRIED, LEAST_ENTRIES = 0.95, 300, 400
#: Most entries of a block and queries that meet them in a task.
BLOCK = 2048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, size: int, seed: int = 0, ways: int = 8) -> np.ndarray:
    """Centroids of groups of at most about `size` rows: each larger group is split by k-means that weighs group sizes, until none is."""
    r = np.random.default_rng(seed)
    waiting, out = [np.arange(len(x))], []
    while waiting:
        rows = waiting.pop()
        part = x[rows]
        k = int(min(ways, -(-len(rows) // size)))
        if k <= 1 or (part == part[0]).all():
            out.append(part.mean(axis=0))
            continue
        centers = part[r.choice(len(part), k, replace=False)]
        penalty = np.zeros(k)
        for step in range(10):
            d = _distances(part, centers)
            group = (d + penalty * d.mean()).argmin(axis=1)
            n = np.bincount(group, minlength=k)
            penalty = np.maximum(penalty + 0.3 * (n / len(part) * k - 1), 0) if step < 8 else penalty
            for g in np.flatnonzero(n):
                centers[g] = part[group == g].mean(axis=0)
        n = np.bincount(group, minlength=k)
        if n.max() == len(part):  # all in one: part them by their order along the widest axis
            order = np.argsort(part[:, part.std(axis=0).argmax()], kind="stable")
            group[order] = np.arange(len(part)) * k // len(part)
        waiting += [rows[group == g] for g in range(k) if (group == g).any()]
    return np.array(out)


@dataclass
class CentroidGraph:
    """Centroids with links to their nearest ones, both ways, and some to begin at."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, degree: int = 12, entries: int = 16, seed: int = 0) -> CentroidGraph:
        n = len(points)
        degree = min(degree, n - 1)
        if degree < 1:
            return cls(points, np.zeros((n, 0), dtype=np.int64), np.arange(n))
        links = np.empty((n, 2 * degree), dtype=np.int64)
        incoming: list[list[int]] = [[] for _ in range(n)]
        for first in range(0, n, 1024):
            d = _distances(points[first : first + 1024], points)
            d[np.arange(len(d)), np.arange(first, first + len(d))] = np.inf
            near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            links[first : first + len(d), :degree] = near
            for k, row in enumerate(near.tolist()):
                for j in row:
                    incoming[j].append(first + k)
        for k in range(n):
            back = (incoming[k] + links[k, :degree].tolist())[:degree]
            links[k, degree:] = back
        return cls(points, links, np.sort(np.random.default_rng(seed).choice(n, min(entries, n), replace=False)))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the centroids found nearest, nearest first, and their distances; best-first walks, all queries abreast."""
        n, beam = len(queries), min(beam, len(self.points))
        width = max(beam, len(self.entries))
        norms = (self.points * self.points).sum(axis=1)
        own = (queries * queries).sum(axis=1)
        seen = np.zeros((n, len(self.points)), dtype=bool)
        seen[:, self.entries] = True
        found, far, opened = np.zeros((n, width), dtype=np.int64), np.full((n, width), np.inf), np.zeros((n, width), dtype=bool)
        found[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = _distances(queries, self.points[self.entries])
        live = np.arange(n)
        for _ in range(len(self.points)):
            if not self.links.shape[1]:
                break
            d = np.where(opened[live], np.inf, far[live])
            pick = d.argmin(axis=1)
            limit = np.partition(far[live], beam - 1, axis=1)[:, beam - 1]
            go = d[np.arange(len(live)), pick] <= limit
            go &= np.isfinite(d[np.arange(len(live)), pick])
            live, pick = live[go], pick[go]
            if not len(live):
                break
            opened[live, pick] = True
            next_to = self.links[found[live, pick]]
            new = ~seen[live[:, None], next_to]
            seen[live[:, None], next_to] = True
            # a link may stand twice in a row: its second is not new
            order = np.argsort(next_to, axis=1, kind="stable")
            twice = np.zeros_like(new)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(next_to, order, axis=1), axis=1) == 0, axis=1)
            new &= ~twice
            to = np.einsum("qd,qkd->qk", queries[live], self.points[next_to])
            value = np.where(new, np.maximum(own[live][:, None] + norms[next_to] - 2 * to, 0), np.inf)
            all_far = np.concatenate([far[live], value], axis=1)
            keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            far[live] = np.take_along_axis(all_far, keep, axis=1)
            found[live] = np.take_along_axis(np.concatenate([found[live], next_to], axis=1), keep, axis=1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(next_to.shape, dtype=bool)], axis=1), keep, axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(found, order, axis=1), np.sqrt(np.take_along_axis(far, order, axis=1))


def postings(graph: CentroidGraph, boundary: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each entry: nearest centroid, and boundary copies."""
    return _postings(graph, boundary, *graph.search(x, 8))


def _postings(graph: CentroidGraph, boundary: float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    taken = np.zeros(near.shape, dtype=bool)
    taken[:, 0] = True
    for j in range(1, near.shape[1]):
        ok = (far[:, j] <= boundary * far[:, 0]) & (taken.sum(axis=1) < COPIES)
        for i in range(j):
            between = ((graph.points[near[:, i]] - graph.points[near[:, j]]) ** 2).sum(axis=1)
            ok &= ~(taken[:, i] & (between < (APART * far[:, j]) ** 2))
        taken[:, j] = ok
    rows, column = np.nonzero(taken)
    return rows, near[rows, column]


def learned(graph: CentroidGraph, x: np.ndarray, k: int) -> tuple[float, float, int]:
    """The boundary, the ratio of centroid distances, and most lists opened within it, that reach REACH of the k nearest of a sample's rows with the fewest entries compared.

    In the sample the k nearest lie farther off than among all rows, so the ratio errs to the safe side.
    """
    x = x[:: -(-len(x) // SAMPLE)]
    tried = x[:: max(1, len(x) // TRIED)]
    near = np.concatenate([np.argpartition(_distances(some, x), min(k, len(x) - 1), axis=1)[:, : k + 1] for some in np.array_split(tried, -(-len(tried) // 32))])
    far = np.sqrt(_distances(tried, graph.points))
    far /= np.maximum(far.min(axis=1), 1e-12)[:, None]
    found = [graph.search(some, 8) for some in np.array_split(x, -(-len(x) // 500))]
    rank = np.empty(far.shape, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(far, axis=1, kind="stable"), np.broadcast_to(np.arange(far.shape[1]), far.shape), axis=1)
    best = None
    for boundary in BOUNDARIES:
        rows, lists = _postings(graph, boundary, np.concatenate([n for n, _ in found]), np.concatenate([d for _, d in found]))
        order = np.argsort(rows, kind="stable")
        first = np.searchsorted(rows[order], np.arange(len(x) + 1))
        sizes = np.bincount(lists, minlength=len(graph.points))
        held = [(q, lists[order[first[j] : first[j + 1]]]) for q in range(len(tried)) for j in near[q]]
        needed = np.array([far[q, some].min() for q, some in held])
        place = np.array([rank[q, some].min() for q, some in held])
        for level in np.linspace(REACH, 1 - (1 - REACH) / 5, 9):
            ratio = float(np.quantile(needed, level)) + 1e-9
            places = np.sort(np.where(needed <= ratio, place, len(graph.points)))
            most = min(len(graph.points), int(places[int(np.ceil(REACH * len(places))) - 1]) + 1)
            work = float((((far <= ratio) & (rank < most)) * sizes).sum())
            if best is None or work < best[0]:
                best = work, boundary, ratio, most
    return best[1:]


def probes(graph: CentroidGraph, sizes: np.ndarray, ratio: float, most: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each query opens: the `most` nearest within the ratio, and more where these hold too few entries."""
    beam = min(len(sizes), max(16, most))
    while True:
        near, far = graph.search(x, beam)
        before = np.cumsum(sizes[near], axis=1) - sizes[near]
        few = before < LEAST_ENTRIES
        if beam >= len(sizes) or not few[:, -1].any():
            break
        beam = min(len(sizes), 2 * beam)
    rows, column = np.nonzero((far <= ratio * far[:, :1]) & (np.arange(beam) < most) | few)
    return rows, near[rows, column]


def share_compared(graph: CentroidGraph, sizes: np.ndarray, ratio: float, most: int, x: np.ndarray, n: int) -> float:
    """Entries that a query is compared with, against all n, over the queries x."""
    return float(sizes[probes(graph, sizes, ratio, most, x)[1]].sum() / (len(x) * n))


def bundled(sizes: np.ndarray) -> np.ndarray:
    """The bundle of each list: neighbours in the order of clustering, about BLOCK entries together."""
    out, bundle, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            bundle, held = bundle + 1, 0
        out[k] = bundle
        held += n
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _posted_pass(graph: CentroidGraph, boundary: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows, lists = postings(graph, boundary, _matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *(c.take(pa.array(rows)) for c in part.columns)], ["list", *part.schema.names])

    return run


def _probe_pass(graph: CentroidGraph, sizes: np.ndarray, ratio: float, most: int, bundles: np.ndarray):
    """A row for each query and bundle, with the lists of the bundle that the query opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows, lists = probes(graph, sizes, ratio, most, _matrix(part.column(1)))
                order = np.lexsort((lists, bundles[lists], rows))
                rows, lists = rows[order], lists[order]
                new = np.ones(len(rows), dtype=bool)
                new[1:] = (rows[1:] != rows[:-1]) | (bundles[lists[1:]] != bundles[lists[:-1]])
                at = np.flatnonzero(new)
                opened = K.lists(pa.array(lists.astype(np.int32)), np.diff(np.append(at, len(rows))))
                yield pa.RecordBatch.from_arrays([pa.array(bundles[lists[at]].astype(np.int32)), opened, *(c.take(pa.array(rows[at])) for c in part.columns)], ["bundle", "lists", *part.schema.names])

    return run


def _nearest(k: int):
    """Of a block's entries the k nearest to each query among those of the lists it opens, with all that tie with the last but for rounding."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "far": [], "ids": []}
        if len(queries) and len(entries):
            # an entry may stand in several lists of the block
            _, at, place = np.unique(entries["entry"].to_numpy(), return_index=True, return_inverse=True)
            x, ids = np.stack(entries["vector"].to_numpy()[at]).astype(np.float64), entries["ids"].to_numpy()[at]
            least = np.array([i[0] for i in ids])
            of = entries["list"].to_numpy()
            members = {n: place[of == n] for n in np.unique(of).tolist()}
            for first in range(0, len(queries), 256):
                some = queries.iloc[first : first + 256]
                q = np.stack(some["vector"].to_numpy()).astype(np.float64)
                opens: dict[int, list[int]] = {}
                for n, lists in enumerate(some["lists"]):
                    for j in lists:
                        opens.setdefault(int(j), []).append(n)
                d = np.full((len(q), len(x)), np.inf)
                for j, n in opens.items():
                    if j in members:
                        d[np.ix_(n, members[j])] = _distances(q[n], x[members[j]])
                edge = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
                edge = edge * (1 + 1e-9) + 1e-9 * (q * q).sum(axis=1)
                for n, query in enumerate(some["query"]):
                    at = np.flatnonzero((d[n] <= edge[n]) & (d[n] < np.inf))
                    far = np.sqrt(((x[at] - q[n]) ** 2).sum(axis=1))
                    by = np.lexsort((least[at], far))[:k]
                    out["query"] += [int(query)] * len(by)
                    out["far"] += far[by].tolist()
                    out["ids"] += [list(ids[j]) for j in at[by]]
        return pd.DataFrame({"query": pd.array(out["query"], dtype="int64"), "far": pd.array(out["far"], dtype="float64"), "ids": pd.Series(out["ids"], dtype="object")})

    return run


def _usable(column: Column) -> Column:
    ok = F.forall(column, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return column.isNotNull() & ok & F.exists(column, lambda v: v != 0)


def search(vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, seed: int = 0) -> DataFrame:
    """The k nearest found of each query row among all other rows: query_id, rank, vec_id, score.

    Queries are rows for which `is_query`, over a column vec_id, holds (default:
    the id is divisible by 100).  score is the Euclidean distance in double
    precision; ties go to the smaller id.  Rows without an id, or whose vector is
    null, empty, zero, or holds nulls or non-finite numbers, take no part, nor do
    vectors of another length than the most frequent (ties: the shorter).  Equal
    rows count once; if an id has several vectors, the nearest counts.  Other
    columns are not read.
    """
    is_query = F.pmod(F.col("vec_id"), F.lit(100)) == 0 if is_query is None else is_query
    return K.written(lambda: _found(vectors, is_query, id_col, vector_col, k, seed))


def _found(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, seed: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if length is None:
        return spark.createDataFrame([], schema)
    # 0.0 + takes -0.0 as 0.0
    rows = rows.where(F.size("vector") == length["n"]).select("vec_id", F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector"))
    keep = k + 1
    first = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= keep)
    entries = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = K.saved(entries.select(F.monotonically_increasing_id().alias("entry"), "vector", "ids"))
    queries = rows.where(is_query).distinct()
    asked = K.saved(queries.select("vector").distinct().select(F.monotonically_increasing_id().alias("query"), "vector"))

    n = entries.count()
    lists = min(MOST_LISTS, max(1, n // LIST))
    wanted = max(SAMPLE, SAMPLE_A_LIST * lists)
    sample = entries.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 40)) < min(1 << 40, (1 << 40) * wanted // n)).select("entry", "vector").toArrow().sort_by("entry")
    x = _matrix(sample["vector"]) if sample.num_rows else _matrix(entries.limit(1).select("vector").toArrow()["vector"])
    graph = CentroidGraph.of(balanced_centroids(x, max(1, -(-len(x) // lists)), seed), seed=seed)
    boundary, ratio, most = learned(graph, x, k)

    posted = K.saved(entries.select("entry", "vector", "ids").mapInArrow(_posted_pass(graph, boundary), "list int, entry long, vector array<double>, ids array<long>"))
    sizes = np.zeros(len(graph.points), dtype=np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    # neighbouring lists make a bundle of about a block of entries, so that a query gives one short result for each bundle
    bundles = bundled(sizes)
    held = np.bincount(bundles, sizes).astype(np.int64)
    plan = F.broadcast(spark.createDataFrame([(k, int(g), max(1, -(-int(held[g]) // BLOCK))) for k, g in enumerate(bundles)], "list int, bundle int, parts int"))
    opened = asked.repartition(max(1, min(asked.count() // 64, 4 * spark.sparkContext.defaultParallelism)), "query")
    opened = K.saved(opened.mapInArrow(_probe_pass(graph, sizes, ratio, most, bundles), "bundle int, lists array<int>, query long, vector array<double>"))
    loads = {r["bundle"]: r["n"] for r in opened.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    # each part of a bundle's entries meets each turn of its queries
    turns = F.broadcast(spark.createDataFrame([(g, max(1, -(-int(held[g]) // BLOCK)), max(1, -(-n // BLOCK))) for g, n in sorted(loads.items())], "bundle int, parts int, turns int"))
    left = opened.join(turns, "bundle").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = posted.join(plan.drop("parts"), "list").join(turns, "bundle").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    right = right.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    by = ["bundle", "part", "turn"]
    found = left.select(*by, "query", "lists", "vector").groupBy(*by).cogroup(right.select(*by, "list", "entry", "vector", "ids").groupBy(*by)).applyInPandas(_nearest(keep), "query long, far double, ids array<long>")
    found = found.select("query", "far", F.explode("ids").alias("vec_id")).groupBy("query", "vec_id").agg(F.min("far").alias("far"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("far", "vec_id"))).where(F.col("n") <= keep)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("far", "vec_id"))).alias("best"))
    named = queries.withColumnRenamed("vec_id", "query_id").join(asked, "vector").select("query_id", "query").join(best, "query")
    out = named.select("query_id", F.explode("best").alias("b")).where(F.col("b.vec_id") != F.col("query_id")).groupBy("query_id", "b.vec_id").agg(F.min("b.far").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
