"""Operator 5: exact top-k search by inner product, as a Voronoi kNN join.

Pivots, vectors picked by a hash, more of them for larger tables, divide all vectors into cells. A cell's summary is its number of vectors, its
radius around the pivot p, and its k + 1 smallest distances from p. For a query q, with x in the cell of p at a distance d:
q.p - |q| d <= q.x <= q.p + |q| d. So the k + 1 best of the lower bounds over the cells' smallest distances bound the k-th score
from below (one more than k, as the query itself may be among them), and a cell whose upper bound is less holds no answer. First
whole cells of queries are held against cells of data by the same bounds with the query cell's radius, then each query by
itself.

Query cells are put together to groups of about GROUP_ROWS queries, larger ones are split; data cells are split into blocks of about BLOCK_ROWS
vectors. A group meets a block in one unit of work: a data vector goes only to the groups that may need its cell, a query only to the blocks of
the cells it may need itself. With N vectors and M queries at most N M (1 / GROUP_ROWS + 1 / BLOCK_ROWS) vectors are moved where bounds
exclude nothing, and a cell with a third of all vectors is many units. A unit passes on its k best for each query.

Scores are exact: components are whole numbers, and floating-point products are used only where every sum stays below
2**53; bounds are widened by more than the error of their computation.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as filled up with
zeros; rows are told apart by themselves, not by their ids: of rows with one vec_id each is a candidate for the others and, if a query, gets
its own answers; a row with a null id is a candidate, ordered behind all ids, and a query only where is_query says so.
Components of which a product sum could reach 2**63 raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.texts import joined
from loomgraph.session import staged, table

K = 10
#: Pivots: the square root of the number of vectors over PIVOT_SHARE, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_SHARE = 32, 1024, 8
#: Vectors of a block and queries of a group, about.
BLOCK_ROWS, GROUP_ROWS = 16384, 16384


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.asarray(col.value_lengths())
    flat = np.asarray(col.flatten())
    out = np.zeros((len(col), dims), np.int64)
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[0]), np.int64)
    most = np.linalg.norm(a.astype(float), axis=1).max() * np.linalg.norm(b.astype(float), axis=1).max()
    if most < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    raise OverflowError("inner products could reach 2**63")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to the first."""
    if scores.size > k:
        least = np.partition(scores, scores.size - k)[scores.size - k]
        above = np.flatnonzero(scores > least)
        chosen = np.concatenate([above, np.flatnonzero(scores == least)[: k - above.size]])
    else:
        chosen = np.arange(scores.size)
    return chosen[np.lexsort((chosen, -scores[chosen]))]


def whole(df: DataFrame, key: str, vector: str, scale: int, is_query: Column) -> DataFrame:
    """(id, key, q, v): each usable vector as floor(scale * component); id tells rows apart."""
    x = F.col("x")
    usable = x.isNotNull() & F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector).cast("array<double>").alias("x")).where(usable)
    return rows.select(F.monotonically_increasing_id().alias("id"), "key", "q", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


class Cells:
    """The pivots with the summaries of their cells."""

    def __init__(self, pivots: np.ndarray, k: int):
        self.pivots, self.k = pivots.astype(float), k
        self.norms = np.linalg.norm(self.pivots, axis=1)
        self.radius = np.full(len(pivots), -1.0)
        self.least: list[list[float]] = [[] for _ in pivots]
        self.query_radius = np.full(len(pivots), -1.0)
        self.blocks = np.ones(len(pivots), np.int64)

    def cell(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distance) of each vector."""
        x = v.astype(float)
        square = (x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.norms**2)[None, :]
        at = square.argmin(1)
        return at, np.linalg.norm(x - self.pivots[at], axis=1)

    def groups(self) -> np.ndarray:
        """[i, j]: whether some query in cell i may need cell j."""
        dots = self.pivots @ self.pivots.T
        u = self.query_radius[:, None]
        reach = (self.norms[:, None] + u) * np.maximum(self.radius, 0)[None, :]
        upper = dots + u * self.norms[None, :] + reach
        low = np.concatenate([(dots[:, [j]] - u * self.norms[j]) - (self.norms[:, None] + u) * np.array(d)[None, :] for j, d in enumerate(self.least) if d], axis=1)
        return self.needed(upper, low) & (self.query_radius[:, None] >= 0) & (self.radius >= 0)[None, :]

    def needed(self, upper: np.ndarray, low: np.ndarray) -> np.ndarray:
        n = low.shape[1]
        floor = np.partition(low, n - self.k - 1, axis=1)[:, n - self.k - 1] if n > self.k else np.full(len(low), -np.inf)
        slack = 1e-9 * (np.abs(upper) + np.abs(floor)[:, None]) + 1e-6
        return upper + slack >= floor[:, None]

    def for_queries(self, v: np.ndarray, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """[query, j]: whether the query may need cell j."""
        x = v.astype(float)
        dots, norm = x @ self.pivots.T, np.linalg.norm(x, axis=1)[:, None]
        low = np.concatenate([dots[:, [j]] - norm * np.array(d)[None, :] for j, d in enumerate(self.least) if d], axis=1)
        return groups[at] & self.needed(dots + norm * np.maximum(self.radius, 0)[None, :], low)


def query_groups(pivots: np.ndarray, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, number of groups) of each query cell, and the number of groups: cells beside each other along the main axis share one up to `most` queries."""
    first, parts = np.zeros(len(queries), np.int64), np.maximum(1, -(-queries // most))
    centred = pivots - pivots.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    group, filled = -1, most
    for c in np.argsort(centred @ axis, kind="stable").tolist():
        if not queries[c]:
            continue
        if parts[c] > 1 or filled + queries[c] > most:
            group, filled = group + 1, 0
        first[c] = group
        filled += queries[c]
        if parts[c] > 1:
            group, filled = group + parts[c] - 1, most
    return first, parts, group + 1


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = 1024, pivots: int | None = None, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all other rows for each row of which is_query, an expression over df, holds."""
    spark = df.sparkSession
    rows = staged(whole(df, key, vector, scale, is_query), "vectors")  # ids are fixed from here on
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n) // PIVOT_SHARE))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    cells = Cells(np.unique(matrix(pa.array([r.v for r in picked], pa.list_(pa.int64())), dims), axis=0), k)

    def assign(batches):
        for batch in joined(batches, 4096):
            at, distance = cells.cell(matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "q", "v")), pa.array(at.astype(np.int32)), pa.array(distance)], ["id", "key", "q", "v", "cell", "distance"])

    assigned = staged(rows.select("id", "key", "q", "v").mapInArrow(assign, "id long, key long, q boolean, v array<long>, cell int, distance double"), "cells")
    asked = np.zeros(len(cells.pivots), np.int64)
    for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r"), F.max(F.when(F.col("q"), F.col("distance"))).alias("u"), F.count_if("q").alias("asked")).collect():  # a row for each pivot
        cells.radius[r.cell], cells.blocks[r.cell], asked[r.cell] = r.r, -(-r.n // block_rows), r.asked
        cells.query_radius[r.cell] = -1 if r.u is None else r.u

    def smallest(batches):
        found: dict[int, list[float]] = {}
        for batch in batches:
            at, distance = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            for j in np.unique(at).tolist():
                found[j] = sorted([*found.get(j, []), *np.sort(distance[at == j])[: k + 1].tolist()])[: k + 1]
        for j, d in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(d), pa.int32()), pa.array(d)], ["cell", "distance"])

    # The k + 1 smallest of each task, then of all tasks.
    order = Window.partitionBy("cell").orderBy("distance")
    least = assigned.select("cell", "distance").mapInArrow(smallest, "cell int, distance double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    for r in least.collect():
        cells.least[r.cell].append(r.distance)
    needs = cells.groups()
    first, parts, n_groups = query_groups(cells.pivots, asked, group_rows)
    wanted = np.zeros((max(n_groups, 1), len(asked)), bool)  # [group, cell of data]
    for c in np.flatnonzero(asked).tolist():
        wanted[first[c] : first[c] + parts[c]] |= needs[c]

    def part(ids: np.ndarray, of: np.ndarray, salt: int) -> np.ndarray:
        mixed = (ids.view(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(29)) % of.astype(np.uint64)).astype(np.int64)

    def to_units(batches):
        """Each row as a query for the blocks that it may need and as data for the groups that may need it."""
        for batch in joined(batches, 1024):
            ids, at, q = batch.column("id").to_numpy(), batch.column("cell").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False)
            g, i = np.nonzero(wanted[:, at])
            made = [(g, at[i], part(ids, cells.blocks[at], 1)[i], i, np.zeros(i.size, bool))]
            asking = np.flatnonzero(q)
            if asking.size:
                v = matrix(batch.column("v").take(pa.array(asking)), dims)
                i, j = np.nonzero(cells.for_queries(v, at[asking], needs))
                blocks = cells.blocks[j]
                i, j, block = np.repeat(i, blocks), np.repeat(j, blocks), np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                i = asking[i]
                made.append((first[at[i]] + part(ids[i], parts[at[i]], 2), j, block, i, np.ones(i.size, bool)))
            g, j, block, i, is_q = (np.concatenate(x) for x in zip(*made, strict=True))
            for lo in range(0, i.size, 4096):
                own = slice(lo, lo + 4096)
                take = pa.array(i[own])
                yield pa.RecordBatch.from_arrays([pa.array(g[own].astype(np.int32)), pa.array(j[own].astype(np.int32)), pa.array(block[own]), pa.array(is_q[own]), *(batch.column(c).take(take) for c in ("id", "key", "v"))], ["group", "cell", "block", "q", "id", "key", "v"])

    units = assigned.select("id", "key", "q", "v", "cell").mapInArrow(to_units, "group int, cell int, block long, q boolean, id long, key long, v array<long>")

    def solve(batches):
        """Rows come sorted by unit, data before queries; a unit's data is held while its queries pass."""
        last, held, data = None, [], None
        for batch in joined(batches, 4096):
            unit = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("group", "cell", "block")])
            q, ids, keys, x = batch.column("q").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("key"), matrix(batch.column("v"), dims)
            edges = np.flatnonzero(np.append(True, (unit[:, 1:] != unit[:, :-1]).any(0) | (q[1:] != q[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), q.size], strict=True):
                if tuple(unit[:, a]) != last:
                    last, held, data = tuple(unit[:, a]), [], None
                if not q[a]:
                    held.append((ids[a:b], keys.slice(a, b - a), x[a:b]))
                    continue
                if data is None:
                    own = pa.concat_arrays([h[1] for h in held]) if held else pa.array([], pa.int64())
                    order = pc.sort_indices(own, null_placement="at_end")
                    rank = order.to_numpy()
                    data = np.concatenate([h[0] for h in held])[rank], own.take(order), np.concatenate([h[2] for h in held])[rank]
                    held = []
                for lo in range(a, b, 256):
                    hi = min(lo + 256, b)
                    of, top, score = [], [], []
                    for i, scores in zip(range(lo, hi), products(x[lo:hi], data[2]), strict=True):
                        other = np.flatnonzero(data[0] != ids[i])
                        chosen = other[best(scores[other], k)]
                        of.append(np.full(chosen.size, i)), top.append(chosen), score.append(scores[chosen])
                    of, top = pa.array(np.concatenate(of)), pa.array(np.concatenate(top))
                    yield pa.RecordBatch.from_arrays([pa.array(ids).take(of), keys.take(of), data[1].take(top), pa.array(np.concatenate(score))], ["id", "query_id", "vec_id", "score"])

    met = units.repartition("group", "cell", "block").sortWithinPartitions("group", "cell", "block", "q")
    found = met.mapInArrow(solve, "id long, query_id long, vec_id long, score long")
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.id <> q.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
