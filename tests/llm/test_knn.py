import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import knn


def brute(rows, k):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(own):
        if q is not None and q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i is None, i or 0) for n, (i, v) in enumerate(own) if n != at)[:k]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scores)]
    return sorted(out, key=str)


def vectors(n, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(4)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)]) for i in range(n)]
    hot = rows[1][1]
    rows += [(n + i, hot) for i in range(n // 2)]
    rows += [(5000, None), (5005, [1.0, None, 0.0, 0.0]), (5010, [1.0, float("nan"), 0.0, 0.0]), (5015, [float("inf"), 0.0, 0.0, 0.0]), (5020, [0.0] * 4), (None, [9.0] * 4), (5025, []), (-5, [1.0, 2.0])]
    return rows


@pytest.mark.parametrize(("pivots", "block"), [(1, 10_000), (5, 7), (12, 40), (None, 30)])
def test_equals_brute_force(spark, pivots, block):
    rows = vectors(120, pivots or 4)
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score long").repartition(4)
    got = sorted((tuple(r) for r in knn.search(df, F.col("vec_id") % 5 == 0, k=7, pivots=pivots, block_rows=block, group_rows=9).collect()), key=str)
    assert got == brute(rows, 7)


def test_repeated_rows_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    one = [(0, 1, 1, 1024 * 2048), (0, 2, 1, 1024 * 2048), (0, 3, 0, 1024 * 1024)]
    assert sorted(tuple(r) for r in knn.search(df, F.col("vec_id") == 0).collect()) == sorted(one * 2)
    other = spark.createDataFrame([(0, [0.5]), (1, [0.1]), (1, [0.5]), (1, [0.3]), (2, [0.2]), (None, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r)[1:3] for r in knn.search(other, F.col("vec_id") == 0).collect()] == [(1, 1), (2, None), (3, 1), (4, 2), (5, 1)]
    assert knn.search(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert knn.search(df, F.col("vec_id") == 9).collect() == []


def test_cells_are_left_out(spark):
    rows = vectors(400, 3)
    v = np.array([[math.floor(1024 * x) for x in v] for _, v in rows[:400]])
    cells = knn.Cells(v[:12], 3)
    at, d = cells.cell(v)
    for j in range(12):
        own = np.sort(d[at == j])
        if own.size:
            cells.radius[j], cells.least[j], cells.query_radius[j] = own[-1], own[:4].tolist(), own[-1]
    used = cells.for_queries(v, at, cells.groups())
    assert used.mean() < 0.6


def test_exact_where_floats_are_not():
    a = np.array([[2**28 + 1, 3]])
    assert knn.products(a, a)[0, 0] == (2**28 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        knn.products(a << 20, a << 20)


def test_sql(spark, tmp_path):
    rows = [(i, v) for i, v in vectors(300, 8) if i != -5 and v != []]
    rows += [(100, v) for _, v in rows[:3]]  # repeated ids
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(knn.OP5_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in knn.op5(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()), key=str) == want
