"""Small figures whose algebra is known: paths, triangles and polygons, open and filled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, features, graph, incidence, persistence


def polygon(spark, k, close=True):
    rows = [(0, i, (i + 1) % k, f"e{i}") for i in range(k if close else k - 1)]
    return spark.createDataFrame(rows, "g int, src int, dst int, edge string")


def dense(m, rows, cols):
    out = np.zeros((len(rows), len(cols)))
    for r in m.collect():
        out[rows.index(r.row), cols.index(r.col)] = r.val
    return out


def ranks(edges):
    nodes = edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    stars = components.stars(edges.select(F.struct("g", F.col("src").alias("node")).alias("a"), F.struct("g", F.col("dst").alias("node")).alias("b"))).select("a.g", "a.node")
    return incidence.rank_of_incidence(nodes, stars, edges.select("g"), ["g"]).first()


def test_path_and_open_polygons(spark):
    path = ranks(polygon(spark, 4, close=False))
    assert (path.nodes, path.edges, path.components, path.rank, path.betti1) == (4, 3, 1, 3, 0)
    for k in (3, 4):
        own = ranks(polygon(spark, k))
        assert (own.components, own.betti1) == (1, 1)


def test_filled_triangle(spark):
    e = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 2, "c")], "u int, v int, edge string")
    three = graph.triangles(e).withColumn("cell", F.lit("t"))
    two = incidence.b2_simplicial(e, three)
    assert {(r.row, r.val) for r in two.collect()} == {("a", 1), ("b", -1), ("c", 1)}
    one = incidence.b1(e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "edge"))
    assert incidence.product(one, two).collect() == []
    b2 = dense(two, ["a", "b", "c"], ["t"])
    assert 3 - np.linalg.matrix_rank(dense(one, [0, 1, 2], ["a", "b", "c"])) - np.linalg.matrix_rank(b2) == 0
    for bad, message in ((e.where("edge <> 'b'"), "face"), (e.union(e.where("edge = 'a'")), "twice"), (spark.createDataFrame([(0, 1, "a"), (2, 0, "b"), (1, 2, "c")], e.schema), "oriented|face")):
        with pytest.raises(Exception, match=message):
            incidence.b2_simplicial(bad, three).collect()


@pytest.mark.parametrize("k", [3, 4, 5, 6, 8, 12])
def test_filled_polygons(spark, k):
    e = polygon(spark, k)
    cell = e.select(F.lit("x").alias("cell"), F.col("src").alias("place"), "src", "dst")
    one, two = incidence.b1(e), incidence.b2_cells(e, cell)
    assert two.count() == k and incidence.product(one, two).collect() == []
    fan = incidence.fans(cell).collect()
    assert [(r.place, r.a, r.b, r.c) for r in sorted(fan, key=lambda r: r.place)] == [(i, 0, i, i + 1) for i in range(1, k - 1)]
    h = incidence.hasse(one, two).first()
    assert h.rank0 == list(range(k)) and len(h.rank1) == k and len(h.pairs) == 3 * k


def test_laplacians_are_symmetric_and_not_negative(spark):
    e = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 0, "c"), (2, 3, "d"), (3, 1, "e")], "src int, dst int, edge string")
    cell = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("x", 2, 0)], "cell string, src int, dst int")
    one, two = incidence.b1(e), incidence.b2_cells(e, cell)
    b1, b2 = dense(one, [0, 1, 2, 3], list("abcde")), dense(two, list("abcde"), ["x"])
    made = [dense(m, names, names) for m, names in zip(incidence.laplacians(one, two), ([0, 1, 2, 3], list("abcde"), ["x"]), strict=True)]
    for got, want in zip(made, (b1 @ b1.T, b1.T @ b1 + b2 @ b2.T, b2.T @ b2), strict=True):
        assert (got == want).all() and (got == got.T).all() and np.linalg.eigvalsh(got).min() > -1e-9


def test_parallel_events_and_loops(spark):
    t = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 1, 1)], "event_id int, src int, dst int")
    assert sorted((r.row, r.col, r.val) for r in incidence.by_event(t).collect()) == [(0, 1, -1), (0, 2, -1), (1, 1, 1), (1, 2, 1)]


def test_views_agree(spark):
    a, b = spark.createDataFrame([(1, 0, 5), (2, 1, 6)], "k int, y int, m int"), spark.createDataFrame([(1, 0, 7), (2, 1, 8)], "k int, y int, n int")
    assert sorted(tuple(r) for r in incidence.consistent([a, b], "k", "y").collect()) == [(1, 0, 5, 7), (2, 1, 6, 8)]
    for bad in (b.where("k = 1"), b.withColumn("y", F.lit(0)), b.union(b)):
        with pytest.raises(Exception, match="agree"):
            incidence.consistent([a, bad], "k", "y").collect()


def test_a_hole_ends_when_it_is_filled(spark):
    e = spark.createDataFrame([(1, "a", "b", 0.0), (1, "b", "c", 1.0), (1, "c", "a", 2.0)], "g int, src string, dst string, time double")
    d = persistence.diagrams(persistence.filtration(e, "g"), "g")
    bars = lambda t: [tuple(x) for x in d.select(persistence.filled(F.col("h1"), F.array(F.lit(2.0)), t).alias("h")).first().h]
    assert bars(3.0) == [(2.0, 3.0)] and bars(2.0) == []
    rank = ranks(e.select("g", F.col("src"), F.col("dst")))
    frame = spark.createDataFrame([(1, rank.edges, rank.nodes, rank.components, rank.rank)], "g int, edges long, nodes long, components long, rank long")
    r = persistence.essential_census(d, frame, "g").first()
    assert (r.classes, r.first, r.last) == (1, 2.0, 2.0)
    with pytest.raises(Exception, match="differ"):
        persistence.essential_census(d, frame.withColumn("edges", F.lit(9).cast("long")), "g").collect()


def test_motifs_and_caps(spark):
    """A six-cycle with one chord, beside a hub in another group."""
    rows = [(1, i, (i + 1) % 6) for i in range(6)] + [(1, 0, 3)] + [(2, 0, i) for i in range(1, 60)] + [(2, 1, 2)]
    e = spark.createDataFrame(rows, "g int, src int, dst int")
    got = {(r.g, r.node): (r.degree, r.triangles, r.cycles4, r.cycles5, r.cycles6) for r in graph.motifs(e, ("g",), 6).collect()}
    assert got[1, 0] == got[1, 3] == (3, 0, 2, 0, 1) and got[1, 1] == (2, 0, 1, 0, 1)
    assert got[2, 0] == (59, 1, 0, 0, 0) and got[2, 5] == (1, 0, 0, 0, 0)
    arcs = graph.arcs(e, ("g",))
    with pytest.raises(graph.CapExceeded, match="paths"):
        graph.cycles(arcs.union(arcs.select("g", F.col("dst"), F.col("src"), "m")), range(2, 7), by=("g",), most_paths=20)
    assert graph.neighbourhood(e.where("g = 2").withColumn("o", F.col("dst")), 0, "o", 5).count() == 5
    assert graph.prefix(e.where("g = 2").withColumn("o", F.col("dst")), "o", 5).count() == 5


def test_numbers_as_a_simulator_holds_them(spark):
    x = [(1.239,), (-1.239,), (1e12,), (-1e12,), (float("nan"),), (0.0,), (float("inf"),)]
    got = [r[0] for r in spark.createDataFrame(x, "x double").select(features.native_precision(F.col("x"))).collect()]
    assert got == [1.23, -1.23, 21474836.47, -21474836.48, 0.0, 0.0, 21474836.47]


def test_scrubbing_and_guards(spark):
    df = spark.createDataFrame([(1, [(2, 1)], (3, 0))], "k int, edges array<struct<a: int, label: int>>, s struct<b: int, label: int>")
    got = features.scrubbed(df.withColumn("label", F.lit(1)), ["label"])
    assert got.schema.simpleString() == "struct<k:int,edges:array<struct<a:int>>,s:struct<b:int>>"
    assert features.full_census(df, ["k"], 1).first().n == 1
    with pytest.raises(Exception, match="rows"):
        features.full_census(df, ["k"], 2).collect()
    times = spark.createDataFrame([(2, "2024-01-01 02:30:00"), (1, "2024/01/01 00:30")], "o int, t string")
    assert sorted((r.o, r.since) for r in features.relative_hours(times, "t", "o").collect()) == [(1, 0.0), (2, 2.0)]
    with pytest.raises(Exception, match="can't be read"):
        features.relative_hours(spark.createDataFrame([(1, "x")], "o int, t string"), "t", "o").collect()
