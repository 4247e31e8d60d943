import math

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import features, graph


def events(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "g int, event_id long, src string, dst string, amount double")


def test_flows_are_sums_of_logs(spark):
    e = events(spark, [("a", "b", 2.0), ("a", "b", 5.0), ("b", "a", -3.0), ("b", "b", 1.0), ("b", "c", None)])
    got = {r.node: tuple(r)[2:] for r in features.graph_view(e, ["g"], F.col("node") != "c").collect()}
    log = math.log1p
    assert got["a"] == pytest.approx((1, 2, 0.0, log(2) + log(5), 1, 1 / (3 + 1e-6)))
    assert got["b"] == pytest.approx((3, 3, log(2) + log(5) + log(1), log(1), 1, 3 / (6 + 1e-6)))
    assert got["c"] == pytest.approx((1, 0, 0.0, 0.0, 0, 1 / (1 + 1e-6)))
    edges = {r.event_id: (r.log_amount, r.in_cycle) for r in features.graph_view_edges(e, ["g"], lambda c: c != "c").collect()}
    assert edges[0] == pytest.approx((log(2), 1)) and edges[2] == (0.0, 1) and edges[4] == (0.0, 0)


def test_nodes_that_are_given(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z")], "g int, node string")
    own = {r.node: (r.n_in, r.n_out) for r in features.graph_view(events(spark, [("a", "b", 1.0)]), ["g"], F.lit(False), nodes).collect()}
    assert own == {"a": (0, 1), "b": (1, 0), "z": (0, 0)}
    for bad in (("a", "x", 1.0), ("x", "a", 1.0)):
        with pytest.raises(Exception, match="outside the nodes"):
            features.graph_view(events(spark, [bad]), ["g"], F.lit(False), nodes).collect()
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="isn't finite"):
            features.graph_view(events(spark, [("a", "b", bad)]), ["g"], F.lit(False)).collect()


def test_faces(spark):
    e = events(spark, [("a", "b", 2.0), ("b", "a", 5.0), ("b", "c", 1.0), ("c", "a", -4.0), ("c", "d", 1.0)])
    edges = features.simplicial_view(e, ["g"], lambda c: c != "d")
    three = graph.triangles(edges.select("g", "u", "v"), ("g",))
    (row,) = features.simplicial_faces(edges, three, ["g"], lambda c: c != "d").collect()
    assert tuple(row)[1:] == pytest.approx(("a", "b", "c", (math.log1p(7) + math.log1p(1)) / 3, 4.0, 1))
    assert {(r.u, r.v): r.in_cycle for r in edges.collect()}["c", "d"] == 0
