import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from loomgraph.operators import incidence, models
from loomgraph.plans import models as plans
from loomgraph.sources import sinks, worlds


def test_physical_world(spark):
    lines = [(10, "6,x,2.5,a,,,b,,,,0"), (11, '12,"x,y",4,b,,,a,,,,0')]
    native = worlds.native_events(spark.createDataFrame(lines, "event long, csv_line string"))
    assert sorted(map(tuple, native.collect())) == [(10, "a", "b", 6 / 120, pytest.approx(math.log1p(2.5))), (11, "b", "a", 0.1, pytest.approx(math.log1p(4)))]
    graph = spark.createDataFrame([(10, "a", "b"), (11, "b", "a")], "event long, src string, dst string")
    events = spark.createDataFrame([(0, 11), (1, 10)], "at int, event long")
    own = {r.event: (r.time, r.log_amount) for r in native.collect()}

    def candidates(*rows):
        return spark.createDataFrame([(i, [r[0] for r in row], [r[1] for r in row]) for i, row in enumerate(rows)], "place long, world_event_time_steps array<double>, world_event_log1p_amounts array<double>")

    right = [own[11], own[10]]
    faults = lambda *a: sorted((r.place, r.event, r.fault) for r in worlds.physical_faults(*a).collect())
    assert faults(candidates(right, right), native, graph, events) == []
    assert faults(candidates(right, [own[11], (own[10][0], own[10][1] + 1e-12)]), native, graph, events) == [(1, 10, "values differ")]
    assert faults(candidates(right), native, graph.withColumn("dst", F.lit("z")), events) == [(None, 10, "ends differ"), (None, 11, "ends differ")]
    assert faults(candidates(right), native, graph.where("event = 10"), events) == [(None, 11, "events don't join")]
    for bad in ("6,x,0,a,,,b,,,,0", "6.5,x,1,a,,,b,,,,0", "6,x,1,a,,,b"):
        with pytest.raises(Exception, match="isn't valid"):
            worlds.native_events(spark.createDataFrame([(1, bad)], "event long, csv_line string")).collect()
    a = spark.createDataFrame([(1, 2.0, 5), (2, 3.0, 6)], "k int, x double, n int")
    b = spark.createDataFrame([(1, 2.5, 5), (2, 3.0, 6)], "k int, x double, n int")
    assert sorted(map(tuple, worlds.feature_gap(a, b, "k", ["x", "n"]).collect())) == [("n", 0.0), ("x", 0.5)]
    with pytest.raises(Exception, match="other candidates"):
        worlds.feature_gap(a, b.where("k = 1"), "k", ["x"]).collect()


def test_closure_in_three_forms(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 1), ("b", "c", 2), ("c", "a", 3)], "src string, dst string, edge long")
    cells = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("u", "a", "b"), ("u", "b", "a")], "cell string, src string, dst string")
    assert {(r.form, r.cells, r.open) for r in incidence.closure_forms(edges, cells).collect()} == {(f, 2, 0) for f in ("product", "ends", "renamed")}
    assert {r.open for r in incidence.closure_forms(edges, cells.where("NOT (cell = 't' AND src = 'c')")).collect()} == {1}


def test_lifts_are_kept_whole(spark, tmp_path):
    nodes = spark.createDataFrame([("c", "b"), ("c", "a"), ("d", "x")], "k string, node string")
    edges = spark.createDataFrame([("c", 0, "a", "b")], "k string, edge long, src string, dst string")
    one = incidence.b1(edges).select(F.lit("c").alias("k"), "row", "col", "val")
    two = spark.createDataFrame([], "k string, row long, col string, val int")
    out = incidence.lifted(nodes, edges, one, two, "k")
    got = {r.k: r for r in out.collect()}
    assert [x.node for x in got["c"].nodes] == ["a", "b"] and [tuple(x) for x in got["c"].b1] == [("a", 0, -1), ("b", 0, 1)]
    assert got["d"].edges == got["d"].b1 == got["d"].b2 == got["c"].b2 == []
    sinks.write_parts(out.withColumn("fold", F.lit(1)), str(tmp_path / "lifts"), "fold")
    assert sinks.read_parts(spark, str(tmp_path / "lifts"), "fold").count() == 2
    with pytest.raises(Exception, match="without nodes"):
        incidence.lifted(nodes.where("k = 'd'"), edges, one, two, "k").collect()


def test_parity(spark):
    layers = {"w": np.zeros((3, 4)), "b": np.zeros(4)}
    assert models.parameters(layers) == 16
    df = spark.createDataFrame([("s", "a", 100), ("s", "b", 102), ("t", "a", 100), ("t", "b", 200)], "study string, model string, parameters long")
    got = {(r.study, r.model): r for r in models.parity(df, ["study"], 0.02).collect()}
    assert got["s", "a"].even and not got["t", "a"].even and got["t", "b"].deviation == pytest.approx(50 / 150) and got["t", "a"].most == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="without parameters"):
        models.parity(df.withColumn("parameters", F.lit(0)), ["study"]).collect()


def test_names_and_order_change_no_score(spark):
    nodes = spark.createDataFrame([("c", i, float(i % 2)) for i in range(5)], "candidate string, node long, v double")
    edges = spark.createDataFrame([("c", 10 + i, i, (i * 2 + 1) % 5, [0.1 * i, 1.0, 0.5], float(i < 3)) for i in range(5)], "candidate string, edge long, src long, dst long, e array<double>, chosen double")
    cells = spark.createDataFrame([("c", 3.0)], "candidate string, length double")
    w = plans.layers(n=(1, 8), om=(11, 8), im=(11, 8), up=(24, 8), er=(11, 8), read=(17, 1))
    score = lambda n, e, c: models.directed_network(n, e, c, w)
    assert models.moved(score, nodes, edges, cells).collect() == []
    by_name = lambda n, e, c: score(n, e, c).join(n.groupBy("candidate").agg(F.max("node").alias("m")), "candidate").select("candidate", (F.col("logit") + F.col("m") % 7).alias("logit"))
    assert models.moved(by_name, nodes, edges, cells).count() == 1
