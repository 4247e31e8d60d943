"""Layers and networks with given weights against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import joins, models, splits, statistics

RNG = np.random.default_rng(5)
ARCS = [(0, 1), (0, 1), (1, 2), (2, 0), (3, 3), (2, 4)]
X = RNG.normal(size=(6, 2))


@pytest.fixture(scope="module")
def frames(spark):
    nodes = spark.createDataFrame([(0, i, X[i].tolist()) for i in range(6)], "g int, node int, h array<double>")
    return nodes, spark.createDataFrame([(0, a, b) for a, b in ARCS], "g int, src int, dst int")


def rows(df):
    return np.array([r.h for r in sorted(df.collect(), key=lambda r: r.node)])


def test_degree_layer(frames):
    w, b = RNG.normal(size=(2, 3)), RNG.normal(size=3)
    full = [*ARCS, *((i, i) for i in range(6))]
    out, into = np.bincount([a for a, _ in full], minlength=6), np.bincount([b for _, b in full], minlength=6)
    want = np.zeros((6, 3))
    for u, v in full:
        want[v] += X[u] @ w / np.sqrt(out[u] * into[v])
    assert np.allclose(rows(models.degree_layer(*frames, ["g"], w, b)), want + b)


def test_attention_layer(frames):
    w, s, t, b = RNG.normal(size=(2, 4)), RNG.normal(size=(2, 2)), RNG.normal(size=(2, 2)), RNG.normal(size=4)
    h = (X @ w).reshape(6, 2, 2)
    full = [*ARCS, *((i, i) for i in range(6))]
    e = np.array([(h[u] * s).sum(1) + (h[v] * t).sum(1) for u, v in full])
    e = np.exp(np.where(e > 0, e, 0.2 * e))
    want = np.zeros((6, 2, 2))
    for v in range(6):
        into = [i for i, (_, x) in enumerate(full) if x == v]
        for i in into:
            want[v] += h[full[i][0]] * (e[i] / e[into].sum(0))[:, None]
    assert np.allclose(rows(models.attention_layer(*frames, ["g"], w, s, t, b)), want.reshape(6, 4) + b)


def test_cell_network_and_its_channels(spark):
    k = 3
    w = {n: RNG.normal(size=s) for n, s in {"node": (1, k), "edge": (3, k), "src": (k, k), "dst": (k, k), "eu": (3 * k, k), "face": (1, k), "fu": (2 * k, k), "out": (k, 1), "node_b": k, "edge_b": k, "eu_b": k, "face_b": k, "fu_b": k, "out_b": 1}.items()}
    arcs, v, e = [(0, 1, 1), (1, 0, 1), (1, 2, 0), (2, 2, 0)], np.array([1.0, 1.0, 0.0]), RNG.normal(size=(4, 3))
    hv = np.tanh(v[:, None] @ w["node"] + w["node_b"])
    b1 = np.zeros((3, 4))
    for i, (a, b, _) in enumerate(arcs):
        if a != b:
            b1[a, i] = b1[b, i] = 1
    face = np.array([[f] for *_, f in arcs], float)
    src, dst = [a for a, *_ in arcs], [b for _, b, _ in arcs]
    low = b1.T @ hv + hv[src] @ w["src"] + hv[dst] @ w["dst"]
    f0 = np.tanh(np.array([[2.0]]) @ w["face"] + w["face_b"])
    he = np.tanh(np.concatenate([np.tanh(e @ w["edge"] + w["edge_b"]), low, face @ f0], 1) @ w["eu"] + w["eu_b"])
    hf = np.tanh(np.concatenate([f0, face.T @ he], 1) @ w["fu"] + w["fu_b"])
    want = ((hf + he.mean(0)) @ w["out"] + w["out_b"])[0, 0]
    nodes = spark.createDataFrame([(7, i, float(x)) for i, x in enumerate(v)], "candidate int, node int, v double")
    edges = spark.createDataFrame([(7, i, a, b, e[i].tolist(), f) for i, (a, b, f) in enumerate(arcs)], "candidate int, edge int, src int, dst int, e array<double>, face int")
    cells = spark.createDataFrame([(7, 2)], "candidate int, length int")
    assert models.cell_network(nodes, edges, cells, w).first().logit == pytest.approx(want)
    df = spark.createDataFrame([(i, float(i), 1.0, 2.0) for i in range(5)], "k int, a double, b double, dead double")
    score = lambda d, names: models.score_mlp(d, names, [(np.array([[1.0], [2.0], [0.0]]), np.array([0.0]))])
    assert {r.channel: r.moved for r in models.channels(df, ["a", "b", "dead"], score, "k").collect()} == {"a": 5, "b": 5, "dead": 0}


def weights(**shapes):
    return {n: RNG.normal(size=x) for n, x in shapes.items()} | {f"{n}_b": RNG.normal(size=x[1]) for n, x in shapes.items()}


def test_directed_network(spark):
    k, arcs, v, e = 3, [(0, 1, 1), (1, 0, 1), (1, 2, 0), (2, 2, 0)], np.array([1.0, 1.0, 0.0]), RNG.normal(size=(4, 3))
    w = weights(n=(1, k), om=(k + 3, k), im=(k + 3, k), up=(3 * k, k), er=(k + 3, k), read=(2 * k + 1, 1))
    lin = lambda x, n: x @ w[n] + w[f"{n}_b"]
    src, dst, sel = (np.array(x) for x in zip(*arcs, strict=True))
    h = np.tanh(lin(v[:, None], "n"))
    out, into = np.zeros((3, k)), np.zeros((3, k))
    np.add.at(out, src, np.tanh(lin(np.c_[h[dst], e], "om")))
    np.add.at(into, dst, np.tanh(lin(np.c_[h[src], e], "im")))
    h2 = np.tanh(lin(np.c_[h, into, out], "up"))
    eh = np.tanh(lin(np.c_[h2[src], e], "er"))
    nr, er = (h2 * v[:, None]).sum(0) / (v.sum() + 1e-6), (eh * sel[:, None]).sum(0) / (sel.sum() + 1e-6)
    want = lin(np.concatenate([nr, er, [2.0]]), "read")[0]
    nodes = spark.createDataFrame([(7, i, float(x)) for i, x in enumerate(v)], "candidate int, node int, v double")
    edges = spark.createDataFrame([(7, i, a, b, e[i].tolist(), c) for i, (a, b, c) in enumerate(arcs)], "candidate int, edge int, src int, dst int, e array<double>, chosen int")
    assert models.directed_network(nodes, edges, spark.createDataFrame([(7, 2)], "candidate int, length int"), w).first().logit == pytest.approx(want)


def test_simplicial_network(spark):
    k, v, e, f = 3, RNG.normal(size=(4, 8)), RNG.normal(size=(5, 5)), RNG.normal(size=2)
    arcs, sides = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3)], [(0, 1, 2), (1, 3, 4)]
    w = weights(v=(8, k), rel=(5, k), e=(2 * k, k), vu=(2 * k, k), f=(1, k), fu=(2 * k, k), out=(k, 1))
    lin = lambda x, n: x @ w[n] + w[f"{n}_b"]
    b1, b2 = np.zeros((4, 5)), np.zeros((5, 2))
    for i, (a, b) in enumerate(arcs):
        b1[a, i] = b1[b, i] = 1
    for i, own in enumerate(sides):
        b2[list(own), i] = 1
    hv = np.tanh(lin(v, "v"))
    he = np.tanh(lin(np.c_[np.tanh(lin(e, "rel")), b1.T @ hv], "e"))
    hv2 = np.tanh(lin(np.c_[hv, b1 @ he], "vu"))
    hf = np.tanh(lin(np.c_[np.tanh(lin(f[:, None], "f")), b2.T @ he], "fu"))
    want = lin(hf.mean(0) + hv2.mean(0), "out")[0]
    nodes = spark.createDataFrame([(7, i, x.tolist()) for i, x in enumerate(v)], "candidate int, node int, v array<double>")
    edges = spark.createDataFrame([(7, i, a, b, e[i].tolist()) for i, (a, b) in enumerate(arcs)], "candidate int, edge int, src int, dst int, e array<double>")
    faces = spark.createDataFrame([(7, i, float(x)) for i, x in enumerate(f)], "candidate int, face int, f double")
    side = spark.createDataFrame([(7, i, x) for i, own in enumerate(sides) for x in own], "candidate int, face int, edge int")
    assert models.simplicial_network(nodes, edges, faces, side, w).first().logit == pytest.approx(want)


def test_edge_pool(spark):
    e = spark.createDataFrame([(1, 1.0, 5), (1, 3.0, 1), (2, 2.0, 2)], "g int, log_amount double, since int")
    assert {r.g: r.pooled for r in models.edge_pooled(e, ["g"]).collect()} == {1: [2.0, 3.0, 3.0, 5.0], 2: [2.0, 2.0, 2.0, 2.0]}
    with pytest.raises(Exception, match="finite"):
        models.edge_pooled(e.withColumn("log_amount", F.lit(float("nan"))), ["g"]).collect()


def test_ring_labels(spark):
    arcs = spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("y", 1, 2), ("y", 2, 9), ("z", 8, 9), ("z", 9, 8), ("m", 1, 2), ("m", 5, 6)], "cycle string, src int, dst int")
    rings = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (5, 6, 1)], "src int, dst int, ring int")
    assert {r.cycle: r.label for r in splits.ring_labels(arcs, rings).collect()} == {"x": 1, "z": 0}


def test_versions_and_membership(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (2, "y", 2)], "k int, v string, w int")
    got = sorted((r.k, r.fault, r.what) for r in joins.reconcile_all({"a": a, "b": b}, ["k"], ["v", "w"]).collect())
    assert got == [(2, "differs", "v"), (2, "repeated", "b"), (3, "missing", "b")]
    cand = spark.createDataFrame([(1, [1, 5, 3], [10, 11, 12]), (1, [1, 5, 3], [10, 11, 13])], "w int, cycle array<int>, events array<int>")
    inst = spark.createDataFrame([(1, 99, [5, 3, 1], [11, 12, 10], True)], "w int, instance int, members array<int>, events array<int>, sar boolean")
    assert sorted((r.events, r.instance, r.sar) for r in joins.membership(cand, inst, ["w"]).collect()) == [([10, 11, 12], 99, True), ([10, 11, 13], None, None)]
    one = spark.createDataFrame([(1, 2)], "alert int, arcs int")
    tries = spark.createDataFrame([(10, 1, 0), (11, 1, 1), (12, 1, 1)], "attempt int, alert int, arc int")
    done = spark.createDataFrame([(10, 5), (12, 7)], "attempt int, time int")
    r = joins.realization(one, tries, done, (F.lit(0), F.lit(6))).first()
    assert (r.attempted, r.persisted, r.stray, r.complete, r.in_frame) == (3, 2, 0, True, False)


def test_large_clusters_weigh_more(spark):
    """All resamples of two clusters hold only their own observations, so the mean of a draw with both is that over all three rows."""
    df = spark.createDataFrame([("k", 1, 1.0, 0.0), ("k", 2, 4.0, 0.0), ("k", 2, 4.0, 0.0)], "arm string, c int, a double, b double")
    sums = statistics.cluster_sums(df, "c", ["arm"], "a", "b")
    means = {round(r["mean"], 9) for r in statistics.resampled(sums, "c", ["arm"], "_d", 60, "s", "_n").collect()}
    assert means == {1.0, 3.0, 4.0}


def test_dense_makes_one_product_of_a_batch(spark):
    """Null and short lists count as zeros, a long one raises, and a plan holds no expression for each weight."""
    w, b = np.arange(72 * 24).reshape(72, 24) / 1000.0, np.arange(24) / 10.0
    rows = [(0, [1.0] * 72), (1, None), (2, [2.0, None, 1.0]), (3, [])]
    df = spark.createDataFrame(rows, "k int, x array<double>").select("k", models.dense(F.col("x"), w, b, F.tanh).alias("y"))
    x = np.array([[1.0] * 72, [0.0] * 72, [2.0, 0.0, 1.0] + [0.0] * 69, [0.0] * 72])
    got = np.array([r.y for r in df.orderBy("k").collect()])
    assert np.allclose(got, np.tanh(x @ w + b), rtol=0, atol=1e-12)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 2_000
    with pytest.raises(Exception, match="73 numbers for 72 rows"):
        spark.range(1).select(models.dense(F.array_repeat(F.lit(1.0), 73), w)).collect()
