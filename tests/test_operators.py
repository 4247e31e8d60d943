import itertools
import random

import pytest

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.operators import components, graph, incidence, joins, metrics, persistence, splits, statistics


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "event_id long, src long, dst long")


def test_cycles_and_tuples(spark):
    e = edges(spark, [(1, 2), (1, 2), (2, 3), (3, 1), (2, 1), (4, 4)])
    found = graph.cycles(graph.arcs(e), range(2, 5))
    assert sorted(r.cycle for r in found.collect()) == [[1, 2], [1, 2, 3]]
    caps = {tuple(r.cycle): int(r.capacity) for r in graph.capacities(found, graph.arcs(e)).collect()}
    assert caps == {(1, 2): 2, (1, 2, 3): 2}
    assert sorted(r.events for r in graph.event_tuples(found, e, 4).collect()) == [[0, 2, 3], [0, 4], [1, 2, 3], [1, 4]]
    with pytest.raises(graph.CapExceeded):
        graph.event_tuples(found, e, 3)
    with pytest.raises(graph.CapExceeded):
        graph.cycles(graph.arcs(e), range(2, 5), cap=1)
    four = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 1)])
    assert [r.cycle for r in graph.undirected_cycles(four, range(3, 6)).collect()] == [[1, 2, 3, 4]]


def test_rotation(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([2, 2, 1],), ([5],)], "c array<int>")
    assert [r[0] for r in df.select(graph.rotated(df.c)).collect()] == [[1, 2, 3], [1, 2, 2], [5]]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(500, 501 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components.stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components.stars(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ranking_fixtures(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0), (1, 0, 0.0), (2, 1, 0.3), (2, 1, 0.1), (3, 0, 1.0)], "w int, y int, s double")
    r = {x.w: (x.ap, x.auroc) for x in metrics.ranking(df, ["w"]).collect()}
    assert r == {1: (0.5, 0.5), 2: (1.0, None), 3: (None, None)}
    f = metrics.best_threshold(spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.4)], "w int, y int, s double"), ["w"]).first()
    assert (f.threshold, f.f1) == (0.4, 1.0)
    all_in = metrics.best_threshold(spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4), (1, 0, 0.3)], "w int, y int, s double"), ["w"]).first()
    assert all_in.threshold == 0.0  # calling all positive is best, and 0 is tried first
    one = metrics.best_threshold(spark.createDataFrame([(1, 1, 0.2)], "w int, y int, s double"), ["w"]).first()
    assert one.threshold is None
    m = metrics.macro_mean(spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 1.0), ("b", 2, 3.0)], "arm string, world int, x double"), ["arm"], "world", "x")
    assert {x.arm: x.x for x in m.collect()} == {"a": None, "b": 2.0}


def test_signed_rank(spark):
    def brute(d):
        d = [x for x in d if x]
        mag = sorted(abs(x) for x in d)
        rank = [2 * mag.index(abs(x)) + mag.count(abs(x)) + 1 for x in d]
        plus = sum(r for r, x in zip(rank, d) if x > 0)
        least = min(plus, sum(rank) - plus)
        ways = sum(sum(r for r, s in zip(rank, signs) if s) <= least for signs in itertools.product((0, 1), repeat=len(d)))
        return len(d), plus, min(1, 2 * ways / 2 ** len(d))

    rng = random.Random(2)
    sets = {k: [rng.randrange(-4, 5) / 2 for _ in range(9)] for k in range(6)} | {8: [1, -1, 2, 0], 9: [-1] * 30, 7: [0, 0]}
    df = spark.createDataFrame([(k, float(x)) for k, d in sets.items() for x in d], "k int, d double")
    got = {r.k: (r.n, r.w_plus, r.p) for r in statistics.signed_rank(df, ["k"], "d").collect()}
    assert got[9] == (30, 0, 2 / 2**30) and got[8][0] == 3 and got[7] == (0, 0, 1.0)
    for k in (*range(6), 8):
        assert got[k] == pytest.approx(brute(sets[k]))


def test_holm(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "f int, n string, p double")
    got = {r.n: (round(r.adjusted, 9), r.rejected) for r in statistics.holm(df, ["f"], "n", "p").collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}


def test_incidence(spark):
    e = spark.createDataFrame([(0, "a", "b"), (1, "b", "a"), (2, "b", "c"), (3, "c", "a")], "edge long, src string, dst string")
    cell = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a")], "cell string, src string, dst string")
    two = incidence.b2_cells(e, cell)
    assert {r.row: r.val for r in two.collect()} == {0: 1, 2: 1, 3: 1}
    assert incidence.product(incidence.b1(e), two).collect() == []
    with pytest.raises(Exception, match="without an edge"):
        incidence.b2_cells(e.where("edge < 2"), cell).collect()
    for k in (3, 5, 12):
        ring = spark.createDataFrame([(i, str(i), str((i + 1) % k)) for i in range(k)], "edge long, src string, dst string")
        own = incidence.b2_cells(ring, ring.selectExpr("'x' cell", "src", "dst"))
        assert incidence.product(incidence.b1(ring), own).collect() == [] and own.count() == k
        l0 = {(r.row, r.col): r.val for r in incidence.laplacians(incidence.b1(ring), own)[0].collect()}
        assert all(l0[str(i), str(i)] == 2 for i in range(k))
    loop = spark.createDataFrame([(0, "a", "a")], "edge long, src string, dst string")
    assert incidence.b1(loop).collect() == [] and incidence.residual(loop.selectExpr("1 g", "src", "dst"), "g").collect() == []


def test_persistence(spark):
    from pyspark.sql import functions as F

    e = spark.createDataFrame([(1, "a", "b", 0.0), (1, "b", "c", 1.0), (1, "c", "a", 2.0), (1, "b", "a", 5.0), (1, "d", "d", 1.0)], "g int, src string, dst string, time double")
    d = persistence.diagrams(persistence.filtration(e, "g"), "g").first()
    inf = float("inf")
    assert sorted((x.birth, x.death) for x in d.h0) == [(0.0, 0.0), (0.0, inf), (1.0, 1.0)]
    assert [(x.birth, x.death) for x in d.h1] == [(2.0, inf)]
    rows = [([(0.0, 2.0)], [(2.0, inf)], 4.0), ([(0.0, 4.0)], [(4.0, inf)], 8.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, f"{persistence.DIAGRAM}, most double")
    v = [r[0] for r in df.select(persistence.vector(F.col("h0"), F.col("h1"), F.col("most"))).collect()]
    assert len(v[0]) == 310 and not any(v[2])
    assert v[0][:155] == v[1][:155]
    s = df.select(persistence.summary(persistence.clean(F.col("h0"), F.col("most"))).alias("s")).select("s.*").collect()
    assert [(x.total, x.longest, x.mean, x.entropy, x.bars) for x in s] == [(2.0, 2.0, 2.0, 0.0, 1), (4.0, 4.0, 4.0, 0.0, 1), (0.0, 0.0, 0.0, 0.0, 0)]
    with pytest.raises(Exception, match="not valid"):
        spark.createDataFrame([([(3.0, 1.0)], [], 1.0)], f"{persistence.DIAGRAM}, most double").select(persistence.clean(F.col("h0"), F.col("most"))).collect()
    with pytest.raises(Exception, match="missing or not finite"):
        persistence.filtration(e.withColumn("time", F.lit(None).cast("double")), "g").collect()


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 5), (3, 6)], "k int, w int")
    assert {r.fault: r.n for r in joins.join_faults(a, b, ["k"]).collect()} == {"repeated left": 1, "repeated right": 0, "left alone": 1, "right alone": 1}
    with pytest.raises(ValueError, match="one to one"):
        joins.strict_join(a, b, ["k"])
    assert joins.strict_join(a.where("k = 1"), b.where("k = 1"), ["k"]).count() == 1
    with pytest.raises(Exception, match="ambiguous"):
        joins.signature_join(b, a, ["k"], "v").unionByName(joins.signature_join(b.selectExpr("2 k", "w"), a, ["k"], "v")).collect()


def test_groups_and_folds(spark):
    tokens = spark.createDataFrame([("one", "a"), ("one", "b"), ("two", "b"), ("two", "c"), ("three", "d"), ("four", "d"), ("five", "e")], "candidate string, token string")
    g = {r.candidate: r.grp for r in splits.groups(tokens).collect()}
    assert g == {"one": "one", "two": "one", "three": "four", "four": "four", "five": "five"}
    profile = spark.createDataFrame([(i, 1 + i % 4, i % 2) for i in range(40)], "grp int, n long, positives long")
    fold = {r.grp: r.fold for r in splits.fold_of_groups(profile, 4, "s").collect()}
    assert len(fold) == 40 and {sum(1 for k, f in fold.items() if f == x and k % 2) for x in range(4)} == {5}
    ring = spark.createDataFrame([(1, 0, "a", "b", 0, 100.0), (1, 1, "b", "c", 1, 99.0), (1, 2, "c", "a", 2, 98.5), (2, 0, "a", "b", 0, 100.0), (2, 1, "b", "a", 1, 110.0)], "r int, p int, src string, dst string, time int, amount double")
    faults = {r.r: (r.gap, r.time, r.growth, r.fee) for r in splits.flow_faults(ring, "r", "p").collect()}
    assert faults == {1: (0, 0, 0, 0), 2: (0, 0, 1, 0)}


def test_ordinals(spark):
    df = spark.range(500).selectExpr("id * 7919 % 500 AS x").repartition(7)
    assert sorted((r.n, r.x) for r in with_ordinal(df, ["x"], "n").collect()) == [(i, i) for i in range(500)]


def test_detectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 5.0, 6.0, 1.0, 7.0])], "k int, t int, v double")
    assert [r.run for r in statistics.runs(df, ["k"], "t", F.col("v") > 3).orderBy("t").collect()] == [0, 1, 2, 0, 1]
    assert [r.stable for r in statistics.stable_windows(df, ["k"], "t", "v", 2, 0.5).orderBy("t").collect()] == [False, False, True, False, False]
