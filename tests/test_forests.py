import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, graph, incidence, persistence

INF = float("inf")


def elder(rows):
    """(dim, birth, death) of one graph's (u, v, time), edge by edge."""
    rows, birth, out = sorted((t, u, v) for u, v, t in rows), {}, []
    for t, u, v in rows:
        birth.setdefault(u, t), birth.setdefault(v, t)
    root = {x: x for x in birth}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for t, u, v in rows:
        a, b = find(u), find(v)
        if a == b:
            out.append((1, t, INF))
            continue
        young, old = (a, b) if (birth[a], a) > (birth[b], b) else (b, a)
        out.append((0, birth[young], t))
        root[young] = old
    return sorted(out + [(0, birth[x], INF) for x in root if root[x] == x])


def graphs():
    rng = random.Random(8)
    out = {}
    for g in range(12):
        n = rng.randrange(2, 40)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.05, 0.2, 0.6])] or [(0, 1)]
        out[g] = [(u, v, float(rng.randrange(rng.choice([1, 3, 1000])))) for u, v in pairs]
    out[20] = [(i, i + 1, float(100 - i)) for i in range(100)]  # a path whose later edges come first
    out[21] = [(i, i + 1, float(i)) for i in range(100)]
    out[22] = [(0, i, float(i % 7)) for i in range(1, 200)]
    out[23] = [(2 * i, 2 * i + 1, 0.0) for i in range(30)] + [(2 * i + 1, 2 * i + 2, float(40 - i)) for i in range(29)]  # young beyond old, again and again
    return out


def test_bars_by_joins_equal_the_elder_rule(spark):
    df = spark.createDataFrame([(g, *r) for g, rows in graphs().items() for r in rows], "g int, u int, v int, time double").repartition(5)
    got = persistence.bars(df, "g").collect()
    for g, rows in graphs().items():
        assert sorted((r.dim, r.birth, r.death) for r in got if r.g == g) == elder(rows), g
    assert persistence.bars(df.limit(0), "g").collect() == []


def test_rows_and_arrays_give_the_same_vectors(spark):
    df = spark.createDataFrame([(g, *r) for g, rows in graphs().items() for r in rows], "g int, u int, v int, time double")
    last = df.groupBy("g").agg(F.max("time").alias("most"))
    arrays = persistence.diagrams(df, "g").join(last, "g").select("g", persistence.vector(F.col("h0"), F.col("h1"), F.col("most")).alias("v"))
    want = {(r.g, i): x for r in arrays.collect() for i, x in enumerate(r.v)}
    got = {(r.g, r.place): r.value for r in persistence.vectors(persistence.bars(df, "g"), last, "g").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    bad = spark.createDataFrame([(1, 0, 3.0, 1.0)], "g int, dim int, birth double, death double")
    with pytest.raises(Exception, match="not valid"):
        persistence.finite(bad, last, "g").collect()


def test_port_births(spark):
    """Loops and parallel events begin a class each; a triangle one, when it closes."""
    rows = [(1, 0, "a", "a", 1.0), (1, 1, "a", "b", 1.0), (1, 2, "b", "a", 2.0), (1, 3, "b", "c", 2.0), (1, 4, "c", "a", 2.0), (1, 5, "x", "y", 3.0), (2, 0, "a", "b", 5.0)]
    df = spark.createDataFrame([(g, e, ord(a), ord(b), t) for g, e, a, b, t in rows], "g int, event_id long, src long, dst long, time double")
    assert sorted(map(tuple, persistence.port_births(df, "g").collect())) == [(1, 1.0, 1), (1, 2.0, 2)]


def test_port_births_look_at_pairs_and_not_at_ports(spark, monkeypatch):
    """Two hundred events between three accounts, and a group that has a loop alone."""
    from loomgraph.operators import components

    df = spark.createDataFrame([(1, i, i % 3, (i + 1) % 3, float(i // 50)) for i in range(200)] + [(2, 200, 7, 7, 5.0)], "g int, event_id long, src long, dst long, time double")
    seen, stars = [], components.stars
    monkeypatch.setattr(components, "stars", lambda e: seen.append(e.count()) or stars(e))
    assert sorted(map(tuple, persistence.port_births(df, "g").collect())) == [(1, 0.0, 48), (1, 1.0, 50), (1, 2.0, 50), (1, 3.0, 50), (2, 5.0, 1)]
    assert seen == [3]


def rank(rows, n, modulus):
    """Rank of a dense matrix modulo a prime."""
    rows, r = [[x % modulus for x in row] for row in rows], 0
    for c in range(n):
        if (p := next((i for i in range(r, len(rows)) if rows[i][c]), None)) is None:
            continue
        rows[r], rows[p] = rows[p], rows[r]
        inverse = pow(rows[r][c], -1, modulus)
        for i in range(len(rows)):
            if i != r and rows[i][c]:
                times = rows[i][c] * inverse
                rows[i] = [(x - times * y) % modulus for x, y in zip(rows[i], rows[r], strict=True)]
        r += 1
    return r


@pytest.mark.parametrize(("modulus", "block"), [(2, 3), (2, 1000), (incidence.LARGE_PRIME, 4), (3, 1)])
def test_ranks_equal_elimination(spark, modulus, block):
    rng = random.Random(modulus)
    cells, want = [], {}
    for g in range(4):
        n, m = rng.randrange(1, 14), rng.randrange(1, 14)
        dense = [[rng.choice([0, 0, 0, 1, -1, 2]) for _ in range(m)] for _ in range(n)]
        cells += [(g, i, j, x) for i, row in enumerate(dense) for j, x in enumerate(row) if x]
        want[g] = rank(dense, m, modulus)
    got = {r.g: r["rank"] for r in incidence.ranks(spark.createDataFrame(cells, "g int, row int, col int, val int"), ("g",), modulus, block).collect()}
    assert {g: got.get(g, 0) for g in want} == want
    assert incidence.ranks(spark.createDataFrame([], "g int, row int, col int, val int"), ("g",), modulus).collect() == []


def test_free_faces_are_not_eliminated(spark, monkeypatch):
    """A strip of 300 triangles goes by its free edges; a sphere, whose edges have two faces each, is left for the elimination."""
    faces = [(1, (i, i + 1, i + 2)) for i in range(300)] + [(2, f) for f in itertools.combinations(range(4), 3)]
    cells = [(g, f"{p[0]}-{p[1]}", str(f), (-1) ** k) for g, f in faces for k, p in enumerate(itertools.combinations(f, 2))]
    written, write = [], incidence.staged
    monkeypatch.setattr(incidence, "staged", lambda t, name: written.append((name, (s := write(t, name)).count())) or s)
    got = incidence.ranks(spark.createDataFrame(cells, "g int, row string, col string, val int"), ("g",))
    assert {r.g: r["rank"] for r in got.collect()} == {1: 300, 2: 3}
    assert max(n for name, n in written if name == "columns") == 4


#: The projective plane on six points: its cycle of order two counts over GF(2) alone.
PLANE = [(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 5), (0, 4, 5), (1, 2, 5), (1, 3, 4), (1, 4, 5), (2, 3, 4), (2, 3, 5)]


def complex_of(spark, faces):
    edges = sorted({p for _, f in faces for p in itertools.combinations(sorted(f), 2)})
    rows = sorted({(g, *p) for g, f in faces for p in itertools.combinations(sorted(f), 2)})
    e = spark.createDataFrame([(g, u, v, f"{u}-{v}") for g, u, v in rows], "g int, u int, v int, edge string")
    t = spark.createDataFrame([(g, *sorted(f), str(f)) for g, f in faces if len(f) == 3], "g int, u int, v int, w int, cell string")
    key = lambda c: F.struct(F.col("g"), F.col(c).alias("node"))
    stars = components.stars(e.select(key("u").alias("a"), key("v").alias("b"))).select("a.g", "a.node", F.col("b.node").alias("root"))
    assert edges
    return e.select("g", F.explode(F.array("u", "v")).alias("node")).distinct(), e, t, stars


def test_betti_numbers_with_faces(spark):
    """A sphere, a filled and a hollow triangle beside each other, the projective plane."""
    sphere = [(1, f) for f in itertools.combinations(range(4), 3)]
    two = [(2, (0, 1, 2)), (2, (5, 6)), (2, (6, 7)), (2, (5, 7))]
    faces = sphere + two + [(3, f) for f in PLANE]
    for modulus, plane in ((2, (1, 1, 1)), (incidence.LARGE_PRIME, (1, 0, 0))):
        got = {r.g: tuple(r)[1:] for r in incidence.betti_of_faces(*complex_of(spark, faces), ("g",), modulus).collect()}
        assert got == {1: (1, 0, 1), 2: (2, 1, 0), 3: plane}


def cycles_through(pairs, n, length):
    near = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in range(n)}
    out = dict.fromkeys(range(n), 0)
    for c in itertools.permutations(range(n), length):
        if c[0] == min(c) and c[1] < c[-1] and all(b in near[a] for a, b in zip(c, c[1:] + c[:1], strict=True)):
            for x in c:
                out[x] += 1
    return out


def test_cycles_are_counted_without_listing(spark):
    rng = random.Random(2)
    worlds = {0: list(itertools.combinations(range(6), 2)), 1: [(0, 1), (1, 2), (2, 3), (0, 3)], 2: [(i, (i + 1) % 6) for i in range(6)]}
    worlds |= {g: [p for p in itertools.combinations(range(8), 2) if rng.random() < 0.3 + 0.1 * (g % 5)] for g in range(3, 9)}
    worlds[9] = [(a, b) for a in range(3) for b in range(3, 8)]
    rows = [(g, min(p), max(p)) for g, pairs in worlds.items() for p in pairs]
    df = spark.createDataFrame(rows, "g int, u int, v int")
    got = {(r.g, r.node): (r.cycles4, r.cycles5, r.cycles6) for r in graph.cycle_counts(df, ("g",)).collect()}
    for g, pairs in worlds.items():
        many = [cycles_through(pairs, 8, k) for k in (4, 5, 6)]
        for x in {x for p in pairs for x in p}:
            assert got.get((g, x), (0, 0, 0)) == tuple(m[x] for m in many), (g, x)
    assert {(r.g, r.node): r.cycles4 for r in graph.cycle_counts(df, ("g",), 4).collect()}.items() <= {k: v[0] for k, v in got.items()}.items()
    five = {(r.g, r.node): (r.cycles4, r.cycles5) for r in graph.cycle_counts(df, ("g",), 5).collect()}
    assert five == {k: v[:2] for k, v in got.items()}


def test_centre_fan(spark):
    """The signs of B2 follow the stored directions; B1 B2 vanishes; a walk that isn't closed raises."""
    rows = [("t", 0, 7, "a", "b"), ("t", 1, 8, "b", "c"), ("t", 2, 9, "c", "a"), ("two", 0, 1, "x", "y"), ("two", 1, 2, "y", "x")]
    df = spark.createDataFrame(rows, "k string, place int, event_id long, src string, dst string")
    faces = incidence.port_fan(df, "k")
    got = {(r.k, r.face): tuple(r)[2:] for r in faces.collect()}
    assert len(got) == 12 + 8
    assert got["t", 0] == ("account:a", "out:7", "7/0", "spoke:0", "spoke:1")
    assert got["t", 11] == ("in:9", "account:a", "9/3", "spoke:11", "spoke:0")
    one, two = ({(r.k, r.row, r.col): r.val for r in x.collect()} for x in incidence.fan_incidence(faces, "k"))
    assert len(two) == 3 * 20 and sum(two.values()) == 20
    for k, face in got:
        total = {}
        for (g, edge, f), y in two.items():
            if (g, f) == (k, str(face)):
                for (h, vertex, e), x in one.items():
                    if (h, e) == (k, edge):
                        total[vertex] = total.get(vertex, 0) + x * y
        assert total and not any(total.values())
    with pytest.raises(Exception, match="isn't closed"):
        incidence.port_fan(df.where("place < 2 AND k = 't'"), "k").collect()
