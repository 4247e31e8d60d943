"""What crosses the network or is broadcast, on small tables whose final plans are read."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import graph, incidence, joins
from loomgraph.session import dealt


def nodes_of(plan):
    """The nodes of an executed plan, with those behind its stages."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes_of(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from nodes_of(plan.plan())
    else:
        yield name, plan
        kids = plan.children()
        for i in range(kids.size()):
            yield from nodes_of(kids.apply(i))


def collected(df):
    rows = df.collect()
    return rows, list(nodes_of(df._jdf.queryExecution().executedPlan()))


def test_edge_laplacian_sends_entries_and_not_pairs(spark):
    """A hub of 300 arcs makes 90,000 entries; a two-cycle and a triangle lie among them."""
    arcs = [("h", f"n{i}") for i in range(298)] + [("n0", "h"), ("n0", "n1"), ("n1", "h")]
    e = spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in arcs], "src string, dst string, edge string")
    cells = [("x", "h", "n0"), ("x", "n0", "h"), ("y", "h", "n0"), ("y", "n0", "n1"), ("y", "n1", "h")]
    two = incidence.b2_cells(e, spark.createDataFrame(cells, "cell string, src string, dst string"))
    rows, plan = collected(incidence.laplacians(incidence.b1(e), two)[1])
    names, at = sorted({x for a in arcs for x in a}), {f"{a}-{b}": i for i, (a, b) in enumerate(arcs)}
    b1, b2 = np.zeros((len(names), len(arcs)), int), np.zeros((len(arcs), 2), int)
    for (a, b), i in zip(arcs, range(len(arcs)), strict=True):
        b1[names.index(a), i], b1[names.index(b), i] = -1, 1
    for c, a, b in cells:
        b2[at[f"{a}-{b}"], "xy".index(c)] += 1
    want = b1.T @ b1 + b2 @ b2.T
    assert len(rows) == np.count_nonzero(want)
    assert all(want[at[r.row], at[r.col]] == r.val for r in rows)
    sent = [p.metrics().apply("shuffleRecordsWritten").value() for n, p in plan if n == "ShuffleExchangeExec"]
    assert sum(sent) < 10_000


def test_edge_pairs_of_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 1, "c"), (3, 3, "loop"), (2, 3, "d")], "src long, dst long, edge string")
    marked = spark.createDataFrame([("a",), ("c",)], "col string")
    apart, met = incidence.edge_pairs(incidence.b1(e), marked)
    got = {(r.row, r.col): r.val for r in apart.unionByName(met).collect()}
    assert got == {(r.row, r.col): r.val for r in incidence.product(incidence.transposed(incidence.b1(e)), incidence.b1(e)).collect()}
    assert {(r.row, r.col) for r in met.collect()} == {("a", "a"), ("a", "c"), ("c", "a"), ("c", "c")}


def test_large_rows_meet_by_arrays(spark):
    """A hub of 600 arcs makes 360,000 entries; those across its parts come of arrays, not of a joined row for each."""
    arcs = [("h", f"n{i}") for i in range(300)] + [(f"n{i}", "h") for i in range(200, 500)]
    e = spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in arcs], "src string, dst string, edge string")
    apart, met = incidence.edge_pairs(incidence.b1(e), spark.createDataFrame([(f"h-n{i}",) for i in range(5)], "col string"))
    rows, plan = collected(apart)
    sign = {f"{a}-{b}": -1 if a == "h" else 1 for a, b in arcs}
    back = lambda x: "-".join(reversed(x.split("-")))
    want = {(a, b): sign[a] * sign[b] * (1 + (a == b or a == back(b))) for a in sign for b in sign}
    both = {(r.row, r.col): r.val for r in met.collect()}
    assert len(rows) + len(both) == 360_000 and len(both) == 25
    assert {(r.row, r.col): r.val for r in rows} | both == want
    assert sum(p.metrics().apply("numOutputRows").value() for n, p in plan if n.endswith("JoinExec")) < 120_000


def test_edge_pairs_in_small_parts(spark):
    """Parallel, opposite and lone edges, values other than one, some marked, dealt into parts of two."""
    rng = np.random.default_rng(4)
    ends = [("x", 1, f"n{i % 23}", -1) for i in range(40)] + [(f"n{i}", -1, "x", 1) for i in range(9)] + [("x", 3, None, 0)] * 3 + [("y", 2, f"n{i}", -5) for i in range(6)] + [("y", 1, "x", -1)]
    entries = [(r, f"e{i}", v) for i, (a, x, b, y) in enumerate(ends) for r, v in ((a, x), (b, y)) if r]
    one = spark.createDataFrame(entries, "row string, col string, val long")
    marked = spark.createDataFrame([(f"e{i}",) for i in rng.choice(len(ends), 12, False)], "col string")
    apart, met = incidence.edge_pairs(one, marked, 2, 3)
    m = {r.col for r in marked.collect()}
    want = {(r.row, r.col): r.val for r in incidence.product(incidence.transposed(one), one).collect()}
    for df, held in ((apart, {k: v for k, v in want.items() if not m >= set(k)}), (met, {k: v for k, v in want.items() if m >= set(k)})):
        rows = df.collect()
        assert len(rows) == len(held) and {(r.row, r.col): r.val for r in rows} == held


def test_fans_are_not_broadcast(spark):
    chosen = spark.createDataFrame([(7, 0, 10, 1, 2), (7, 1, 11, 2, 1)], "key long, place int, event_id long, src long, dst long")
    one, two = incidence.fan_incidence(incidence.port_fan(chosen, "key"), "key")
    rows, plan = collected(incidence.fan_open(one, two, "key"))
    assert rows == []
    assert not [n for n, _ in plan if n.startswith("Broadcast")]
    broken = incidence.fan_open(one, two.withColumn("val", F.lit(1)), "key").collect()
    assert [(r.key, r.open > 0) for r in broken] == [(7, True)]


def test_cycle_counts_write_no_pairs_of_low_nodes(spark, monkeypatch):
    """Three hubs with 400 neighbours in common, 79,800 pairs of which share a hub; and a graph in which hubs are neighbours too, one node hanging from each."""
    rows = [(1, h, 10 + i) for h in range(3) for i in range(400)]
    rows += [(2, h, 10 + i) for h in range(4) for i in range(60) if (i + h) % 3] + [(2, 0, 1), (2, 1, 2), (2, 0, 3), (2, 0, 900), (2, 1, 901)]
    df = spark.createDataFrame(rows, "g int, u int, v int")
    written, write = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda t, name: written.append(write(t, name)) or written[-1])
    got = {(r.g, r.node): (r.cycles4, r.cycles5, r.cycles6) for r in graph.cycle_counts(df, ("g",)).collect()}
    assert max(t.count() for t in written) < 5_000
    n = 400
    assert {got[1, h] for h in range(3)} == {(n * (n - 1), 0, n * (n - 1) * (n - 2))}
    assert {got[1, 10 + i] for i in range(n)} == {(3 * (n - 1), 0, 3 * (n - 1) * (n - 2))}
    near = {}
    for g, u, v in rows:
        if g == 2:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for x in (0, 3, 10, 11, 12):
        assert got[2, x] == tuple(through(near, [x], k) // 2 for k in (4, 5, 6)), x


def test_motifs_list_no_triangles_and_count_alike_in_64_bits_and_38_digits(spark, monkeypatch):
    """Two worlds of hubs that are neighbours and low nodes on their triangles; the figures of every way of adding up are the same, and triangles are never listed."""
    rows = [(1, h, 10 + i) for h in range(4) for i in range(30) if (i + h) % 3] + [(1, a, b) for a in range(4) for b in range(a)]
    rows += [(2, 0, 10 + i) for i in range(20)] + [(2, 10 + i, 11 + i) for i in range(19)] + [(2, 50, 51), (2, 7, 7)]
    df = spark.createDataFrame(rows, "g int, src int, dst int")
    written, write = [], graph.staged
    monkeypatch.setattr(graph, "triangles", None)
    monkeypatch.setattr(graph, "staged", lambda t, name: written.append(name) or write(t, name))
    found = lambda: {(r.g, r.node): tuple(r)[2:] for r in graph.motifs(df, ("g",), 6).collect()}
    got = found()
    assert len(written) <= 9
    near = {}
    for g, u, v in rows:
        if u != v:
            near.setdefault((g, u), set()).add(v)
            near.setdefault((g, v), set()).add(u)
    assert got.keys() == near.keys()
    for g, x in [(1, 0), (1, 3), (1, 10), (1, 12), (2, 0), (2, 10), (2, 15), (2, 50)]:
        own = {k: v for (h, k), v in near.items() if h == g}
        n, three = len(own[x]), through(own, [x], 3) // 2
        assert got[g, x] == (n, three, 2 * three / (n * (n - 1)) if n > 1 else 0.0, *(through(own, [x], k) // 2 for k in (4, 5, 6))), (g, x)
    monkeypatch.setattr(graph, "FEW_HIGH", 0)
    monkeypatch.setattr(graph, "PRODUCTS", {"n2": 0})
    monkeypatch.setattr(graph, "MOST_SENT", 0)
    assert found() == got


def test_realization_has_tasks_by_rows(spark, monkeypatch):
    """Three thousand attempts, 500 rows for a task: each exchange has six tasks, where the session's number is four."""
    monkeypatch.setattr(joins, "dealt", lambda df, rows, *keys: dealt(df, rows, *keys, most=500))
    a = spark.range(3000).select(F.col("id").cast("string").alias("attempt"), F.floor(F.col("id") / 3).alias("alert"), (F.col("id") % 3).alias("arc"))
    e = a.where("alert < 900").select("attempt", F.timestamp_seconds(F.col("alert")).alias("time"))
    frame = (F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(10_000)))
    schedules = spark.range(1001).select(F.col("id").alias("alert"), F.lit(3).cast("long").alias("arcs"))
    rows, plan = collected(joins.realization(schedules, a, e, frame))
    got = {r.alert: tuple(r)[1:] for r in rows}
    assert len(got) == 1001 and got[1000] == (3, 0, 0, 0, False, False) and got[950] == (3, 3, 0, 0, False, False)
    assert got[99] == (3, 3, 3, 0, True, False) and got[100] == (3, 3, 3, 0, True, True)
    assert {p.outputPartitioning().numPartitions() for n, p in plan if n == "ShuffleExchangeExec"} == {6}


def through(near, path, length):
    """How many ways there are to go on from a path to a simple cycle of so many nodes."""
    if len(path) == length - 1:
        return sum(y not in path for y in near[path[0]] & near[path[-1]])
    return sum(through(near, [*path, y], length) for y in near[path[-1]] if y not in path)
