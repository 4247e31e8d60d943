"""Queries with models: trees over candidate features, message passing with given weights, injected rings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.operators import boosting, features, graph, metrics, models, rings, splits
from loomgraph.plans.graphs import BY, MOST_CYCLES, MOST_PATHS
from loomgraph.plans.metrics import rounded
from loomgraph.plans.relations import SCORED, TRANSFERS, scored, transfers
from loomgraph.session import staged

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def tree_ranking(spark, sf_dir):
    """AP and AUROC, in each held-out day, of boosted trees over node features that tell errors from other kinds."""
    t = transfers(spark, sf_dir).withColumn("day", F.floor(F.col("hours") / 24))
    rows = features.node_features(t.withColumn("world", F.col("day")), ["world", "kind"]).withColumn("y", (F.col("kind") == "error").cast("int"))
    names = ["n_in", "n_out", "log_in", "log_out", "span", "n_events"]
    held = F.col("world") % 5 == 0
    model = models.fit_trees(models.world_weights(rows.where(~held)), names, weight="w", rounds=5)
    return metrics.ranking(models.score_trees(model, rows.where(held), "s"), ["world"])


OWN, OTHER, BIAS = np.array([[0.5, -1.0], [0.25, 0.5]]), np.array([[1.0, 0.5], [-0.5, 0.25]]), np.array([0.1, 0.2])


@query(f"""WITH {TRANSFERS}, e AS (SELECT kind, src, dst FROM t), d AS (SELECT kind, node, CAST(count_if(o = 0) AS DOUBLE) AS a, CAST(count_if(o = 1) AS DOUBLE) AS b FROM (SELECT kind, src AS node, 1 AS o FROM e UNION ALL SELECT kind, dst, 0 FROM e) GROUP BY ALL),
m AS (SELECT e.kind, e.dst AS node, avg(a) AS ma, avg(b) AS mb FROM e JOIN d ON d.kind = e.kind AND d.node = e.src GROUP BY ALL)
SELECT d.kind, d.node, round(greatest(0.0, 0.1 + 0.5 * a + coalesce(ma, 0) * 1.0 + 0.25 * b - coalesce(mb, 0) * 0.5), 6) AS h0, round(greatest(0.0, 0.2 - a + coalesce(ma, 0) * 0.5 + 0.5 * b + coalesce(mb, 0) * 0.25), 6) AS h1 FROM d LEFT JOIN m USING (kind, node)""")
def message_passing(spark, sf_dir):
    """One layer of mean message passing over the accounts' degrees, for each kind."""
    t = transfers(spark, sf_dir)
    f = features.node_features(t, ["kind"]).select("kind", "node", F.array(F.col("n_in").cast("double"), F.col("n_out").cast("double")).alias("h"))
    return rounded(models.message_layer(f, t, ["kind"], OWN, OTHER, BIAS).select("kind", "node", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")), "h0", "h1", places=6)


@query(f"WITH {SCORED} SELECT world, candidate, round(0.5 * greatest(0.0, s / 1000 - quality) - greatest(0.0, 1 - s / 1000 + 2 * quality) + 0.25, 6) AS logit FROM z")
def network_scores(spark, sf_dir):
    """A network of one hidden layer with given weights over length and quality."""
    z = scored(spark, sf_dir).select("world", "candidate", (F.col("s") / 1000).alias("a"), F.col("quality").cast("double").alias("b"))
    layers = [(np.array([[1.0, -1.0], [-1.0, 2.0]]), np.array([0.0, 1.0])), (np.array([[0.5], [-1.0]]), np.array([0.25]))]
    return rounded(models.score_mlp(z, ["a", "b"], layers).drop("a", "b"), "logit", places=6)


@query(f"WITH {TRANSFERS} SELECT kind, count(amount) AS n, min(amount) AS least, max(amount) AS most, round(avg(CASE WHEN abs(amount) >= 100 THEN 1.0 ELSE 0.0 END), 9) AS saturated FROM t GROUP BY kind")
def observed_values(spark, sf_dir):
    """Range and saturation of the amounts of each kind."""
    return rounded(models.observed(transfers(spark, sf_dir), ["kind"], "amount", 100.0), "saturated")


@query()
def leafwise_ranking(spark, sf_dir):
    """AP and AUROC, in each held-out day, of trees that grow leaf by leaf, after 5, 10 and 20 of them; they tell errors from other kinds by an account's numbers of a day and kind."""
    rows = features.node_features(transfers(spark, sf_dir), ["world", "kind"]).withColumn("y", (F.col("kind") == "error").cast("int"))
    rows = staged(rows, "accounts")
    names = ["n_in", "n_out", "log_in", "log_out", "span", "n_events"]
    held = F.col("world") % 5 == 0
    model = boosting.fit(models.world_weights(rows.where(~held)).withColumn("w", F.col("w") * 10_000), names, weight="w", rounds=20, leaves=7)
    rounds = [5, 10, 20]
    told = boosting.score(model, rows.where(held), rounds, "s").select("world", "y", F.posexplode("s").alias("at", "s"))
    ranked = metrics.ranking(told.withColumn("rounds", F.element_at(F.array(*map(F.lit, rounds)), F.col("at") + 1)), ["world", "rounds"])
    return rounded(ranked, "ap", "auroc", places=6)


def unit_sql(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(["'rings'", *parts]) + "), 1, 12) AS BIGINT) / 281474976710656.0"


#: Rings for each world of the table.
RINGS_A_WORLD = 3
RINGS = f"""q AS (SELECT CAST(range AS BIGINT) AS ring, [3, 4, 5, 6][CAST(floor({unit_sql("range", "'size'")} * 4) AS INTEGER) + 1] AS k FROM range((SELECT {RINGS_A_WORLD} * count(DISTINCT world) FROM t))), w0 AS (SELECT min(world) AS w FROM t),
o AS (SELECT ring, k, (SELECT list(DISTINCT world ORDER BY world) FROM t)[ring % (SELECT count(DISTINCT world) FROM t) + 1] AS world, unnest(generate_series(0, k - 1)) AS i FROM q, w0), x AS (SELECT world, 'ring_' || ring || '_' || i AS src, 'ring_' || ring || '_' || ((i + 1) % k) AS dst, ring FROM o),
j AS (SELECT world, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, NULL AS ring FROM t UNION ALL SELECT world, '7', src, NULL FROM x WHERE ends_with(src, '_0') UNION ALL SELECT * FROM x),
l AS (SELECT DISTINCT world, src, dst FROM j WHERE src <> dst), w AS (SELECT world, [src, dst] AS path, dst AS at FROM l WHERE src < dst
 UNION ALL SELECT w.world, list_append(path, l.dst), l.dst FROM w JOIN l ON l.world = w.world AND l.src = w.at WHERE l.dst > path[1] AND NOT list_contains(path, l.dst) AND len(path) < 6),
c AS (SELECT w.world, len(path) AS length, path AS cycle FROM w JOIN l ON l.world = w.world AND l.src = w.at AND l.dst = path[1] WHERE len(path) >= 3),
m AS (SELECT e.world, e.length, e.cycle, count_if(x.ring IS NULL) AS bare, count(x.ring) AS some_, count(DISTINCT x.ring) AS rings FROM (SELECT *, unnest(generate_series(1, length)) AS i FROM c) e LEFT JOIN x ON x.world = e.world AND x.src = e.cycle[i] AND x.dst = e.cycle[i % length + 1] GROUP BY ALL)"""


def ring_worlds(t):
    """(world, ring): three rings for each world, dealt to the worlds in turn."""
    numbered = with_ordinal(t.select("world").distinct(), ["world"], "at")
    many = numbered.agg(F.count("*").alias("n"))
    return numbered.join(F.broadcast(many)).select("world", F.explode(F.sequence(F.lit(0), F.lit(RINGS_A_WORLD - 1))).alias("k"), "at", "n").select("world", (F.col("at") + F.col("k") * F.col("n")).alias("ring"))


@query(f"WITH RECURSIVE {TRANSFERS}, {RINGS} SELECT world, length, array_to_string(cycle, '-') AS cycle, CAST(bare = 0 AND rings = 1 AS INTEGER) AS label FROM m WHERE (bare = 0 AND rings = 1) OR some_ = 0")
def injected_rings(spark, sf_dir):
    """Rings injected into all transfers, three in a world, and the cycles of 3 to 6 arcs that a blind search of the joined graph finds, labelled."""
    t = transfers(spark, sf_dir)
    bridges = ring_worlds(t).select("world", "ring", F.lit("7").alias("src"))
    own = t.select("world", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("hours").alias("time"), "amount")
    found = rings.ring_pool(own, rings.rings_of(bridges), bridges, range(3, 7), MOST_CYCLES, MOST_PATHS, BY)
    return found.select("world", F.col("length").cast("bigint").alias("length"), F.array_join("cycle", "-").alias("cycle"), "label")


@query(f"WITH RECURSIVE {TRANSFERS}, {RINGS} SELECT ring, CAST(k AS BIGINT) AS hops, CAST(0 AS BIGINT) AS faults FROM q")
def conserved_rings(spark, sf_dir):
    """What breaks the flow of each injected ring: nothing."""
    return splits.flow_faults(rings.rings_of(ring_worlds(transfers(spark, sf_dir))), "ring", "place").select("ring", "hops", (F.col("gap") + F.col("time") + F.col("growth") + F.col("fee")).alias("faults"))


DEGREES = f"""{TRANSFERS}, d AS (SELECT world, node, CAST(count_if(o = 0) AS DOUBLE) AS a, CAST(count_if(o = 1) AS DOUBLE) AS b FROM (SELECT world, src AS node, 1 AS o FROM t UNION ALL SELECT world, dst, 0 FROM t) GROUP BY ALL),
u AS (SELECT world, src, dst FROM t UNION ALL SELECT world, node, node FROM d)"""


def world_degrees(spark, sf_dir):
    t = transfers(spark, sf_dir)
    return features.node_features(t, ["world"]).select("world", "node", F.array((F.col("n_in") / 10).cast("double"), (F.col("n_out") / 10).cast("double")).alias("h")), t


@query(f"""WITH {DEGREES}, o AS (SELECT world, src, count(*) AS n FROM u GROUP BY ALL), i AS (SELECT world, dst, count(*) AS n FROM u GROUP BY ALL),
s AS (SELECT u.world, u.dst AS node, sum((0.5 * a + 0.25 * b) / 10 / sqrt(o.n * i.n)) AS x, sum((0.5 * b - a) / 10 / sqrt(o.n * i.n)) AS y FROM u JOIN d ON d.world = u.world AND d.node = u.src JOIN o ON o.world = u.world AND o.src = u.src JOIN i ON i.world = u.world AND i.dst = u.dst GROUP BY ALL)
SELECT world, node, round(x + 0.1, 6) AS h0, round(y + 0.2, 6) AS h1 FROM s""")
def degree_convolution(spark, sf_dir):
    """One directed convolution over the accounts' degrees in each world."""
    nodes, t = world_degrees(spark, sf_dir)
    return rounded(models.degree_layer(nodes, t, ["world"], OWN, BIAS).select("world", "node", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")), "h0", "h1", places=6)


@query(f"""WITH {DEGREES}, h AS (SELECT world, node, (0.5 * a + 0.25 * b) / 10 AS x, (0.5 * b - a) / 10 AS y FROM d), e AS (SELECT u.world, u.dst, s.x, s.y, s.x + 0.5 * z.x AS ex, 0.25 * s.y - z.y AS ey FROM u JOIN h s ON s.world = u.world AND s.node = u.src JOIN h z ON z.world = u.world AND z.node = u.dst),
l AS (SELECT world, dst, x, y, CASE WHEN ex >= 0 THEN ex ELSE 0.2 * ex END AS ex, CASE WHEN ey >= 0 THEN ey ELSE 0.2 * ey END AS ey FROM e)
SELECT world, dst AS node, round(sum(exp(ex) * x) / sum(exp(ex)) + 0.1, 6) AS h0, round(sum(exp(ey) * y) / sum(exp(ey)) + 0.2, 6) AS h1 FROM l GROUP BY ALL""")
def graph_attention(spark, sf_dir):
    """One layer of attention with two heads over the accounts' degrees in each world."""
    nodes, t = world_degrees(spark, sf_dir)
    made = models.attention_layer(nodes, t, ["world"], OWN, np.array([[1.0], [0.25]]), np.array([[0.5], [-1.0]]), BIAS)
    return rounded(made.select("world", "node", F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")), "h0", "h1", places=6)


@query(f"""WITH {TRANSFERS}, e AS (SELECT world, log10(greatest(amount, 0) + 1) AS a, hours - min(hours) OVER (PARTITION BY world) AS s FROM t) SELECT world, round(avg(a), 6) AS amount_mean, round(avg(s), 6) AS since_mean, round(max(a), 6) AS amount_max, CAST(max(s) AS DOUBLE) AS since_max FROM e GROUP BY world""")
def edge_pool(spark, sf_dir):
    """Means and maxima of the edge features of each world."""
    p = models.edge_pooled(features.edge_features(transfers(spark, sf_dir), ["world"]), ["world"])
    names = ("amount_mean", "since_mean", "amount_max", "since_max")
    return rounded(p.select("world", *(F.col("pooled")[i].alias(n) for i, n in enumerate(names))), *names, places=6)


#: Width of the networks, and their weights by number of layer.
WIDTH = 24


def weights(k: int, rows: int, cols: int) -> np.ndarray:
    i, j = np.indices((rows, cols))
    return ((7 * i + 13 * j + 5 * k) % 11 - 5) / 20.0


def shifts(k: int, cols: int) -> np.ndarray:
    return ((3 * np.arange(cols) + k) % 7 - 3) / 10.0


def layers(**shapes: tuple[int, int]) -> dict[str, np.ndarray]:
    """The weights and shifts of named layers, numbered in order."""
    out = {n: weights(k, *shape) for k, (n, shape) in enumerate(shapes.items())}
    return out | {f"{n}_b": shifts(k, shape[1]) for k, (n, shape) in enumerate(shapes.items())}


def dense_sql(x: str, k: int, rows: int, cols: int = WIDTH, act: str = "tanh", bias: bool = True) -> str:
    shift = f"((3 * j + {k}) % 7 - 3) / 10.0::DOUBLE" if bias else "0"
    return f"list_transform(range(0, {cols}), lambda j: {act}(list_sum(list_transform(range(0, {rows}), lambda i: ({x})[i + 1] * (((7 * i + 13 * j + {5 * k}) % 11 - 5) / 20.0::DOUBLE))) + {shift}))"


def add_sql(a: str, b: str) -> str:
    return f"list_transform(range(0, {WIDTH}), lambda i: ({a})[i + 1] + ({b})[i + 1])"


def sums_sql(name: str, source: str, x: str, by: str, how: str = "sum", weight: str = "1") -> str:
    """A relation of sums or means of the components of x."""
    return f"{name} AS (SELECT {by}, list(v ORDER BY i) AS m FROM (SELECT {by}, i, {how}(({x})[i] * {weight}) AS v FROM {source}, (SELECT unnest(generate_series(1, {WIDTH})) AS i) GROUP BY {by}, i) GROUP BY {by})"


ZEROS = f"list_transform(range(0, {WIDTH}), lambda i: 0.0::DOUBLE)"
#: Each world as a candidate: accounts below 50 lie on its cycle, events above 60 are chosen.
CANDIDATES = f"{TRANSFERS}, ed AS (SELECT world, event_id AS edge, src, dst, [ln(1 + greatest(amount, 0)), (hours % 24) / 24, 1.0]::DOUBLE[] AS e, CAST(amount > 60 AS DOUBLE) AS chosen FROM t), nd AS (SELECT world, n AS node, CAST(n < 50 AS DOUBLE) AS v FROM (SELECT DISTINCT world, src AS n FROM t UNION SELECT world, dst FROM t)), cd AS (SELECT world, sum(chosen) AS length FROM ed GROUP BY world)"


def candidates(spark, sf_dir):
    t = transfers(spark, sf_dir)
    e = t.select("world", F.col("event_id").alias("edge"), "src", "dst", F.array(F.log1p(F.greatest("amount", F.lit(0.0))), (F.col("hours") % 24) / 24, F.lit(1.0)).alias("e"), (F.col("amount") > 60).cast("double").alias("chosen"))
    nodes = t.select("world", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("v", (F.col("node") < 50).cast("double"))
    return nodes, e, e.groupBy("world").agg(F.sum("chosen").alias("length"))


@query(f"""WITH {CANDIDATES}, hv AS (SELECT world, node, {dense_sql('[v]', 0, 1)} AS h FROM nd), fc AS (SELECT world, {dense_sql('[length]', 1, 1)} AS f0 FROM cd),
mt AS (SELECT ed.world, chosen, e, f0, a.h AS hs, b.h AS hd, CASE WHEN src = dst THEN {ZEROS} ELSE {add_sql('a.h', 'b.h')} END AS ends FROM ed JOIN hv a ON a.world = ed.world AND a.node = src JOIN hv b ON b.world = ed.world AND b.node = dst JOIN fc ON fc.world = ed.world),
lo AS (SELECT *, {dense_sql('hs', 3, WIDTH, act='', bias=False)} AS x, {dense_sql('hd', 4, WIDTH, act='', bias=False)} AS y, {dense_sql('e', 2, 3)} AS z FROM mt), pr AS (SELECT world, chosen, f0, list_concat(list_concat(z, list_transform(range(0, {WIDTH}), lambda i: ends[i + 1] + (x[i + 1] + y[i + 1]))), list_transform(f0, lambda q: q * chosen)) AS parts FROM lo),
he AS (SELECT world, chosen, f0, {dense_sql('parts', 5, 3 * WIDTH)} AS he FROM pr), {sums_sql('mean', 'he', 'he', 'world', 'avg')}, {sums_sql('up', 'he', 'he', 'world', 'sum', 'chosen')}
, fu AS (SELECT mean.world, mean.m AS m, {dense_sql('list_concat(fc.f0, up.m)', 6, 2 * WIDTH)} AS hf FROM mean JOIN up USING (world) JOIN fc USING (world)), q AS (SELECT world, {add_sql('hf', 'm')} AS r FROM fu)
SELECT world, round(({dense_sql('r', 7, WIDTH, 1, '')})[1], 6) AS logit FROM q""")
def cell_network_scores(spark, sf_dir):
    """A network over nodes, edges and one cell for each world, 24 wide, with given weights."""
    nodes, edges, cells = candidates(spark, sf_dir)
    w = layers(node=(1, WIDTH), face=(1, WIDTH), edge=(3, WIDTH), src=(WIDTH, WIDTH), dst=(WIDTH, WIDTH), eu=(3 * WIDTH, WIDTH), fu=(2 * WIDTH, WIDTH), out=(WIDTH, 1))
    return rounded(models.cell_network(nodes, edges.withColumnRenamed("chosen", "face"), cells, w, "world"), "logit", places=6)


@query(f"""WITH {CANDIDATES}, h1 AS (SELECT world, node, v, {dense_sql('[v]', 0, 1)} AS h FROM nd), mt AS (SELECT ed.world, src, dst, {dense_sql('list_concat(b.h, e)', 1, WIDTH + 3)} AS o, {dense_sql('list_concat(a.h, e)', 2, WIDTH + 3)} AS i_ FROM ed JOIN h1 a ON a.world = ed.world AND a.node = src JOIN h1 b ON b.world = ed.world AND b.node = dst),
{sums_sql('ou', 'mt', 'o', 'world, src')}, {sums_sql('im', 'mt', 'i_', 'world, dst')}, h2 AS (SELECT h1.world, h1.node, v, {dense_sql(f'list_concat(list_concat(h1.h, coalesce(im.m, {ZEROS})), coalesce(ou.m, {ZEROS}))', 3, 3 * WIDTH)} AS h FROM h1 LEFT JOIN ou ON ou.world = h1.world AND ou.src = node LEFT JOIN im ON im.world = h1.world AND im.dst = node),
rd AS (SELECT ed.world, chosen, {dense_sql('list_concat(h2.h, e)', 4, WIDTH + 3)} AS x FROM ed JOIN h2 ON h2.world = ed.world AND h2.node = src), {sums_sql('nr', 'h2', 'h', 'world', 'sum', 'v')}, {sums_sql('er', 'rd', 'x', 'world', 'sum', 'chosen')},
q AS (SELECT cd.world, list_concat(list_concat(list_transform(nr.m, lambda x: x / ((SELECT sum(v) FROM h2 WHERE h2.world = cd.world) + 1e-6)), list_transform(er.m, lambda x: x / (cd.length + 1e-6))), [cd.length]) AS r FROM cd JOIN nr USING (world) JOIN er USING (world))
SELECT world, round(({dense_sql('r', 5, 2 * WIDTH + 1, 1, '')})[1], 6) AS logit FROM q""".replace("lambda x: x / ((SELECT sum(v) FROM h2 WHERE h2.world = cd.world) + 1e-6)", "lambda x: x / (sv + 1e-6)").replace("FROM cd JOIN nr USING (world)", "FROM cd JOIN nr USING (world) JOIN (SELECT world, sum(v) AS sv FROM h2 GROUP BY world) USING (world)"))
def directed_network_scores(spark, sf_dir):
    """A network that passes messages along and against each event of a world, 24 wide, with given weights."""
    nodes, edges, cells = candidates(spark, sf_dir)
    w = layers(n=(1, WIDTH), om=(WIDTH + 3, WIDTH), im=(WIDTH + 3, WIDTH), up=(3 * WIDTH, WIDTH), er=(WIDTH + 3, WIDTH), read=(2 * WIDTH + 1, 1))
    return rounded(models.directed_network(nodes, edges, cells, w, "world"), "logit", places=6)


@query(f"""WITH {CANDIDATES}, u AS (SELECT world, least(src, dst) AS src, greatest(src, dst) AS dst, [ln(1 + greatest(sum(amount), 0)), count(*), 1.0]::DOUBLE[] AS e, ln(1 + greatest(sum(amount), 0)) AS la FROM t WHERE src <> dst GROUP BY ALL),
tr AS (SELECT x.world, x.src AS a, x.dst AS b, y.dst AS c, (x.la + y.la + z.la) / 3 AS f FROM u x JOIN u y ON x.world = y.world AND x.dst = y.src JOIN u z ON z.world = x.world AND z.src = x.src AND z.dst = y.dst), sd AS (SELECT world, a, b, c, unnest([a, a, b]) AS src, unnest([b, c, c]) AS dst FROM tr),
hv AS (SELECT world, node, {dense_sql('[v]', 0, 1)} AS h FROM nd WHERE (world, node) IN (SELECT (world, src) FROM u UNION SELECT (world, dst) FROM u)), mt AS (SELECT u.world, src, dst, {dense_sql('e', 1, 3)} AS r, {add_sql('a.h', 'b.h')} AS ends FROM u JOIN hv a ON a.world = u.world AND a.node = src JOIN hv b ON b.world = u.world AND b.node = dst),
he AS (SELECT world, src, dst, {dense_sql('list_concat(r, ends)', 2, 2 * WIDTH)} AS he FROM mt), ar AS (SELECT world, src AS node, he FROM he UNION ALL SELECT world, dst, he FROM he), {sums_sql('an', 'ar', 'he', 'world, node')},
v2 AS (SELECT hv.world, {dense_sql('list_concat(h, an.m)', 3, 2 * WIDTH)} AS x FROM hv JOIN an ON an.world = hv.world AND an.node = hv.node), se AS (SELECT sd.*, he FROM sd JOIN he USING (world, src, dst)), {sums_sql('up', 'se', 'he', 'world, a, b, c')},
f1 AS (SELECT world, a, b, c, {dense_sql('[f]', 4, 1)} AS f0 FROM tr), f2 AS (SELECT world, {dense_sql('list_concat(f0, up.m)', 5, 2 * WIDTH)} AS x FROM f1 JOIN up USING (world, a, b, c)), {sums_sql('ma', 'v2', 'x', 'world', 'avg')}, {sums_sql('mb', 'f2', 'x', 'world', 'avg')},
q AS (SELECT ma.world, {add_sql('ma.m', 'mb.m')} AS r FROM ma JOIN mb USING (world)) SELECT world, round(({dense_sql('r', 6, WIDTH, 1, '')})[1], 6) AS logit FROM q""")
def simplicial_network_scores(spark, sf_dir):
    """A network over the accounts, undirected edges and triangles of a world, 24 wide, with given weights."""
    nodes, _, _ = candidates(spark, sf_dir)
    name = lambda *c: F.concat_ws("-", *c)
    e = staged(features.simplicial_view(transfers(spark, sf_dir), ["world"]), "edges")
    three = staged(graph.triangles(e.select("world", "u", "v"), ("world",)), "triangles")
    faces = features.simplicial_faces(e, three, ["world"], lambda c: F.lit(False)).select("world", name("u", "v", "w").alias("face"), F.col("mean_log").alias("f"))
    sides = three.select("world", name("u", "v", "w").alias("face"), F.explode(F.array(name("u", "v"), name("u", "w"), name("v", "w"))).alias("edge"))
    edges = e.select("world", name("u", "v").alias("edge"), F.col("u").alias("src"), F.col("v").alias("dst"), F.array("log_amount", F.col("n").cast("double"), F.lit(1.0)).alias("e"))
    inside = nodes.join(e.select("world", F.explode(F.array("u", "v")).alias("node")).distinct(), ["world", "node"]).select("world", "node", F.array("v").alias("v"))
    w = layers(v=(1, WIDTH), rel=(3, WIDTH), e=(2 * WIDTH, WIDTH), vu=(2 * WIDTH, WIDTH), f=(1, WIDTH), fu=(2 * WIDTH, WIDTH), out=(WIDTH, 1))
    return rounded(models.simplicial_network(inside, edges, faces, sides, w, "world"), "logit", places=6)
