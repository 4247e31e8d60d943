"""Queries on graphs: cycles, capacities, neighbourhoods, motifs, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.operators import components, graph, metrics
from loomgraph.plans.relations import ARCS, NATION_ARCS, TRANSFERS, nation_arcs, transfers

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Arcs of the longest cycle of the census, and what it may hold: cycles, paths of a round, event tuples.
LONGEST, MOST_CYCLES, MOST_PATHS, MOST_TUPLES = 12, 20_000_000, 200_000_000, 50_000_000
BY = ("world",)

CYCLES = f"""WITH RECURSIVE {ARCS}, l AS (SELECT * FROM a WHERE (world, src) IN (SELECT (world, dst) FROM a) AND (world, dst) IN (SELECT (world, src) FROM a)),
w AS (SELECT world, [src, dst] AS path, dst AS at FROM l WHERE src < dst
 UNION ALL SELECT w.world, list_append(path, l.dst), l.dst FROM w JOIN l ON l.world = w.world AND l.src = w.at WHERE l.dst > path[1] AND NOT list_contains(path, l.dst) AND len(path) < {LONGEST}),
c AS (SELECT w.world, len(path) AS length, path AS cycle FROM w JOIN l ON l.world = w.world AND l.src = w.at AND l.dst = path[1])"""
#: The event tuples on the cycles of c.
TUPLES = """, q AS (SELECT world, src, dst, event_id FROM t WHERE src <> dst), s AS (SELECT world, length, cycle, CAST([] AS BIGINT[]) AS events FROM c
 UNION ALL SELECT s.world, s.length, s.cycle, list_append(s.events, q.event_id) FROM s JOIN q ON q.world = s.world AND q.src = s.cycle[len(s.events) + 1] AND q.dst = s.cycle[(len(s.events) + 1) % s.length + 1] WHERE len(s.events) < s.length),
k AS (SELECT * FROM s WHERE len(events) = length)"""


def census(spark, sf_dir):
    """The account cycles of each world, of 2 to LONGEST arcs, from all transfers."""
    return graph.cycles(graph.arcs(transfers(spark, sf_dir), BY), range(2, LONGEST + 1), MOST_CYCLES, BY, MOST_PATHS)


def tuples(spark, sf_dir):
    """The event tuples on the census."""
    return graph.event_tuples(census(spark, sf_dir), transfers(spark, sf_dir), MOST_TUPLES, BY)


@query(f"WITH {NATION_ARCS} SELECT x.src AS a, y.src AS b, z.src AS c, CAST(x.m * y.m * z.m AS DOUBLE) AS capacity FROM g x JOIN g y ON y.src = x.dst JOIN g z ON z.src = y.dst AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src AND y.src <> z.src")
def triangle_census(spark, sf_dir):
    """Directed triangles between nations from their least node, with their exact capacity."""
    g = nation_arcs(spark, sf_dir)
    c = graph.capacities(graph.cycles(g.select("src", "dst"), range(3, 4)), g)
    return c.select(F.col("cycle")[0].alias("a"), F.col("cycle")[1].alias("b"), F.col("cycle")[2].alias("c"), F.col("capacity").cast("double").alias("capacity"))


@query(CYCLES + " SELECT world, length, array_to_string(cycle, '-') AS cycle FROM c")
def account_cycles(spark, sf_dir):
    """Directed simple cycles of 2 to 12 accounts in each world."""
    return census(spark, sf_dir).select("world", F.col("length").cast("bigint").alias("length"), F.array_join("cycle", "-").alias("cycle"))


UNDIRECTED = f"""WITH RECURSIVE {ARCS}, u AS (SELECT DISTINCT world, least(src, dst) AS u, greatest(src, dst) AS v FROM a), tri AS (SELECT x.world, x.u AS a, x.v AS b, y.v AS c FROM u x JOIN u y ON x.world = y.world AND x.v = y.u JOIN u z ON z.world = x.world AND z.u = x.u AND z.v = y.v)"""


@query(UNDIRECTED + " SELECT world, a, b, c FROM tri")
def undirected_triangles(spark, sf_dir):
    """Undirected 3-cycles of each world."""
    return graph.triangles(graph.pairs(transfers(spark, sf_dir), BY), BY).select("world", F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("c"))


@query(CYCLES + """, e AS (SELECT world, length, cycle, unnest(generate_series(1, length)) AS i FROM c), k AS (SELECT e.world, e.length, e.cycle, product(a.m) AS capacity FROM e JOIN a ON a.world = e.world AND a.src = e.cycle[i] AND a.dst = e.cycle[CASE WHEN i = e.length THEN 1 ELSE i + 1 END] GROUP BY ALL)
SELECT world, length, count(*) AS n_cycles, CAST(sum(capacity) AS BIGINT) AS capacity FROM k GROUP BY ALL""")
def cycle_capacity(spark, sf_dir):
    """Cycles of each length in each world with the exact number of event tuples on them."""
    c = graph.capacities(census(spark, sf_dir), graph.arcs(transfers(spark, sf_dir), BY), BY)
    return c.groupBy("world", F.col("length").cast("bigint").alias("length")).agg(F.count("*").alias("n_cycles"), F.sum("capacity").cast("bigint").alias("capacity"))


@query(CYCLES + TUPLES + """ SELECT 'cand' || lpad(CAST(row_number() OVER (ORDER BY length, world, cycle, events) - 1 AS VARCHAR), 7, '0') AS candidate_id, world, array_to_string(cycle, '-') AS cycle, array_to_string(events, '-') AS events FROM k""")
def tuple_census(spark, sf_dir):
    """Every event tuple on every cycle, numbered in order of length, world, cycle and events."""
    numbered = with_ordinal(tuples(spark, sf_dir), ["length", "world", "cycle", "events"], "n")
    return numbered.select(F.concat(F.lit("cand"), F.lpad(F.col("n").cast("string"), 7, "0")).alias("candidate_id"), "world", F.array_join("cycle", "-").alias("cycle"), F.array_join("events", "-").alias("events"))


FAMILIES = CYCLES + TUPLES + """, y AS (SELECT world, length, cycle, count(*) AS capacity, count_if(good) AS positives FROM (SELECT k.world, k.length, k.cycle, k.events, bool_and(t.amount > 60) AS good FROM (SELECT *, unnest(events) AS event_id FROM k) k JOIN t USING (event_id) GROUP BY ALL) GROUP BY ALL),
i AS (SELECT world, length, cycle, unnest(generate_series(1, length)) AS i FROM c), dg AS (SELECT world, n AS node, count(*) AS degree FROM (SELECT world, src AS n FROM a UNION ALL SELECT world, dst FROM a) GROUP BY ALL),
h AS (SELECT i.world, i.length, i.cycle, sum(a.m) AS sum_m, max(a.m) AS max_m, sum(dg.degree) / count(*) AS mean_degree, max(dg.degree) AS max_degree FROM i JOIN a ON a.world = i.world AND a.src = i.cycle[i] AND a.dst = i.cycle[CASE WHEN i = i.length THEN 1 ELSE i + 1 END] JOIN dg ON dg.world = i.world AND dg.node = i.cycle[i] GROUP BY ALL),
z AS (SELECT k.world, unnest(['length', 'capacity', 'multiplicity_sum', 'multiplicity_max', 'degree_mean', 'degree_max']) AS q, unnest([k.length, y.capacity, h.sum_m, h.max_m, h.mean_degree, h.max_degree]::DOUBLE[]) AS v, g.good FROM k JOIN y USING (world, length, cycle) JOIN h USING (world, length, cycle)
 JOIN (SELECT x.world, x.events, bool_and(t.amount > 60) AS good FROM (SELECT world, events, unnest(events) AS event_id FROM k) x JOIN t USING (event_id) GROUP BY ALL) g ON g.world = k.world AND g.events = k.events),
sc AS (SELECT world, q || '_increasing' AS "column", -v AS s, good FROM z UNION ALL SELECT world, q || '_decreasing', v, good FROM z UNION ALL SELECT world, 'constant', 0, good FROM z WHERE q = 'length'),
bl AS (SELECT world, "column", s, count_if(good) AS p, count(*) AS m FROM sc GROUP BY ALL), cu AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS n, sum(p) OVER (PARTITION BY world, "column") AS ap, sum(m) OVER (PARTITION BY world, "column") AS am FROM bl WINDOW w AS (PARTITION BY world, "column" ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
"""


@query(FAMILIES + """SELECT world, "column", CAST(max(ap) AS VARCHAR) AS positives, CAST(max(am) - max(ap) AS VARCHAR) AS negatives, count(*) AS blocks, round(CASE WHEN max(ap) > 0 THEN sum(CAST(p * tp AS DOUBLE) / n) / max(ap) END, 9) AS ap, round(CASE WHEN max(ap) > 0 AND max(am) > max(ap) THEN CAST(sum(p * (2 * (am - ap - (n - tp)) + m - p)) AS DOUBLE) / (2 * max(ap) * (max(am) - max(ap))) END, 9) AS auroc FROM cu GROUP BY world, "column\"""")
def family_ranking(spark, sf_dir):
    """Six quantities of cycles in both directions, and a constant, as scores of all event tuples, those with large amounts alone being positive; from capacities, without a tuple. The SQL ranks the tuples themselves."""
    t = transfers(spark, sf_dir)
    families = graph.families(census(spark, sf_dir), t, F.col("amount") > 60, BY)
    told = metrics.exact_ranking(metrics.family_scores(families, ["world"]), ["world", "column"], weight=F.col("capacity"), positive=F.col("positives"))
    ratio = lambda c: F.round(F.col(f"{c}_numerator").cast("double") / F.col(f"{c}_denominator").cast("double"), 9).alias(c)
    return told.select("world", "column", *(F.col(c).cast("decimal(38,0)").cast("string").alias(c) for c in ("positives", "negatives")), "blocks", ratio("ap"), ratio("auroc"))


@query(f"""WITH RECURSIVE {TRANSFERS}, b AS (SELECT src, dst FROM t WHERE src <> dst UNION SELECT dst, src FROM t WHERE src <> dst), h AS (SELECT 7 AS node, 0 AS hops UNION SELECT b.dst, hops + 1 FROM h JOIN b ON b.src = h.node WHERE hops < 2)
SELECT CAST(node AS BIGINT) AS node, min(hops) AS hops FROM h GROUP BY node""")
def hop_neighbourhood(spark, sf_dir):
    """Accounts within two steps of account 7, in either direction."""
    return graph.within_hops(transfers(spark, sf_dir), spark.range(7, 8).select(F.col("id").alias("node")), 2)


@query(f"""WITH {TRANSFERS}, h AS (SELECT 7 AS node UNION SELECT dst FROM t WHERE src = 7 UNION SELECT src FROM t WHERE dst = 7)
SELECT event_id, src, dst FROM t WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)""")
def induced_events(spark, sf_dir):
    """Events among account 7 and its neighbours."""
    t = transfers(spark, sf_dir)
    near = graph.within_hops(t, spark.range(7, 8).select(F.col("id").alias("node")), 1)
    return graph.induced(t, near).select("event_id", "src", "dst")


@query(f"WITH {TRANSFERS} SELECT event_id, src, dst FROM t WHERE src = 7 OR dst = 7 ORDER BY event_id LIMIT 40")
def account_neighbourhood(spark, sf_dir):
    """The first forty events of account 7 in the order of the source."""
    return graph.neighbourhood(transfers(spark, sf_dir), 7, "event_id", 40).select("event_id", "src", "dst")


@query(UNDIRECTED + """, d AS (SELECT world, n AS node, count(*) AS degree FROM (SELECT world, u AS n FROM u UNION ALL SELECT world, v FROM u) GROUP BY ALL),
k AS (SELECT world, n AS node, count(*) AS t FROM (SELECT world, a AS n FROM tri UNION ALL SELECT world, b FROM tri UNION ALL SELECT world, c FROM tri) GROUP BY ALL),
l AS (SELECT world, u AS src, v AS dst FROM u UNION ALL SELECT world, v, u FROM u),
w AS (SELECT world, [src, dst] AS path, dst AS at FROM l WHERE src < dst UNION ALL SELECT w.world, list_append(path, l.dst), l.dst FROM w JOIN l ON l.world = w.world AND l.src = w.at WHERE l.dst > path[1] AND NOT list_contains(path, l.dst) AND len(path) < 6),
c AS (SELECT w.world, len(path) AS length, path AS cycle FROM w JOIN l ON l.world = w.world AND l.src = w.at AND l.dst = path[1] WHERE len(path) >= 4 AND path[2] < path[len(path)]),
o AS (SELECT world, node, count_if(length = 4) AS c4, count_if(length = 5) AS c5, count_if(length = 6) AS c6 FROM (SELECT world, length, unnest(cycle) AS node FROM c) GROUP BY ALL)
SELECT world, node, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END, 9) AS clustering, coalesce(c4, 0) AS cycles4, coalesce(c5, 0) AS cycles5, coalesce(c6, 0) AS cycles6 FROM d LEFT JOIN k USING (world, node) LEFT JOIN o USING (world, node)""")
def motif_census(spark, sf_dir):
    """Degree, triangles, local clustering and simple 4-, 5- and 6-cycles of every account in each world."""
    return graph.motifs(transfers(spark, sf_dir), BY, 6).withColumn("clustering", F.round("clustering", 9))


@query(f"""WITH {TRANSFERS}, m AS (SELECT kind, src, dst, count(*) AS m FROM t GROUP BY ALL)
SELECT x.kind, CAST(sum(x.m) AS BIGINT) AS n_events, count_if(x.src <> x.dst) AS n_arcs, count_if(x.src <> x.dst AND x.m > 1) AS n_parallel, count_if(y.m IS NOT NULL AND x.src < x.dst) AS n_reciprocal, CAST(sum(CASE WHEN x.src = x.dst THEN x.m ELSE 0 END) AS BIGINT) AS n_loops
FROM m x LEFT JOIN m y ON x.kind = y.kind AND x.src = y.dst AND x.dst = y.src GROUP BY x.kind""")
def arc_inventory(spark, sf_dir):
    """Parallel and reciprocal arcs and loops for each kind of event."""
    return graph.inventory(transfers(spark, sf_dir)).select("kind", *(F.col(c).cast("bigint").alias(c) for c in ("n_events", "n_arcs", "n_parallel", "n_reciprocal", "n_loops")))


@query(f"""WITH RECURSIVE {TRANSFERS}, u AS (SELECT DISTINCT world, src, dst + 1000000 AS dst FROM t), b AS (SELECT world, src, dst FROM u UNION SELECT world, dst, src FROM u), n AS (SELECT DISTINCT world, src AS node FROM b),
r AS (SELECT world, node, node AS root FROM n UNION SELECT r.world, r.node, b.dst FROM r JOIN b ON b.world = r.world AND b.src = r.root)
SELECT world, node, min(root) AS component FROM r GROUP BY ALL""")
def connected_groups(spark, sf_dir):
    """Groups of users and targets joined by events of a world, each named by its least member."""
    t = transfers(spark, sf_dir).select("world", "src", (F.col("dst") + 1_000_000).alias("dst"))
    key = lambda c: F.struct(F.col("world"), F.col(c).alias("node"))
    stars = components.stars(t.select(key("src").alias("a"), key("dst").alias("b")))
    nodes = t.select(F.explode(F.array(key("src"), key("dst"))).alias("a")).distinct()
    return nodes.join(stars, "a", "left").select("a.world", "a.node", F.coalesce("b.node", "a.node").alias("component"))


@query(UNDIRECTED + """ SELECT world, count(*) AS edges, (SELECT count(*) FROM (SELECT u AS x FROM u i WHERE i.world = u.world UNION SELECT v FROM u i WHERE i.world = u.world)) AS nodes, (SELECT count(*) FROM tri WHERE tri.world = u.world) AS triangles FROM u GROUP BY world""")
def skeleton_counts(spark, sf_dir):
    """Nodes, edges and triangles of each world's undirected skeleton."""
    e = graph.pairs(transfers(spark, sf_dir), BY)
    nodes = e.select("world", F.explode(F.array("u", "v")).alias("x")).groupBy("world").agg(F.count_distinct("x").alias("nodes"))
    three = graph.triangles(e, BY).groupBy("world").agg(F.count("*").alias("triangles"))
    return e.groupBy("world").agg(F.count("*").alias("edges")).join(nodes, "world").join(three, "world", "left").fillna(0, ["triangles"])
