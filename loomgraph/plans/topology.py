"""Queries on features, incidence and persistence of the transfer graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import components, features, graph, incidence, persistence
from loomgraph.plans.graphs import BY, CYCLES, LONGEST, MOST_CYCLES, MOST_PATHS, TUPLES, UNDIRECTED, tuples
from loomgraph.plans.metrics import rounded
from loomgraph.plans.relations import ARCS, TRANSFERS, transfers
from loomgraph.session import staged, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


ENDS = "x AS (SELECT kind, hours, amount, src AS node, 1 AS o FROM t UNION ALL SELECT kind, hours, amount, dst, 0 FROM t)"
NODES = f"""{TRANSFERS}, {ENDS}, f AS (SELECT kind, node, count_if(o = 0) AS n_in, count_if(o = 1) AS n_out, log10(coalesce(sum(CASE WHEN o = 0 THEN greatest(amount, 0) END), 0) + 1) AS log_in, log10(coalesce(sum(CASE WHEN o = 1 THEN greatest(amount, 0) END), 0) + 1) AS log_out, min(hours) AS first, max(hours) AS last, max(hours) - min(hours) AS span, count(*) AS n_events FROM x GROUP BY kind, node)"""


@query(f"WITH {NODES} SELECT kind, node, n_in, n_out, round(log_in, 7) AS log_in, round(log_out, 7) AS log_out, first - min(first) OVER (PARTITION BY kind) AS first, last - min(first) OVER (PARTITION BY kind) AS last, span, n_events FROM f")
def node_features(spark, sf_dir):
    """Eight features of every account for each kind of event, times from the kind's first."""
    f = features.node_features(transfers(spark, sf_dir), ["kind"])
    return rounded(features.relative_times(f, ["kind"], ["first", "last"]), "log_in", "log_out", places=7)


@query(f"WITH {NODES}, l AS (SELECT kind, node, coalesce(sum(CASE WHEN o = 0 THEN ln(1 + greatest(amount, 0)) END), 0) AS flow_in, coalesce(sum(CASE WHEN o = 1 THEN ln(1 + greatest(amount, 0)) END), 0) AS flow_out FROM x GROUP BY kind, node) SELECT kind, node, n_in, n_out, round(flow_in, 6) AS flow_in, round(flow_out, 6) AS flow_out, CAST(node < 5 AS INTEGER) AS in_cycle, round(n_in / (n_in + n_out + 1e-6), 9) AS in_share FROM f JOIN l USING (kind, node)")
def graph_view(spark, sf_dir):
    """Six features of every account, with the first five as the cycle."""
    g = features.graph_view(transfers(spark, sf_dir), ["kind"], F.col("node") < 5)
    return rounded(rounded(g, "flow_in", "flow_out", places=6), "in_share")


@query(f"WITH {TRANSFERS} SELECT kind, event_id, src, dst, round(ln(1 + greatest(amount, 0)), 9) AS log_amount, amount, CAST(src < 5 AND dst < 5 AS INTEGER) AS in_cycle FROM t")
def graph_view_edges(spark, sf_dir):
    """Three features of every event, with the first five accounts as the cycle."""
    return rounded(features.graph_view_edges(transfers(spark, sf_dir), ["kind"], lambda c: c < 5), "log_amount")


@query(f"WITH {TRANSFERS}, a AS (SELECT kind, src, dst, count(*) AS m, min(hours) AS first FROM t WHERE src <> dst GROUP BY ALL) SELECT kind, src, dst, m, round(ln(1 + m), 9) AS log_m, first - min(first) OVER (PARTITION BY kind) AS since FROM a")
def cell_view(spark, sf_dir):
    """Arcs with their multiplicity and first time."""
    return rounded(features.cell_view(transfers(spark, sf_dir), ["kind"]), "log_m")


SKELETON = f"{TRANSFERS}, e AS (SELECT kind, least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS n, sum(amount) AS amount FROM t WHERE src <> dst GROUP BY ALL)"


@query(f"WITH {SKELETON} SELECT kind, u, v, n, round(amount, 4) AS amount, round(ln(1 + greatest(amount, 0)), 9) AS log_amount, CAST(u < 5 AND v < 5 AS INTEGER) AS in_cycle FROM e")
def simplicial_view(spark, sf_dir):
    """Undirected edges with their events, amounts and whether they lie on the first five accounts."""
    return rounded(rounded(features.simplicial_view(transfers(spark, sf_dir), ["kind"], lambda c: c < 5), "amount", places=4), "log_amount")


@query(f"WITH {TRANSFERS}, e AS (SELECT world, least(src, dst) AS u, greatest(src, dst) AS v, sum(amount) AS amount, ln(1 + greatest(sum(amount), 0)) AS la FROM t WHERE src <> dst GROUP BY ALL) SELECT x.world, x.u, x.v, y.v AS w, round((x.la + y.la + z.la) / 3, 8) AS mean_log, round(x.amount + y.amount + z.amount, 4) AS amount, CAST(x.u < 50 AND x.v < 50 AND y.v < 50 AS INTEGER) AS in_cycle FROM e x JOIN e y ON x.world = y.world AND x.v = y.u JOIN e z ON z.world = x.world AND z.u = x.u AND z.v = y.v")
def simplicial_faces(spark, sf_dir):
    """Three features of every triangle of a world, with the first fifty accounts as the cycle."""
    t, inside = transfers(spark, sf_dir), lambda c: c < 50
    e = staged(features.simplicial_view(t, ["world"], inside), "edges")
    f = features.simplicial_faces(e, graph.triangles(e.select("world", "u", "v"), BY), ["world"], inside)
    return rounded(rounded(f, "amount", places=4), "mean_log", places=8)


SELECTED = CYCLES + TUPLES + """, x AS (SELECT world, world || ':' || array_to_string(cycle, '-') || ':' || array_to_string(events, '-') AS candidate, unnest(events) AS event_id FROM k),
r AS (SELECT x.candidate, t.world, t.src, t.dst, t.hours, t.amount, t.kind, ln(1 + t.amount) AS la FROM x JOIN t USING (event_id))"""


def selected(spark, sf_dir):
    """world, candidate and the columns of its events, a row for each event of every candidate of the census."""
    name = F.concat(F.col("world").cast("string"), F.lit(":"), F.array_join("cycle", "-"), F.lit(":"), F.array_join("events", "-"))
    return tuples(spark, sf_dir).select(name.alias("candidate"), F.explode("events").alias("event_id")).join(transfers(spark, sf_dir), "event_id")


@query(SELECTED + """, e AS (SELECT candidate, count(*) AS length, min(hours) AS t0, avg(hours) AS t1, max(hours) AS t2, stddev_pop(hours) AS t3, min(la) AS a0, avg(la) AS a1, max(la) AS a2, stddev_pop(la) AS a3 FROM r GROUP BY candidate),
o AS (SELECT world, src AS node, count(*) AS n FROM t GROUP BY ALL), i AS (SELECT world, dst AS node, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT world, src, dst, count(*) AS m FROM t GROUP BY ALL),
n AS (SELECT DISTINCT candidate, world, src AS node FROM r UNION SELECT candidate, world, dst FROM r), d AS (SELECT candidate, min(coalesce(i.n, 0)) AS i0, avg(coalesce(i.n, 0)) AS i1, max(coalesce(i.n, 0)) AS i2, min(coalesce(o.n, 0)) AS o0, avg(coalesce(o.n, 0)) AS o1, max(coalesce(o.n, 0)) AS o2 FROM n LEFT JOIN o USING (world, node) LEFT JOIN i USING (world, node) GROUP BY candidate),
h AS (SELECT candidate, min(m.m) AS m0, avg(m.m) AS m1, max(m.m) AS m2 FROM r JOIN m USING (world, src, dst) GROUP BY candidate)
SELECT candidate, length, CAST(t0 AS DOUBLE) AS time_min, round(t1, 6) AS time_mean, CAST(t2 AS DOUBLE) AS time_max, round(t3, 6) AS time_sd, CAST(t2 - t0 AS DOUBLE) AS time_span, round(a0, 6) AS log_amount_min, round(a1, 6) AS log_amount_mean, round(a2, 6) AS log_amount_max, round(a3, 6) AS log_amount_sd, round(a2 - a0, 6) AS log_amount_span, i0 AS n_in_min, round(i1, 6) AS n_in_mean, i2 AS n_in_max, o0 AS n_out_min, round(o1, 6) AS n_out_mean, o2 AS n_out_max, m0 AS m_min, round(m1, 6) AS m_mean, m2 AS m_max FROM e JOIN d USING (candidate) JOIN h USING (candidate)""")
def candidate_summary(spark, sf_dir):
    """The fixed twenty columns of every candidate of the census."""
    made = features.candidate_summary(selected(spark, sf_dir), transfers(spark, sf_dir), BY)
    return rounded(made, *(c for c, k in made.dtypes if k == "double" and c not in ("time_min", "time_max", "time_span")), places=6)


@query(SELECTED + ", s2 AS (SELECT world, candidate, max(hours) - min(hours) AS span FROM r GROUP BY ALL) SELECT world, span < 12 AS short, count(*) AS n, min(span) AS least FROM s2 GROUP BY ALL")
def span_rule(spark, sf_dir):
    """Candidates of each world by whether their events lie within twelve hours."""
    s = selected(spark, sf_dir).groupBy("world", "candidate").agg((F.max("hours") - F.min("hours")).alias("span"))
    return s.groupBy("world", (F.col("span") < 12).alias("short")).agg(F.count("*").alias("n"), F.min("span").alias("least"))


@query(SELECTED + """, y AS (SELECT world, candidate, count(*) AS length, max(CAST(kind = 'error' AS INTEGER)) AS y, min(amount) AS low, max(amount) AS high, min(hours) AS f, max(hours) AS l FROM r GROUP BY ALL)
SELECT world, length, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 9) AS prevalence, min(low) AS amount_min, max(high) AS amount_max, min(f) AS first, max(l) AS last FROM y GROUP BY ALL""")
def shortcut_profile(spark, sf_dir):
    """Candidates of each world by length: prevalence of those with an error, ranges of amounts and times."""
    s = selected(spark, sf_dir).withColumn("y", (F.col("kind") == "error").cast("int"))
    return rounded(features.shortcut_profile(s, ["world"]), "prevalence")


@query(CYCLES + TUPLES + """, v AS (SELECT world, node, row_number() OVER (PARTITION BY world ORDER BY node) - 1 AS place FROM (SELECT world, src AS node FROM t UNION SELECT world, dst FROM t)), f AS (SELECT world, event_id, row_number() OVER (PARTITION BY world ORDER BY event_id) - 1 AS place FROM t),
kk AS (SELECT world, cycle, events, array_to_string(cycle, '-') || ':' || array_to_string(events, '-') AS candidate FROM k),
kn AS (SELECT candidate, kk.world, list_sort(list(v.place)) AS p FROM (SELECT candidate, world, unnest(cycle) AS node FROM kk) kk JOIN v USING (world, node) GROUP BY ALL), ke AS (SELECT candidate, kk.world, list_sort(list(f.place)) AS p FROM (SELECT candidate, world, unnest(events) AS event_id FROM kk) kk JOIN f USING (world, event_id) GROUP BY ALL)
SELECT kn.world, candidate, array_to_string(kn.p, ' ') AS node_places, array_to_string(ke.p, ' ') AS event_places FROM kn JOIN ke USING (world, candidate)""")
def observation_masks(spark, sf_dir):
    """Every candidate's nodes and events as places in the order of its world: the ones of its masks."""
    t = transfers(spark, sf_dir)
    name = F.concat(F.array_join("cycle", "-"), F.lit(":"), F.array_join("events", "-"))
    k = tuples(spark, sf_dir).select("world", name.alias("candidate"), "cycle", "events")
    nodes = t.select("world", F.explode(F.array("src", "dst")).alias("x")).distinct()
    one = features.places(k.select("world", "candidate", F.explode("cycle").alias("x")), nodes, "world", "candidate", "node_places")
    return one.join(features.places(k.select("world", "candidate", F.explode("events").alias("x")), t.select("world", F.col("event_id").alias("x")), "world", "candidate", "event_places"), ["world", "candidate"])


@query(f"""WITH {TRANSFERS}, w AS (SELECT min(hours) AS h0, max(hours) AS h1 FROM t) SELECT event_id, round(CAST(hours - h0 AS DOUBLE) / (h1 - h0 + 1), 9) AS step, round(ln(1 + amount), 9) AS log_amount FROM t, w""")
def observed_events(spark, sf_dir):
    """Every event's step as a share of all steps, and its amount's log."""
    return rounded(features.observed_events(transfers(spark, sf_dir)), "step", "log_amount")


@query(f"""WITH {TRANSFERS} SELECT kind, event_id, round(log10(greatest(amount, 0) + 1), 9) AS log_amount, hours - min(hours) OVER (PARTITION BY kind) AS since FROM t""")
def edge_features(spark, sf_dir):
    """The log amount and relative time of every event."""
    return rounded(features.edge_features(transfers(spark, sf_dir), ["kind"]), "log_amount")


@query(UNDIRECTED + """, d AS (SELECT world, n AS node, count(*) AS degree FROM (SELECT world, u AS n FROM u UNION ALL SELECT world, v FROM u) GROUP BY ALL), kt AS (SELECT world, n AS node, count(*) AS tt FROM (SELECT world, a AS n FROM tri UNION ALL SELECT world, b FROM tri UNION ALL SELECT world, c FROM tri) GROUP BY ALL),
l AS (SELECT world, u AS src, v AS dst FROM u UNION ALL SELECT world, v, u FROM u),
w AS (SELECT world, [src, dst] AS path, dst AS at FROM l WHERE src < dst UNION ALL SELECT w.world, list_append(path, l.dst), l.dst FROM w JOIN l ON l.world = w.world AND l.src = w.at WHERE l.dst > path[1] AND NOT list_contains(path, l.dst) AND len(path) < 6),
c AS (SELECT w.world, len(path) AS length, path AS cycle FROM w JOIN l ON l.world = w.world AND l.src = w.at AND l.dst = path[1] WHERE len(path) >= 4 AND path[2] < path[len(path)]),
oc AS (SELECT world, node, count_if(length = 4) AS c4, count_if(length = 5) AS c5, count_if(length = 6) AS c6 FROM (SELECT world, length, unnest(cycle) AS node FROM c) GROUP BY ALL),
x AS (SELECT world, hours, amount, src AS node, 1 AS o FROM t UNION ALL SELECT world, hours, amount, dst, 0 FROM t), f AS (SELECT world, node, count_if(o = 0) AS n_in, count_if(o = 1) AS n_out, log10(coalesce(sum(CASE WHEN o = 0 THEN greatest(amount, 0) END), 0) + 1) AS log_in, log10(coalesce(sum(CASE WHEN o = 1 THEN greatest(amount, 0) END), 0) + 1) AS log_out, min(hours) AS first, max(hours) AS last, max(hours) - min(hours) AS span, count(*) AS n_events FROM x GROUP BY ALL)
SELECT f.world, f.node, n_in, n_out, round(log_in, 7) AS log_in, round(log_out, 7) AS log_out, first - min(first) OVER (PARTITION BY f.world) AS first, last - min(first) OVER (PARTITION BY f.world) AS last, span, n_events, coalesce(tt, 0) AS triangles, round(CASE WHEN coalesce(degree, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(tt, 0) / (degree * (degree - 1)) END, 9) AS clustering, CAST(coalesce(c4, 0) AS BIGINT) AS cycles4, CAST(coalesce(c5, 0) AS BIGINT) AS cycles5, CAST(coalesce(c6, 0) AS BIGINT) AS cycles6 FROM f LEFT JOIN d USING (world, node) LEFT JOIN kt USING (world, node) LEFT JOIN oc USING (world, node)""")
def assembled_features(spark, sf_dir):
    """Eight node features and five motifs of every account in each world, side by side."""
    t = transfers(spark, sf_dir)
    return rounded(rounded(features.assembled(t, ["world"], graph.motifs(t, BY, 6)), "log_in", "log_out", places=7), "clustering")


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, 1.0::DOUBLE AS c FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM e WHERE vec_id % 5 > 0)
SELECT vec_id, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b, 0.0::DOUBLE AS c FROM e, s""")
def train_standardized(spark, sf_dir):
    """Columns standardised by the training rows alone; a constant one keeps scale 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.lit(1.0).alias("c"))
    return rounded(features.standardized(e, ["a", "b", "c"], F.col("vec_id") % 5 > 0), "a", "b", places=6)


@query("SELECT n_chars, lang, count(*) AS n, count(DISTINCT toxic) AS labels, count(DISTINCT toxic) > 1 AS conflict FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING count(*) > 1")
def vector_collisions(spark, sf_dir):
    """Documents with equal features, and whether their labels differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return features.collisions(d, ["n_chars", "lang"], "toxic")


#: Most arcs of the cells whose Laplacian is made: every two cells with an edge in common are an entry of it, so it grows with the square of their number.
PAIRED = 6
#: Names that hold in all worlds.
NAMED = f"""e AS (SELECT world, src, dst, world || ':' || src AS s, world || ':' || dst AS d, world || ':' || src || '-' || dst AS edge FROM a), b1 AS (SELECT s AS r, edge AS c, -1 AS v FROM e UNION ALL SELECT d, edge, 1 FROM e)"""


def cells_sql(most: int = LONGEST) -> str:
    return CYCLES.replace(f"len(path) < {LONGEST}", f"len(path) < {most}") + f""", {NAMED}, z AS (SELECT world, world || ':' || array_to_string(cycle, '-') AS cell, cycle, unnest(generate_series(1, length)) AS i, length FROM c),
b2 AS (SELECT world || ':' || cycle[i] || '-' || cycle[i % length + 1] AS r, cell AS c, 1 AS v FROM z)"""


CELLS = cells_sql()


def named(c):
    return F.concat(F.col("world").cast("string"), F.lit(":"), F.col(c).cast("string"))


def edges(spark, sf_dir, arcs=None):
    """The arcs of all worlds with names of their own (world, src, dst, edge); of `arcs`, where they are made already."""
    arcs = arcs or graph.arcs(transfers(spark, sf_dir), BY)
    return arcs.select("world", named("src").alias("src"), named("dst").alias("dst"), F.concat(named("src"), F.lit("-"), F.col("dst").cast("string")).alias("edge"))


def boundaries(spark, sf_dir, most=LONGEST, arcs=None):
    """The boundaries (cell, place, src, dst) of the cycles of 2 to so many arcs; of `arcs`, where they are made already."""
    found = graph.cycles(arcs or graph.arcs(transfers(spark, sf_dir), BY), range(2, most + 1), MOST_CYCLES, BY, MOST_PATHS)
    return graph.cycle_arcs(found).select("world", F.concat(F.col("world").cast("string"), F.lit(":"), F.array_join("cycle", "-")).alias("cell"), "place", named("src").alias("src"), named("dst").alias("dst"))


@query(f"WITH {ARCS}, {NAMED} SELECT r AS row, c AS col, CAST(v AS BIGINT) AS val FROM b1")
def node_edge_incidence(spark, sf_dir):
    """B1 of all worlds' arcs."""
    return incidence.b1(edges(spark, sf_dir))


@query(CELLS + " SELECT r AS row, c AS col, CAST(v AS BIGINT) AS val FROM b2")
def edge_cell_incidence(spark, sf_dir):
    """B2 of all worlds' cells."""
    return incidence.b2_cells(edges(spark, sf_dir), boundaries(spark, sf_dir)).withColumn("val", F.col("val").cast("bigint"))


@query(CELLS + " SELECT (SELECT count(DISTINCT cell) FROM z) AS cells, (SELECT count(*) FROM (SELECT b1.r, b2.c FROM b1 JOIN b2 ON b1.c = b2.r GROUP BY ALL HAVING sum(b1.v * b2.v) <> 0)) AS open")
def boundary_closure(spark, sf_dir):
    """Cells of all lengths, and entries of B1 B2 that aren't zero: none."""
    one, boundary = edges(spark, sf_dir), boundaries(spark, sf_dir)
    n = boundary.agg(F.count_distinct("cell").alias("cells"))
    open_ = incidence.product(incidence.b1(one), incidence.b2_cells(one, boundary)).agg(F.count("*").alias("open"))
    return n.join(open_)


@query(f"WITH {ARCS}, {NAMED} SELECT x.r AS row, y.r AS col, CAST(sum(x.v * y.v) AS BIGINT) AS val FROM b1 x JOIN b1 y USING (c) GROUP BY ALL HAVING sum(x.v * y.v) <> 0")
def node_laplacian(spark, sf_dir):
    """L0 of all worlds' arcs."""
    one = incidence.b1(edges(spark, sf_dir))
    return incidence.product(one, incidence.transposed(one))


@query(CELLS + """ SELECT row, col, CAST(sum(val) AS BIGINT) AS val FROM (SELECT x.c AS row, y.c AS col, sum(x.v * y.v) AS val FROM b1 x JOIN b1 y USING (r) GROUP BY ALL UNION ALL SELECT x.r, y.r, sum(x.v * y.v) FROM b2 x JOIN b2 y USING (c) GROUP BY ALL) GROUP BY row, col HAVING sum(val) <> 0""")
def edge_laplacian(spark, sf_dir):
    """L1 of all worlds' arcs and cells."""
    arcs = staged(graph.arcs(transfers(spark, sf_dir), BY), "arcs")
    own = edges(spark, sf_dir, arcs)
    two = staged(incidence.b2_cells(own, boundaries(spark, sf_dir, arcs=arcs)), "b2")
    return incidence.laplacians(incidence.b1(own.repartition("edge")), two)[1].withColumn("val", F.col("val").cast("bigint"))


@query(cells_sql(PAIRED) + """ SELECT x.c AS row, y.c AS col, CAST(sum(x.v * y.v) AS BIGINT) AS val FROM b2 x JOIN b2 y USING (r) GROUP BY ALL HAVING sum(x.v * y.v) <> 0""")
def cell_laplacian(spark, sf_dir):
    """L2 of all worlds' cells of up to six arcs."""
    two = incidence.b2_cells(edges(spark, sf_dir), boundaries(spark, sf_dir, PAIRED))
    return incidence.product(incidence.transposed(two), two).withColumn("val", F.col("val").cast("bigint"))


@query(UNDIRECTED + """ SELECT world || ':' || a || '-' || b AS row, world || ':' || a || '-' || b || '-' || c AS col, 1 AS val FROM tri UNION ALL SELECT world || ':' || a || '-' || c, world || ':' || a || '-' || b || '-' || c, -1 FROM tri UNION ALL SELECT world || ':' || b || '-' || c, world || ':' || a || '-' || b || '-' || c, 1 FROM tri""")
def simplicial_incidence(spark, sf_dir):
    """B2 of all worlds' triangles over their undirected pairs."""
    e = graph.pairs(transfers(spark, sf_dir), BY)
    name = lambda *c: F.concat(F.col("world").cast("string"), F.lit(":"), F.concat_ws("-", *(F.col(x).cast("string") for x in c)))
    return incidence.b2_simplicial(e.withColumn("edge", name("u", "v")), graph.triangles(e, BY).withColumn("cell", name("u", "v", "w")), BY)


@query(f"WITH {TRANSFERS} SELECT world, src AS row, event_id AS col, -1 AS val FROM t WHERE src <> dst UNION ALL SELECT world, dst, event_id, 1 FROM t WHERE src <> dst")
def event_incidence(spark, sf_dir):
    """B1 with a column for each event."""
    return incidence.by_event(transfers(spark, sf_dir), BY)


@query(CELLS + """ SELECT cell, unnest(generate_series(1, length - 2)) AS place, world || ':' || cycle[1] AS a, world || ':' || cycle[unnest(generate_series(1, length - 2)) + 1] AS b, world || ':' || cycle[unnest(generate_series(1, length - 2)) + 2] AS c FROM z WHERE i = 1""")
def fan_triangles(spark, sf_dir):
    """Every cell as triangles around its first corner."""
    return incidence.fans(boundaries(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(CELLS + """, n AS (SELECT cell, b1.r AS node, b2.r AS edge, b1.v AS v FROM (SELECT DISTINCT cell FROM z) q JOIN b2 ON b2.c = q.cell JOIN b1 ON b1.c = b2.r)
SELECT cell, array_to_string(list_sort(list_distinct(list(node))), ' ') AS rank0, array_to_string(list_sort(list_distinct(list(edge))), ' ') AS rank1, array_to_string(list_sort(list_distinct(list_concat(list(node || ' ' || edge || ' ' || v), list(edge || ' ' || cell || ' 1')))), ', ') AS pairs FROM n GROUP BY cell""")
def hasse_pairs(spark, sf_dir):
    """Every cell with its nodes, its edges and the signed pairs of ranks."""
    own = edges(spark, sf_dir)
    h = incidence.hasse(incidence.b1(own), incidence.b2_cells(own, boundaries(spark, sf_dir)))
    return h.select("cell", F.array_join("rank0", " ").alias("rank0"), F.array_join("rank1", " ").alias("rank1"), F.array_join("pairs", ", ").alias("pairs"))


COMPONENTS = f"""WITH RECURSIVE {ARCS}, b AS (SELECT world, src AS s, dst AS e FROM a UNION SELECT world, dst, src FROM a), v AS (SELECT world, src AS node FROM t UNION SELECT world, dst FROM t),
r AS (SELECT world, node, node AS root FROM v UNION SELECT r.world, r.node, b.e FROM r JOIN b ON b.world = r.world AND b.s = r.root), c AS (SELECT world, node, min(root) AS root FROM r GROUP BY ALL), u AS (SELECT DISTINCT world, least(src, dst) AS u, greatest(src, dst) AS v FROM a)"""


def world_stars(spark, sf_dir):
    """(nodes, pairs, stars) of each world's undirected graph, loops' accounts among the nodes."""
    t = transfers(spark, sf_dir)
    key = lambda c: F.struct(F.col("world"), F.col(c).alias("node"))
    pairs = graph.pairs(t, BY)
    stars = components.stars(pairs.select(key("u").alias("a"), key("v").alias("b"))).select("a.world", "a.node", F.col("b.node").alias("root"))
    return t.select("world", F.explode(F.array("src", "dst")).alias("node")).distinct(), pairs, stars


@query(COMPONENTS + """ SELECT c.world, count(*) AS nodes, coalesce(any_value(k.n), 0) AS edges, count(DISTINCT root) AS components, count(*) - count(DISTINCT root) AS rank, coalesce(any_value(k.n), 0) - (count(*) - count(DISTINCT root)) AS betti1 FROM c LEFT JOIN (SELECT world, count(*) AS n FROM u GROUP BY world) k ON k.world = c.world GROUP BY c.world""")
def incidence_rank(spark, sf_dir):
    """The rank of each world's incidence over GF(2), with its Betti numbers."""
    nodes, pairs, stars = world_stars(spark, sf_dir)
    return incidence.rank_of_incidence(nodes, stars, pairs, ["world"])


@query(UNDIRECTED + """ SELECT t.world, max(CAST(kind = 'error' AS INTEGER)) AS label, (SELECT count(*) FROM (SELECT src FROM t i WHERE i.world = t.world UNION SELECT dst FROM t i WHERE i.world = t.world)) AS nodes, (SELECT count(*) FROM a WHERE a.world = t.world) AS arcs, (SELECT count(*) FROM u WHERE u.world = t.world) AS pairs FROM t GROUP BY t.world""")
def multi_view(spark, sf_dir):
    """The graph, cell and simplicial views of each world side by side, under one label."""
    t = transfers(spark, sf_dir)
    label = t.groupBy("world").agg(F.max((F.col("kind") == "error").cast("int")).alias("label"))
    counted = lambda df, n: df.groupBy("world").agg(F.count("*").alias(n)).join(label, "world")
    views = [counted(features.graph_view(t, ["world"], F.lit(False)), "nodes"), counted(features.cell_view(t, ["world"]), "arcs"), counted(features.simplicial_view(t, ["world"]), "pairs")]
    return incidence.consistent(views, "world", "label")


@query(f"WITH {TRANSFERS} SELECT event_id, unnest(['account:' || src, 'out:' || event_id, 'event:' || event_id, 'in:' || event_id]) AS src, unnest(['out:' || event_id, 'event:' || event_id, 'in:' || event_id, 'account:' || dst]) AS dst FROM t WHERE kind = 'purchase'")
def port_subdivision(spark, sf_dir):
    """Each purchase as four segments through its ports."""
    t = transfers(spark, sf_dir).where("kind = 'purchase'")
    return incidence.subdivided(t).drop("place")


@query(f"WITH {TRANSFERS}, e AS (SELECT kind, src AS node, -1 AS v FROM t UNION ALL SELECT kind, dst, 1 FROM t) SELECT kind, node, CAST(sum(v) AS BIGINT) AS val FROM e GROUP BY ALL HAVING sum(v) <> 0")
def boundary_residual(spark, sf_dir):
    """Accounts whose events in and out don't cancel, for each kind."""
    return incidence.residual(transfers(spark, sf_dir), "kind")


@query(f"WITH {TRANSFERS} SELECT kind, least(src, dst) AS u, greatest(src, dst) AS v, CAST(min(hours) AS DOUBLE) AS time FROM t WHERE src <> dst GROUP BY ALL")
def temporal_filtration(spark, sf_dir):
    """Undirected pairs with their first time."""
    return persistence.filtration(transfers(spark, sf_dir).withColumn("time", F.col("hours")), "kind")


def drawn(spark, sf_dir):
    """(the bars of the graphs of days, each day's last hour)."""
    t = transfers(spark, sf_dir).withColumns({"day": F.col("world"), "time": (F.col("hours") % 24).cast("double")})
    pairs = staged(persistence.filtration(t, "day"), "pairs")
    return persistence.bars(pairs, "day"), pairs.groupBy("day").agg(F.max("time").alias("most"))


@query(COMPONENTS + """ SELECT c.world AS day, any_value(k.n) AS edges, count(DISTINCT c.node) AS h0, count(DISTINCT root) AS components, any_value(k.n) - (count(DISTINCT c.node) - count(DISTINCT root)) AS h1 FROM c JOIN (SELECT world, count(*) AS n FROM u GROUP BY world) k ON k.world = c.world WHERE EXISTS (SELECT 1 FROM u WHERE u.world = c.world AND c.node IN (u.u, u.v)) GROUP BY c.world""")
def betti_numbers(spark, sf_dir):
    """Bars of each day's graph: a bar in H0 for a node, endless ones for components, and one in H1 for every edge beyond a forest. By components over all days at once; no day is gathered."""
    _, pairs, stars = world_stars(spark, sf_dir)
    nodes = pairs.select("world", F.explode(F.array("u", "v")).alias("node")).distinct()
    r = incidence.rank_of_incidence(nodes, stars, pairs, ["world"])
    return r.select(F.col("world").alias("day"), "edges", F.col("nodes").alias("h0"), "components", F.col("betti1").alias("h1"))


#: Bars of each day's graph as (day, dim, b, d, m): m bars from b to d. Components of every prefix of a day give those of H0, as the oldest node of a component names it; edges less nodes plus components those of H1.
BARS = f"""WITH RECURSIVE {TRANSFERS}, pr AS (SELECT world AS day, least(src, dst) AS u, greatest(src, dst) AS v, CAST(min(hours % 24) AS DOUBLE) AS time FROM t WHERE src <> dst GROUP BY ALL), tm AS (SELECT DISTINCT day, time AS h FROM pr),
be AS (SELECT tm.day, h, u AS s, v AS e FROM tm JOIN pr ON pr.day = tm.day AND pr.time <= h UNION SELECT tm.day, h, v, u FROM tm JOIN pr ON pr.day = tm.day AND pr.time <= h),
cl(day, h, node, root) USING KEY (day, h, node) AS (SELECT DISTINCT day, h, s AS node, s AS root FROM be UNION SELECT day, h, node, root FROM (SELECT be.day, be.h, be.s AS node, min(cl.root) AS root FROM cl JOIN be ON be.day = cl.day AND be.h = cl.h AND be.e = cl.node GROUP BY ALL) n WHERE n.root < (SELECT r.root FROM recurring.cl r WHERE r.day = n.day AND r.h = n.h AND r.node = n.node)),
bi AS (SELECT day, node, min(time) AS b FROM (SELECT day, u AS node, time FROM pr UNION ALL SELECT day, v, time FROM pr) GROUP BY ALL),
cb AS (SELECT cl.day, cl.h, cl.root, min(b) AS b FROM cl JOIN bi ON bi.day = cl.day AND bi.node = cl.node GROUP BY ALL),
bt AS (SELECT DISTINCT day, b FROM bi), nb AS (SELECT tm.day, bt.b, tm.h, (SELECT count(*) FROM cb WHERE cb.day = tm.day AND cb.h = tm.h AND cb.b = bt.b) AS n FROM tm JOIN bt ON bt.day = tm.day AND bt.b <= tm.h),
st AS (SELECT *, lag(n) OVER w AS was, max(h) OVER (PARTITION BY day) AS most FROM nb WINDOW w AS (PARTITION BY day, b ORDER BY h)),
cc AS (SELECT tm.day, tm.h, (SELECT count(*) FROM pr WHERE pr.day = tm.day AND pr.time <= tm.h) - (SELECT count(*) FROM bi WHERE bi.day = tm.day AND bi.b <= tm.h) + (SELECT count(*) FROM cb WHERE cb.day = tm.day AND cb.h = tm.h) AS betti FROM tm),
ce AS (SELECT *, betti - coalesce(lag(betti) OVER (PARTITION BY day ORDER BY h), 0) AS m, max(h) OVER (PARTITION BY day) AS most FROM cc),
bars AS (SELECT day, 0 AS dim, b, h AS d, was - n AS m, most FROM st WHERE was > n UNION ALL SELECT day, 0, b, most + 1, n, most FROM st WHERE h = most AND n > 0 UNION ALL SELECT day, 1, h, most + 1, m, most FROM ce WHERE m > 0)"""


@query(BARS + """, z AS (SELECT day, dim, sum(m * (d - b)) AS total, max(d - b) AS longest, sum(m) AS n FROM bars GROUP BY ALL), y AS (SELECT bars.day, bars.dim, any_value(total) AS total, any_value(longest) AS longest, any_value(total) / any_value(n) AS mean, -sum(m * (d - b) / total * log2((d - b) / total)) AS entropy, any_value(n) AS bars FROM bars JOIN z USING (day, dim) GROUP BY ALL)
SELECT x.day, round(x.total, 6) AS h0_total, x.longest AS h0_longest, round(x.mean, 6) AS h0_mean, round(x.entropy, 6) AS h0_entropy, CAST(x.bars AS INTEGER) AS h0_bars, round(coalesce(w.total, 0), 6) AS h1_total, coalesce(w.longest, 0) AS h1_longest, round(coalesce(w.mean, 0), 6) AS h1_mean, round(coalesce(w.entropy, 0), 6) AS h1_entropy, CAST(coalesce(w.bars, 0) AS INTEGER) AS h1_bars FROM y x LEFT JOIN y w ON w.day = x.day AND w.dim = 1 WHERE x.dim = 0""")
def persistence_summary(spark, sf_dir):
    """Total, longest, mean, entropy and number of bars in each dimension."""
    rows, last = drawn(spark, sf_dir)
    told = persistence.summaries(persistence.finite(rows, last, "day"), "day")
    names = ("total", "longest", "mean", "entropy", "bars")
    s = last.select("day")
    for k in (0, 1):
        s = s.join(told.where(F.col("dim") == k).select("day", *(F.col(c).alias(f"h{k}_{c}") for c in names)), "day", "left")
    s = s.fillna(0, [f"h{k}_{c}" for k in (0, 1) for c in names]).withColumns({f"h{k}_bars": F.col(f"h{k}_bars").cast("int") for k in (0, 1)})
    return rounded(s, *(f"{h}_{c}" for h in ("h0", "h1") for c in ("total", "mean", "entropy")), places=6)


@query(BARS + """, k AS (SELECT day, dim, b / greatest(most, 1) AS b, d / greatest(most, 1) AS d, m FROM bars), g AS (SELECT unnest(generate_series(0, 49)) AS i), e AS (SELECT k.day, dim, i, greatest(0, least(i * 2.0 / 49 - b, d - i * 2.0 / 49)) AS tent, unnest(generate_series(1, least(m, 3)::BIGINT)) AS copy FROM k, g),
r AS (SELECT *, row_number() OVER (PARTITION BY day, dim, i ORDER BY tent DESC) AS lev FROM e), days AS (SELECT DISTINCT day FROM bars), lv AS (SELECT days.day, dim, lev, i FROM days, (SELECT unnest([0, 1]) AS dim), (SELECT unnest([1, 2, 3]) AS lev), g),
z AS (SELECT day, dim, sum(m * (d - b)) AS total, max(d - b) AS longest, sum(m) AS n FROM k GROUP BY ALL), y AS (SELECT k.day, k.dim, [any_value(total), any_value(longest), any_value(total) / any_value(n), -sum(m * (d - b) / total * log2((d - b) / total)), CAST(any_value(n) AS DOUBLE)] AS s FROM k JOIN z USING (day, dim) GROUP BY ALL)
SELECT lv.day, lv.dim * 155 + (lv.lev - 1) * 50 + lv.i AS place, round(coalesce(tent, 0), 4) AS value FROM lv LEFT JOIN r USING (day, dim, lev, i)
UNION ALL SELECT d.day, d.dim * 155 + 150 + d.j, round(coalesce(y.s[d.j + 1], 0), 4) FROM (SELECT day, dim, unnest([0, 1, 2, 3, 4]) AS j FROM days, (SELECT unnest([0, 1]) AS dim)) d LEFT JOIN y USING (day, dim)""")
def persistence_vectors(spark, sf_dir):
    """Landscapes and summaries of each day as 310 numbers, a row for each."""
    v = persistence.vectors(*drawn(spark, sf_dir), "day")
    return v.select("day", F.col("place").cast("bigint").alias("place"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query(COMPONENTS + """, p AS (SELECT world, u, v, min(CAST(hours % 24 AS DOUBLE)) AS time FROM (SELECT world, least(src, dst) AS u, greatest(src, dst) AS v, hours FROM t WHERE src <> dst) GROUP BY ALL), n AS (SELECT DISTINCT world, u AS node FROM p UNION SELECT world, v FROM p)
SELECT world AS day, (SELECT count(*) FROM p i WHERE i.world = p.world) - (SELECT count(*) FROM n WHERE n.world = p.world) + (SELECT count(DISTINCT c.root) FROM c JOIN n ON n.world = c.world AND n.node = c.node WHERE c.world = p.world) AS classes FROM p GROUP BY world""")
def essential_classes(spark, sf_dir):
    """Endless classes in H1 of each day, counted three ways."""
    _, pairs, stars = world_stars(spark, sf_dir)
    nodes = pairs.select("world", F.explode(F.array("u", "v")).alias("node")).distinct()
    rank = incidence.rank_of_incidence(nodes, stars, pairs, ["world"]).withColumnRenamed("world", "day")
    return persistence.essential_census(drawn(spark, sf_dir)[0], rank, "day").select("day", "classes")


@query(BARS + """, tv AS (SELECT DISTINCT world AS day, CAST(hours % 24 AS DOUBLE) AS h FROM t),
bp AS (SELECT day, h, (SELECT count(*) FROM t WHERE t.world = tv.day AND t.hours % 24 <= tv.h) - (SELECT count(*) FROM bi WHERE bi.day = tv.day AND bi.b <= tv.h) + (SELECT count(*) FROM cb WHERE cb.day = tv.day AND cb.h = (SELECT max(h) FROM tm WHERE tm.day = tv.day AND tm.h <= tv.h)) AS betti FROM tv),
st2 AS (SELECT day, h AS time, betti - coalesce(lag(betti) OVER (PARTITION BY day ORDER BY h), 0) AS births FROM bp)
SELECT day, time, births FROM st2 WHERE births > 0""")
def port_births(spark, sf_dir):
    """Endless classes in H1 of each day's graph with all events as paths through ports of their own, by hour."""
    t = transfers(spark, sf_dir).withColumns({"day": F.col("world"), "time": (F.col("hours") % 24).cast("double")})
    return persistence.port_births(t, "day")


def triangle_complex(spark, sf_dir):
    """(nodes, edges, triangles, stars) of each world."""
    nodes, pairs, stars = world_stars(spark, sf_dir)
    e = staged(pairs.withColumn("edge", F.concat_ws("-", "u", "v")), "pairs")
    return nodes, e, graph.triangles(e, BY).withColumn("cell", F.concat_ws("-", "u", "v", "w")), stars


@query(COMPONENTS + """, tri AS (SELECT x.world, x.u AS a, x.v AS b, y.v AS c FROM u x JOIN u y ON x.world = y.world AND x.v = y.u JOIN u z ON z.world = x.world AND z.u = x.u AND z.v = y.v),
ei AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY u, v) - 1 AS i, count(*) OVER (PARTITION BY world) AS n FROM u),
co AS (SELECT tri.world, array_to_string(list_transform(range(0, x.n), lambda k: CASE WHEN k = x.i OR k = y.i OR k = z.i THEN '1' ELSE '0' END), '')::BIT AS col FROM tri JOIN ei x ON x.world = tri.world AND x.u = a AND x.v = b JOIN ei y ON y.world = tri.world AND y.u = b AND y.v = c JOIN ei z ON z.world = tri.world AND z.u = a AND z.v = c),
rk AS (SELECT world, count(*) AS faces, len(list_reduce(list_concat([CAST([] AS BIT[])], list([col])), lambda held, col: list_concat(held, list_filter([list_reduce(list_concat(col, held), lambda own, other: CASE WHEN get_bit(own, CAST(bit_position('1'::BIT, other) - 1 AS INTEGER)) = 1 THEN xor(own, other) ELSE own END)], lambda x: bit_count(x) > 0)))) AS rank2 FROM co GROUP BY world)
SELECT c.world, count(DISTINCT root) AS beta0, coalesce(any_value(k.n), 0) - (count(*) - count(DISTINCT root)) - coalesce(any_value(rk.rank2), 0) AS beta1, coalesce(any_value(rk.faces), 0) - coalesce(any_value(rk.rank2), 0) AS beta2
FROM c LEFT JOIN (SELECT world, count(*) AS n FROM u GROUP BY world) k ON k.world = c.world LEFT JOIN rk ON rk.world = c.world GROUP BY c.world""")
def betti_with_faces(spark, sf_dir):
    """Betti numbers over GF(2) of each world's complex of nodes, edges and triangles."""
    nodes, edges, triangles, stars = triangle_complex(spark, sf_dir)
    return incidence.betti_of_faces(nodes, edges, triangles, stars, BY, 2)


@query(CYCLES + TUPLES + """, tc AS (SELECT world || ':' || array_to_string(cycle, '-') || ':' || array_to_string(events, '-') AS candidate, length AS n, cycle, events FROM k), p AS (SELECT candidate, n, unnest(range(0, 4 * n)) AS i, cycle, events FROM tc),
v AS (SELECT candidate, n, i, CASE i % 4 WHEN 0 THEN 'account:' || cycle[i // 4 + 1] WHEN 1 THEN 'out:' || events[i // 4 + 1] WHEN 2 THEN 'event:' || events[i // 4 + 1] ELSE 'in:' || events[i // 4 + 1] END AS a FROM p),
f AS (SELECT x.candidate, x.i, x.a, y.a AS b, x.n FROM v x JOIN v y ON y.candidate = x.candidate AND y.i = (x.i + 1) % (4 * x.n)),
o AS (SELECT candidate, i, vertex, sum(v) AS v FROM (SELECT candidate, i, unnest([a, b, 'centre', a, 'centre', b]) AS vertex, unnest([-1, 1, -1, 1, 1, -1]) AS v FROM f) GROUP BY ALL)
SELECT f.candidate, count(*) AS faces, count(DISTINCT f.a) AS corners, count_if(f.a LIKE 'account:%') AS accounts, any_value(z.open) AS open FROM f JOIN (SELECT candidate, count_if(v <> 0) AS open FROM o GROUP BY candidate) z USING (candidate) GROUP BY f.candidate""")
def centre_fans(spark, sf_dir):
    """Every event tuple's cycle through its ports filled from a centre: faces, corners, accounts among these, and entries of B1 B2 that aren't zero."""
    k = staged(tuples(spark, sf_dir).withColumn("key", F.monotonically_increasing_id()), "tuples")
    name = F.concat_ws(":", F.col("world").cast("string"), F.array_join("cycle", "-"), F.array_join("events", "-")).alias("candidate")
    n = F.size("cycle")
    chosen = k.select("key", "cycle", F.posexplode("events").alias("place", "event_id")).select("key", "place", "event_id", F.col("cycle")[F.col("place")].alias("src"), F.col("cycle")[(F.col("place") + 1) % n].alias("dst"))
    faces = staged(incidence.port_fan(chosen, "key"), "faces")
    open_ = incidence.fan_open(*incidence.fan_incidence(faces, "key"), "key")
    told = faces.groupBy("key").agg(F.count("*").alias("faces"), F.count_distinct("a").alias("corners"), F.count_if(F.col("a").startswith("account:")).alias("accounts"))
    return k.select("key", name).join(told, "key").join(open_, "key", "left").fillna(0, ["open"]).select("candidate", "faces", "corners", "accounts", "open")


@query(CELLS + """, q AS (SELECT (SELECT count(DISTINCT cell) FROM z) AS cells, (SELECT count(*) FROM (SELECT DISTINCT c FROM (SELECT b1.r, b2.c FROM b1 JOIN b2 ON b1.c = b2.r GROUP BY ALL HAVING sum(b1.v * b2.v) <> 0))) AS open) SELECT unnest(['product', 'ends', 'renamed']) AS form, cells, open FROM q""")
def closure_forms(spark, sf_dir):
    """Whether cells of all lengths close, by the product of both incidences, by their ends alone, and by the product in another order."""
    return incidence.closure_forms(edges(spark, sf_dir), staged(boundaries(spark, sf_dir), "boundaries"))
