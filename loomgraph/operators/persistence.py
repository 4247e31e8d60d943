"""Persistence of temporal graphs in dimensions 0 and 1, and vectors made of their bars.

Bars are rows. The elder rule is worked out by rounds of joins over all graphs at once, without a task that holds a graph; summaries and landscapes
are aggregates. The functions on arrays are the same for diagrams that are values of a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import discard, staged

DIAGRAM = "h0 array<struct<birth: double, death: double>>, h1 array<struct<birth: double, death: double>>"
ENDLESS = float("inf")


def filtration(edges: DataFrame, group: str, time: str = "time") -> DataFrame:
    """(group, u, v, time): undirected pairs with their earliest time; loops are left out. A missing or non-finite time raises."""
    t = F.col(time).cast("double")
    good = F.when(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")), t).otherwise(F.raise_error(F.lit("a time is missing or not finite")).cast("double"))
    return edges.where("src <> dst").select(group, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), good.alias("time")).groupBy(group, "u", "v").agg(F.min("time").alias("time"))


def forest(pairs: DataFrame, group: str, most_rounds: int = 200) -> DataFrame:
    """(group, birth, node, time, u, v): for each node whose component ends, the edge (time, u, v) that joins it to an older one. A node is born with its first edge, ties going to the lesser name;
    the edges are the least spanning forest in the order of time, u and v.

    A round looks at the least edge out of each component so far. If the component beyond has an older eldest, the own eldest's bar ends there: all edges between an
    outgoing edge's end and its component's eldest are earlier than that edge, which stays so when the younger of two is hung to the older. If the one beyond is younger, the component waits.
    The least edge of all is never waited for, so each round hangs a component in every part of a graph that isn't done; parts with r components out of step take r rounds at worst. Chains of hung components are cut short by doubling.
    """
    born = pairs.select(group, F.inline(F.array(F.struct(F.col("u").alias("node"), "time"), F.struct(F.col("v").alias("node"), "time")))).groupBy(group, "node").agg(F.min("time").alias("birth"))
    name = lambda c: born.select(group, F.col("node").alias(c), F.struct("birth", "node").alias(f"{c}_name"))
    left = staged(pairs.join(name("u"), [group, "u"]).join(name("v"), [group, "v"]).select(group, F.least("u_name", "v_name").alias("a"), F.greatest("u_name", "v_name").alias("b"), F.struct("time", "u", "v").alias("e")), "forest-edges")
    hung = []
    for _ in range(most_rounds):
        ends = left.unionByName(left.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        least = ends.groupBy(group, "a").agg(F.min(F.struct("e", "b")).alias("x")).select(group, "a", "x.b", "x.e")
        up = staged(least.where(F.col("b") < F.col("a")), "hung")
        if not up.take(1):
            break
        hung.append(up.select(group, "a.birth", "a.node", "e.time", "e.u", "e.v"))
        top = up.select(group, "a", "b")
        while True:  # each to the top of its chain
            over = top.select(group, F.col("a").alias("b"), F.col("b").alias("c"))
            longer = staged(top.join(over, [group, "b"], "left").select(group, "a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")), "tops")
            if top.__dict__.get("staged_at"):
                discard(top)
            moved, top = longer.where("moved").take(1), longer.drop("moved")
            if not moved:
                break
        to = lambda c: top.select(group, F.col("a").alias(c), F.col("b").alias(f"{c}_top"))
        now = left.join(to("a"), [group, "a"], "left").join(to("b"), [group, "b"], "left").select(group, F.coalesce("a_top", "a").alias("x"), F.coalesce("b_top", "b").alias("y"), "e").where("x <> y")
        now = staged(now.groupBy(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")), "forest-edges")
        discard(left, longer)
        left = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    out = hung[0] if hung else up.select(group, "a.birth", "a.node", "e.time", "e.u", "e.v")
    for x in hung[1:]:
        out = out.unionByName(x)
    return staged(out, "forest")


def bars(pairs: DataFrame, group: str, tree: DataFrame | None = None) -> DataFrame:
    """(group, dim, birth, death) of the filtered graphs (group, u, v, time), a row a bar. A node's bar in H0 ends where an edge joins its component to an older one; an edge within a component begins a bar in H1 that never ends. tree: forest(pairs, group)."""
    tree = forest(pairs, group) if tree is None else tree
    endless = F.lit(ENDLESS)
    born = pairs.select(group, F.inline(F.array(F.struct(F.col("u").alias("node"), "time"), F.struct(F.col("v").alias("node"), "time")))).groupBy(group, "node").agg(F.min("time").alias("birth"))
    elders = born.join(tree.select(group, "node"), [group, "node"], "left_anti").select(group, F.lit(0).alias("dim"), "birth", endless.alias("death"))
    ended = tree.select(group, F.lit(0).alias("dim"), "birth", F.col("time").alias("death"))
    loops = pairs.join(tree.select(group, "u", "v"), [group, "u", "v"], "left_anti").select(group, F.lit(1).alias("dim"), F.col("time").alias("birth"), endless.alias("death"))
    return ended.unionByName(elders).unionByName(loops)


def diagrams(pairs: DataFrame, group: str) -> DataFrame:
    """(group, h0, h1): the bars of graphs that are small enough to be values, in order."""
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("dim") == k, F.struct("birth", "death"))))
    return bars(pairs, group).groupBy(group).agg(own(0).alias("h0"), own(1).alias("h1"))


def finite(rows: DataFrame, most: DataFrame, group: str, scaled: bool = False) -> DataFrame:
    """(group, dim, b, d, m): m equal bars each, those without an end ended one after the group's last time (group, most), those without length left out; a birth that is no number, or a death before it, raises. scaled: times divided by the last one, or 1 if that is less."""
    end = F.when(F.col("death") == ENDLESS, F.col("most") + 1.0).otherwise(F.col("death"))
    bad = F.col("birth").isNull() | F.isnan("birth") | (F.abs("birth") == ENDLESS) | F.isnan("death") | (end < F.col("birth"))
    few = rows.groupBy(group, "dim", "birth", "death").agg(F.count("*").alias("m")).join(most, group)
    by = F.greatest("most", F.lit(1.0)) if scaled else F.lit(1.0)
    fault = F.raise_error(F.lit("a bar is not valid")).cast("double")
    return few.select(group, "dim", (F.when(bad, fault).otherwise(F.col("birth")) / by).alias("b"), (end / by).alias("d"), "m").where("d > b")


def summaries(ended: DataFrame, group: str) -> DataFrame:
    """(group, dim, total, longest, mean, entropy, bars) of finite(): total, longest, mean and entropy in bits of the bars' lengths, and their number."""
    n, m = F.col("d") - F.col("b"), F.col("m")
    sums = ended.groupBy(group, "dim").agg(F.sum(m * n).alias("total"), F.max(n).alias("longest"), F.sum(m * n * F.log2(n)).alias("logs"), F.sum(m).alias("bars"))
    return sums.select(group, "dim", "total", "longest", (F.col("total") / F.col("bars")).alias("mean"), (F.log2("total") - F.col("logs") / F.col("total")).alias("entropy"), "bars")


def landscapes(ended: DataFrame, group: str, levels: int = 3, points: int = 50, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """(group, dim, level, point, value): the `levels` highest tents over an even grid, those above 0. A bar meets only the points below its tent."""
    step = (high - low) / (points - 1)
    first, last = (F.greatest(F.lit(0), F.ceil((F.col("b") - low) / step) - 1), F.least(F.lit(points - 1), F.floor((F.col("d") - low) / step) + 1))
    copies = F.sequence(F.lit(1), F.least("m", F.lit(levels)).cast("int"))
    at = ended.select(group, "dim", "b", "d", F.explode(copies).alias("copy"), F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).alias("points")).select(group, "dim", "b", "d", F.explode("points").alias("point"))
    t = F.lit(low) + F.col("point") * F.lit(step)
    tents = at.select(group, "dim", "point", F.least(t - F.col("b"), F.col("d") - t).alias("value")).where("value > 0")
    order = Window.partitionBy(group, "dim", "point").orderBy(F.col("value").desc())
    return tents.withColumn("level", F.row_number().over(order)).where(F.col("level") <= levels)


def vectors(rows: DataFrame, most: DataFrame, group: str, levels: int = 3, points: int = 50) -> DataFrame:
    """(group, place, value): the landscapes and summaries of H0, then H1, of each group in most, a row for each number; as vector() gives them for arrays."""
    ended = staged(finite(rows, most, group, True), "bars")
    size = levels * points + 5
    of_level = F.col("dim") * size + (F.col("level") - 1) * points + F.col("point")
    made = landscapes(ended, group, levels, points).select(group, of_level.alias("place"), "value")
    names = ("total", "longest", "mean", "entropy", "bars")
    told = summaries(ended, group).select(group, "dim", F.posexplode(F.array(*(F.col(n).cast("double") for n in names))).alias("k", "value"))
    made = made.unionByName(told.select(group, (F.col("dim") * size + levels * points + F.col("k")).alias("place"), "value"))
    every = most.select(group, F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))).alias("place"))
    return every.join(made, [group, "place"], "left").select(group, "place", F.coalesce("value", F.lit(0.0)).cast("float").alias("value"))


def clean(diagram: Column, most: Column) -> Column:
    """Bars with an infinite death ended one after the last time, bars without length left out; a birth that is no number, or a death before it, raises."""
    end = lambda x: F.when(x["death"] == float("inf"), most + 1.0).otherwise(x["death"])
    bad = F.exists(diagram, lambda x: x["birth"].isNull() | F.isnan(x["birth"]) | (F.abs(x["birth"]) == float("inf")) | F.isnan(x["death"]) | (end(x) < x["birth"]))
    bars = F.filter(F.transform(diagram, lambda x: F.named_struct(F.lit("birth"), x["birth"], F.lit("death"), end(x))), lambda x: x["death"] > x["birth"])
    return F.when(~bad, bars).otherwise(F.raise_error(F.lit("a bar is not valid")))


def landscape(bars: Column, levels: int = 3, points: int = 50, low: float = 0.0, high: float = 2.0) -> Column:
    """The `levels` highest tents over an even grid, one level after the other."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / (points - 1)))

    def at(t: Column) -> Column:
        tents = F.transform(bars, lambda x: F.greatest(F.lit(0.0), F.least(t - x["birth"], x["death"] - t)))
        return F.slice(F.concat(F.sort_array(tents, asc=False), F.array_repeat(F.lit(0.0), levels)), 1, levels)

    tops = F.transform(grid, at)
    return F.flatten(F.array(*[F.transform(tops, level(k)) for k in range(levels)]))


def level(k: int):
    return lambda x: x[k]


def summary(bars: Column) -> Column:
    """total, longest, mean and entropy in bits of the bars' lengths, and their number."""
    lengths = F.transform(bars, lambda x: x["death"] - x["birth"])
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    n = F.size(bars)
    entropy = F.aggregate(lengths, F.lit(0.0), lambda a, x: a - x / total * F.log2(x / total))
    some = n > 0
    return F.struct(total.alias("total"), F.when(some, F.array_max(lengths)).otherwise(0.0).alias("longest"), F.when(some, total / n).otherwise(0.0).alias("mean"), F.when(some, entropy).otherwise(0.0).alias("entropy"), n.alias("bars"))


def vector(h0: Column, h1: Column, most: Column, levels: int = 3, points: int = 50) -> Column:
    """Landscapes and summaries of both diagrams, with times divided by the last one, or 1 if that is less: 310 floats."""
    scale = F.greatest(most, F.lit(1.0))
    small = lambda h: F.transform(clean(h, most), lambda x: F.named_struct(F.lit("birth"), x["birth"] / scale, F.lit("death"), x["death"] / scale))
    parts = []
    for h in (h0, h1):
        bars = small(h)
        s = summary(bars)
        parts += [landscape(bars, levels, points), F.array(s["total"], s["longest"], s["mean"], s["entropy"], s["bars"].cast("double"))]
    return F.concat(*parts).cast("array<float>")


def filled(bars: Column, births: Column, time: float | Column) -> Column:
    """Bars of H1 with those that begin at one of `births` ended at `time`, when a face fills the cycle; a bar filled at its birth goes."""
    t = time if isinstance(time, Column) else F.lit(float(time))
    ended = F.transform(bars, lambda x: F.named_struct(F.lit("birth"), x["birth"], F.lit("death"), F.when(F.array_contains(births, x["birth"]), F.least(x["death"], F.greatest(t, x["birth"]))).otherwise(x["death"])))
    return F.filter(ended, lambda x: x["death"] > x["birth"])


def essential_census(rows: DataFrame, rank: DataFrame, group: str) -> DataFrame:
    """(group, classes, first, last) of the endless classes in H1 among bars (group, dim, birth, death), or of diagrams (group, h1). Their number is held against edges - nodes + components of `rank` (group, edges, nodes, components) and against edges less the rank over GF(2); a difference raises."""
    if "h1" in rows.columns:
        rows = rows.select(group, F.lit(1).alias("dim"), F.inline_outer("h1"))
    endless = (F.col("dim") == 1) & (F.col("death") == ENDLESS)
    birth = F.when(endless, F.col("birth"))
    own = rows.groupBy(group).agg(F.count_if(endless).alias("classes"), F.min(birth).alias("first"), F.max(birth).alias("last"))
    met = own.join(rank, group)
    good = (F.col("classes") == F.col("edges") - F.col("nodes") + F.col("components")) & (F.col("classes") == F.col("edges") - F.col("rank"))
    return met.select(group, F.when(good, F.col("classes")).otherwise(F.raise_error(F.lit("the counts of endless classes differ")).cast("bigint")).alias("classes"), "first", "last")


def port_births(events: DataFrame, group: str, time: str = "time") -> DataFrame:
    """(group, time, births): the endless classes in H1 of the unfilled graph in which every event (group, event_id, src, dst, time) is a path of four segments through three ports of its own, by distinct time of an event; times without any are left out.

    An event begins a class unless it joins two components of accounts for the first time, so a time's births are its events less the edges of the forest at that time; parallel events and loops begin
    one each. The sum is held against segments - vertices + components and against segments less the rank over GF(2) of the expanded graph, with the components of the accounts' graph, which the forest has no part in; a difference raises.
    """
    from loomgraph.operators import components

    own = events.select(group, "event_id", "src", "dst", F.col(time).cast("double").alias("time"))
    pairs = staged(filtration(own, group), "pairs")
    joined = forest(pairs, group).groupBy(group, "time").agg(F.count("*").alias("joined"))
    births = own.groupBy(group, "time").agg(F.count("*").alias("n")).join(joined, [group, "time"], "left").select(group, "time", (F.col("n") - F.coalesce("joined", F.lit(0))).alias("births"))
    # In the incidence of the expanded graph each port has a segment of its own event as pivot, which leaves the last one as a column from the event's source to its target: so
    # its rank is three for each event and that of the accounts' graph, and no port is looked at.
    at = lambda x: F.struct(F.col(group).alias("g"), F.col(x).alias("x"))
    tied = components.stars(pairs.select(at("u").alias("a"), at("v").alias("b"))).groupBy(F.col("a.g").alias(group)).agg(F.count("*").alias("tied"))  # all accounts but one of each component
    accounts = own.select(group, F.explode(F.array("src", "dst")).alias("x")).distinct().groupBy(group).agg(F.count("*").alias("accounts"))
    sums = births.groupBy(group).agg(F.sum("births").alias("own")).join(own.groupBy(group).agg(F.count("*").alias("n")), group).join(accounts, group).join(tied, group, "left").fillna(0, ["tied"]).withColumn("rank", 3 * F.col("n") + F.col("tied"))
    vertices, edges = F.col("accounts") + 3 * F.col("n"), 4 * F.col("n")
    good = (F.col("own") == edges - vertices + (vertices - F.col("rank"))) & (F.col("own") == edges - F.col("rank"))
    checked = sums.select(group, F.when(good, F.lit(0)).otherwise(F.raise_error(F.lit("the counts of endless classes differ")).cast("int")).alias("_zero"))
    return births.join(checked, group).select(group, "time", (F.col("births") + F.col("_zero")).alias("births")).where("births > 0")


def cache_vectors(vectors: DataFrame, path: str, fold: str) -> None:
    """Vectors by fold with their manifest, as sinks.write_parts; a vector of another length than the first one's, or with a value that isn't finite, raises."""
    from loomgraph.sources.sinks import write_parts

    width = vectors.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if width[0] != width[1]:
        raise ValueError("vectors differ in length")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    write_parts(vectors.withColumn("v", F.when(~bad, F.col("v")).otherwise(F.raise_error(F.lit("a vector isn't finite")).cast("array<float>"))), path, fold)
