"""Features of nodes, edges and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_features(events: DataFrame, by: list[str]) -> DataFrame:
    """Degrees, log volumes, first and last time and number of events of every node in each group."""
    ends = F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"))))
    e = events.select(*by, "hours", "amount", ends)
    out, amount = F.col("out") == 1, F.greatest("amount", F.lit(0.0))
    volume = lambda c: F.log10(F.coalesce(F.sum(F.when(c, amount)), F.lit(0.0)) + 1)
    return e.groupBy(*by, "node").agg(
        F.count_if(~out).alias("n_in"),
        F.count_if(out).alias("n_out"),
        volume(~out).alias("log_in"),
        volume(out).alias("log_out"),
        F.min("hours").alias("first"),
        F.max("hours").alias("last"),
        (F.max("hours") - F.min("hours")).alias("span"),
        F.count("*").alias("n_events"),
    )


def relative_times(features: DataFrame, by: list[str], names: list[str], origin: DataFrame | None = None) -> DataFrame:
    """Times less the first one of their group, or less the one that origin (by, _origin) has for it."""
    if origin is None:
        origin = features.groupBy(*by).agg(F.min(names[0]).alias("_origin"))
    return features.join(origin, by).select(*(((F.col(c) - F.col("_origin")).alias(c)) if c in names else c for c in features.columns))


def finite(x: Column, what: str) -> Column:
    """x; a value that is NaN or endless raises."""
    return F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.raise_error(F.lit(f"{what} isn't finite")).cast("double")).otherwise(x)


def log_amount(x: str | Column) -> Column:
    """ln(1 + amount), amounts below 0 and missing ones as 0."""
    return F.log1p(F.greatest(F.coalesce(finite(F.col(x) if isinstance(x, str) else x, "an amount"), F.lit(0.0)), F.lit(0.0)))


def within(events: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """events; one with an end that isn't among nodes (by, node) raises."""
    own = nodes.select(*by, "node").distinct()
    met = events.join(own.withColumnRenamed("node", "src").withColumn("_a", F.lit(True)), [*by, "src"], "left").join(own.withColumnRenamed("node", "dst").withColumn("_b", F.lit(True)), [*by, "dst"], "left")
    good = F.when(F.col("_a") & F.col("_b"), F.col("src")).otherwise(F.raise_error(F.lit("an event has an end outside the nodes")).cast(dict(events.dtypes)["src"]))
    return met.withColumn("src", good).select(*events.columns)


def graph_view(events: DataFrame, by: list[str], cycle_nodes: Column, nodes: DataFrame | None = None) -> DataFrame:
    """Six features of a node: degrees, flows, whether it lies on the cycle, and the share of its degree that comes in. A flow is the sum of the events' ln(1 + amount). nodes: (by, node), if events may not end elsewhere; nodes without an event have zeros then."""
    known = events if nodes is None else within(events, nodes, by)
    ends = F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"))))
    e = known.withColumn("_log", log_amount("amount")).select(*by, "_log", ends)
    flow = lambda k: F.coalesce(F.sum(F.when(F.col("out") == k, F.col("_log"))), F.lit(0.0))
    f = e.groupBy(*by, "node").agg(F.count_if(F.col("out") == 0).alias("n_in"), F.count_if(F.col("out") == 1).alias("n_out"), flow(0).alias("flow_in"), flow(1).alias("flow_out"))
    if nodes is not None:
        f = nodes.select(*by, "node").distinct().join(f, [*by, "node"], "left").fillna(0, ["n_in", "n_out", "flow_in", "flow_out"])
    return f.select(*by, "node", "n_in", "n_out", "flow_in", "flow_out", cycle_nodes.cast("int").alias("in_cycle"), (F.col("n_in") / (F.col("n_in") + F.col("n_out") + 1e-6)).alias("in_share"))


def graph_view_edges(events: DataFrame, by: list[str], on_cycle) -> DataFrame:
    """(by, event_id, src, dst, log_amount, amount, in_cycle): the features of every event; on_cycle maps a node's column to whether it lies on the cycle, on which an event lies with both ends."""
    return events.select(*by, "event_id", "src", "dst", log_amount("amount").alias("log_amount"), "amount", (on_cycle(F.col("src")) & on_cycle(F.col("dst"))).cast("int").alias("in_cycle"))


def cell_view(events: DataFrame, by: list[str]) -> DataFrame:
    """Distinct arcs with their multiplicity and earliest time relative to the group's first."""
    arcs = events.where("src <> dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("m"), F.min("hours").alias("first"))
    origin = arcs.groupBy(*by).agg(F.min("first").alias("_origin"))
    return arcs.join(origin, by).select(*by, "src", "dst", "m", F.log1p("m").alias("log_m"), (F.col("first") - F.col("_origin")).alias("since"))


def simplicial_view(events: DataFrame, by: list[str], on_cycle=None) -> DataFrame:
    """Undirected edges with their events, amount, its ln(1 + amount), and whether both ends lie on the cycle."""
    inside = on_cycle or (lambda c: F.lit(False))
    e = events.where("src <> dst").groupBy(*by, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return e.select("*", log_amount("amount").alias("log_amount"), (inside(F.col("u")) & inside(F.col("v"))).cast("int").alias("in_cycle"))


def simplicial_faces(edges: DataFrame, triangles: DataFrame, by: list[str], on_cycle) -> DataFrame:
    """(by, u, v, w, mean_log, amount, in_cycle) of triangles (by, u, v, w): the mean of their edges' ln(1 + amount), the sum of the amounts, and whether all corners lie on the cycle. edges: simplicial_view()."""
    side = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    sides = triangles.select(*by, "u", "v", "w", F.inline(F.array(side("u", "v"), side("u", "w"), side("v", "w"))))
    own = edges.select(*by, F.col("u").alias("x"), F.col("v").alias("y"), "amount", "log_amount")
    f = sides.join(own, [*by, "x", "y"], "left").fillna(0.0, ["amount", "log_amount"]).groupBy(*by, "u", "v", "w").agg((F.sum("log_amount") / 3).alias("mean_log"), F.sum("amount").alias("amount"))
    return f.withColumn("in_cycle", (on_cycle(F.col("u")) & on_cycle(F.col("v")) & on_cycle(F.col("w"))).cast("int"))


def spread(x: str) -> list[Column]:
    return [F.min(x).alias(f"{x}_min"), F.avg(x).alias(f"{x}_mean"), F.max(x).alias(f"{x}_max"), F.stddev_pop(x).alias(f"{x}_sd"), (F.max(x) - F.min(x)).alias(f"{x}_span")]


def candidate_summary(chosen: DataFrame, world: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Twenty numbers of each candidate from its chosen events (by, candidate, src, dst, hours, amount) and the degrees in its whole world."""
    c = chosen.withColumn("time", F.col("hours").cast("double")).withColumn("log_amount", F.log1p("amount"))
    events = c.groupBy("candidate").agg(F.count("*").alias("length"), *spread("time"), *spread("log_amount"))
    out = world.groupBy(*by, F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = world.groupBy(*by, F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    nodes = c.select(*by, "candidate", F.explode(F.array("src", "dst")).alias("node")).distinct().join(out, [*by, "node"], "left").join(into, [*by, "node"], "left").fillna(0, ["n_in", "n_out"])
    three = lambda x: [F.min(x).alias(f"{x}_min"), F.avg(x).alias(f"{x}_mean"), F.max(x).alias(f"{x}_max")]
    degrees = nodes.groupBy("candidate").agg(*three("n_in"), *three("n_out"))
    arcs = world.groupBy(*by, "src", "dst").agg(F.count("*").alias("m"))
    many = c.select(*by, "candidate", "src", "dst").join(arcs, [*by, "src", "dst"]).groupBy("candidate").agg(*three("m"))
    return events.join(degrees, "candidate").join(many, "candidate")


def standardized(df: DataFrame, names: list[str], fit: Column) -> DataFrame:
    """df with columns as deviations in population deviations of the rows where fit holds; a constant column keeps scale 1."""
    stats = df.where(fit).agg(*(f(c).alias(f"{n}_{c}") for c in names for f, n in ((F.avg, "a"), (F.stddev_pop, "s"), (F.min, "l"), (F.max, "h")))).first()
    def scaled(c: str) -> Column:
        s = 1.0 if stats[f"l_{c}"] == stats[f"h_{c}"] else stats[f"s_{c}"]
        return (F.col(c) - F.lit(stats[f"a_{c}"])) / F.lit(s)

    return df.withColumns({c: scaled(c) for c in names})


def collisions(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """Groups of rows with equal vectors: their number, and whether their labels differ."""
    return df.groupBy(*names).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).where("n > 1").withColumn("conflict", F.col("labels") > 1)


def edge_features(events: DataFrame, by: list[str]) -> DataFrame:
    """by, event_id, log_amount and since: the log of an amount, negative ones as zero, and the time from the group's first event."""
    origin = events.groupBy(*by).agg(F.min("hours").alias("_origin"))
    return events.join(origin, by).select(*by, "event_id", F.log10(F.greatest("amount", F.lit(0.0)) + 1).alias("log_amount"), (F.col("hours") - F.col("_origin")).alias("since"))


def assembled(events: DataFrame, by: list[str], motifs: DataFrame | None = None) -> DataFrame:
    """The eight features of every node, times from the group's first, and with motifs (by, node, ...) its columns beside them: thirteen with triangles, clustering and three cycle counts."""
    origin = events.groupBy(*by).agg(F.min("hours").alias("_origin"))  # of events, so that the nodes' figures are made once
    own = relative_times(node_features(events, by), by, ["first", "last"], origin)
    if motifs is None:
        return own
    more = [c for c in motifs.columns if c not in by and c not in ("node", "degree")]
    return own.join(motifs.select(*by, "node", *more), [*by, "node"], "left").fillna(0, more)


def shortcut_profile(chosen: DataFrame, by: list[str]) -> DataFrame:
    """by, length: candidates, parallel pairs, prevalence of y, and the ranges of amounts and times. chosen: one row for each event of a candidate (by, candidate, y, src, dst, hours, amount)."""
    one = chosen.groupBy(*by, "candidate").agg(F.count("*").alias("length"), F.max("y").alias("y"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.min("hours").alias("first"), F.max("hours").alias("last"))
    return one.groupBy(*by, "length").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("prevalence"), F.min("low").alias("amount_min"), F.max("high").alias("amount_max"), F.min("first").alias("first"), F.max("last").alias("last"))


def places(marks: DataFrame, order: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """(by, key, name): the places, in the order of its group, of what a key marks, ascending and joined by blanks. marks: (by, key, x), order: distinct (by, x). Places come from ranges, so a group with very many members takes no single task."""
    from loomgraph.functions.ordinals import with_ordinal

    placed = with_ordinal(order.select(by, "x"), [by, "x"], "_at")
    first = placed.groupBy(by).agg(F.min("_at").alias("_first"))
    met = marks.join(placed, [by, "x"]).groupBy(by, key).agg(F.sort_array(F.collect_list("_at")).alias("_all")).join(first, by)  # as many as a candidate has members
    return met.select(by, key, F.array_join(F.transform("_all", lambda x: x - F.col("_first")), " ").alias(name))


def observed_events(events: DataFrame) -> DataFrame:
    """event_id, step (the share of all steps before an event) and log_amount."""
    span = events.agg(F.min("hours").alias("_0"), (F.max("hours") - F.min("hours") + 1).alias("_n"))
    return events.join(F.broadcast(span)).select("event_id", ((F.col("hours") - F.col("_0")).cast("double") / F.col("_n")).alias("step"), F.log1p("amount").alias("log_amount"))


#: Forms of a time in text, tried in order.
TIME_FORMS = ("yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm")


def relative_hours(rows: DataFrame, text: str, order: str, name: str = "since") -> DataFrame:
    """rows with the hours from the time of the first row in the order to theirs. A text in none of TIME_FORMS raises."""
    read = F.coalesce(*(F.try_to_timestamp(F.col(text), F.lit(f)) for f in TIME_FORMS))
    seconds = F.unix_timestamp(F.coalesce(read, F.raise_error(F.lit("a time can't be read")).cast("timestamp")))
    timed = rows.withColumn("_t", seconds)
    first = timed.agg(F.min_by("_t", order).alias("_first"))
    return timed.join(F.broadcast(first)).withColumn(name, (F.col("_t") - F.col("_first")) / 3600).drop("_t", "_first")


def native_precision(x: Column) -> Column:
    """x in hundredths as a whole number of 32 bits would hold it: cut off towards zero, held at the ends, NaN as 0."""
    scaled = x * 100
    held = F.greatest(F.least(scaled, F.lit(2147483647.0)), F.lit(-2147483648.0))
    return F.when(F.isnan(x), 0.0).otherwise(F.when(held < 0, F.ceil(held)).otherwise(F.floor(held)).cast("double") / 100)


def through_float(x: Column) -> Column:
    """x after a round trip through 32 bits."""
    return x.cast("float").cast("double")


def cash_counts(events: DataFrame, by: list[str], cash: list[str], kind: str = "kind") -> DataFrame:
    """by, cash, noncash, loops and arcs: events of cash kinds and others, loops, and distinct arcs without cash and loops, which are all that a cycle may take."""
    is_cash, loop = F.col(kind).isin(cash), F.col("src") == F.col("dst")
    counts = events.groupBy(*by).agg(F.count_if(is_cash).alias("cash"), F.count_if(~is_cash).alias("noncash"), F.count_if(loop).alias("loops"))
    arcs = events.where(~is_cash & ~loop).select(*by, "src", "dst").distinct().groupBy(*by).agg(F.count("*").alias("arcs"))
    return counts.join(arcs, by, "left").fillna(0, ["arcs"])


def full_census(df: DataFrame, by: list[str], expected: int) -> DataFrame:
    """by, n; a group that hasn't the expected number of rows raises."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("n", F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.lit(f"a group hasn't {expected} rows")).cast("bigint")))


def scrubbed(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the named columns, nor fields of that name in its structs and arrays of structs."""
    def clean(c: str, kind) -> Column:
        from pyspark.sql import types as T

        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        gone = [f.name for f in inner.fields if f.name in names] if isinstance(inner, T.StructType) else []
        if not gone:
            return F.col(c)
        return (F.transform(c, lambda x: x.dropFields(*gone)) if isinstance(kind, T.ArrayType) else F.col(c).dropFields(*gone)).alias(c)

    return df.select(*(clean(f.name, f.dataType) for f in df.schema if f.name not in names))


def repeated_inputs(df: DataFrame, value: Column, world: str) -> DataFrame:
    """digest, n, worlds: values that come in more than one world."""
    return df.groupBy(F.sha2(value, 256).alias("digest")).agg(F.count("*").alias("n"), F.count_distinct(world).alias("worlds")).where("worlds > 1")
