"""World bundles: side files that describe candidates row by row, indexes of worlds, and result tables that must be complete."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.readers import csv_fields, json_keys, placed_json, strict_json, written_lines

#: Fields that an observation may not hold, as they name it or give its label away.
OBSERVED_NEVER = {"label", "sar", "alert_id", "alertID", "seed", "generator", "role", "candidate_rank", "event_ordinal", "candidate_id", "instance_id", "world_id", "account_id", "event_ids"}
#: Times are steps in units of the whole period.
LAST_TIME = 1.0000001
#: Schemas of the side files of a bundle, by name.
OBSERVATIONS = "selected_event_mask array<double>, central_node_mask array<double>, cycle_length double, world_event_time_steps array<double>, world_event_log1p_amounts array<double>"
IDENTITY = "candidate_id string, event_ids array<bigint>, cycle_accounts array<string>"
CELLS = "candidate_id string, boundary array<struct<event_id: bigint>>"
OTHERS = "candidate_id string"
GRAPH = "physical_event_id bigint, source_account string, target_account string"


def resolve(given: str | None, variable: str, default: str) -> str:
    """A path: the given one, else that of an environment variable, else the default; nothing else is tried."""
    return given or os.environ.get(variable) or default


def inside(root: str, name: str, allowed: set[str]) -> str:
    """root/name for an allowed name that stays in root and is no link, on any store; anything else raises."""
    if name not in allowed or os.path.isabs(name) or ".." in name.split("/"):
        raise ValueError(f"not an allowed input: {name}")
    at = f"{root.rstrip('/')}/{name}"
    here = root.rstrip("/")
    for part in name.split("/"):
        here = f"{here}/{part}"
        if linked(here):
            raise ValueError(f"a link isn't allowed: {here}")
    return at


def linked(path: str) -> bool:
    """Whether a path is a link, as the store that holds it says; a path without a scheme is a local one."""
    if "://" not in path and not path.startswith("file:"):
        return os.path.islink(path)
    if path.startswith("file:"):
        return os.path.islink("/" + path[5:].lstrip("/"))
    sc = SparkSession.active().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return bool(store.exists(at) and store.getFileLinkStatus(at).isSymlink())


def bundle_faults(parts: dict[str, DataFrame], nodes: DataFrame, events: DataFrame, graph: DataFrame) -> DataFrame:
    """(place, fault) of a bundle. parts: observations, identity, cells and any others, each with its place; nodes: (at, node) and events: (at, event), the orders of coordinates; graph: (event, src, dst).

    A candidate has every part at one place under one id; its masks are zeros and ones as long as the orders; what they mark is what its identity
    names; its length is theirs; its boundary is a closed walk over its events. The orders name everything once, the graph's events are those of the order and end
    at nodes of it. All candidates share the world's times, from 0 to 1, and amounts, a finite number for each event.
    """
    obs, ident, cells = (parts[k] for k in ("observations", "identity", "cells"))
    names = list(parts)
    seen = reduce(DataFrame.unionByName, [p.select("place", F.lit(k).alias("part")) for k, p in parts.items()])
    out = [seen.groupBy("place").agg(F.count("*").alias("n"), F.count_distinct("part").alias("k")).where((F.col("n") != len(names)) | (F.col("k") != len(names))).select("place", F.lit("parts don't align").alias("fault"))]
    named = reduce(DataFrame.unionByName, [p.select("place", "candidate_id") for k, p in parts.items() if "candidate_id" in p.columns])
    out.append(named.groupBy("place").agg(F.count_distinct("candidate_id").alias("k")).where("k <> 1").select("place", F.lit("ids differ").alias("fault")))
    out.append(ident.groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n > 1").select("place", F.lit("an id comes twice").alias("fault")))
    sizes = nodes.agg(F.count("*").alias("n_nodes")).join(events.agg(F.count("*").alias("n_events")))
    binary = lambda c: F.forall(c, lambda x: F.coalesce(x.isin(0.0, 1.0), F.lit(False)))
    masks = obs.join(F.broadcast(sizes)).where(~F.coalesce(binary("selected_event_mask") & binary("central_node_mask") & (F.size("selected_event_mask") == F.col("n_events")) & (F.size("central_node_mask") == F.col("n_nodes")), F.lit(False)))
    out.append(masks.select("place", F.lit("a mask isn't binary or has another length").alias("fault")))
    out += [marked(obs, "selected_event_mask", events, "event", ident, "event_ids", "events"), marked(obs, "central_node_mask", nodes, "node", ident, "cycle_accounts", "accounts")]
    out += [world_vectors(obs, sizes), covered(nodes, events, graph)]
    length = obs.join(ident, "place").where(~F.coalesce((F.col("cycle_length") >= 2) & (F.col("cycle_length") == F.size(F.array_distinct("event_ids"))) & (F.col("cycle_length") == F.size(F.array_distinct("cycle_accounts"))), F.lit(False)))
    out.append(length.select("place", F.lit("the length differs").alias("fault")))
    steps = cells.select("place", F.size("boundary").alias("_n"), F.posexplode("boundary").alias("at", "b")).select("place", "_n", "at", F.col("b.event_id").alias("event"))
    walked = steps.join(graph, "event", "left")
    after = walked.select("place", F.pmod(F.col("at") - 1, F.col("_n")).alias("at"), F.col("src").alias("next"))
    open_ = walked.join(after, ["place", "at"]).where(~F.coalesce(F.col("dst") == F.col("next"), F.lit(False)))
    out.append(open_.select("place", F.lit("the boundary isn't closed").alias("fault")).distinct())
    other = steps.groupBy("place").agg(F.sort_array(F.collect_list("event")).alias("b")).join(ident, "place").where(F.col("b") != F.sort_array("event_ids"))  # as many as a candidate has events
    out.append(other.select("place", F.lit("the boundary has other events").alias("fault")))
    return reduce(DataFrame.unionByName, out)


def world_vectors(obs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Places whose times or amounts aren't a finite number for each event, leave their range, or differ from the first place's."""
    times, amounts = F.col("world_event_time_steps"), F.col("world_event_log1p_amounts")
    finite = lambda c: F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = finite(times) & finite(amounts) & (F.size(times) == F.col("n_events")) & (F.size(amounts) == F.col("n_events")) & F.forall(times, lambda x: (x >= 0) & (x <= LAST_TIME))
    wrong = obs.join(F.broadcast(sizes)).where(~F.coalesce(good, F.lit(False))).select("place", F.lit("world times or amounts aren't valid").alias("fault"))
    own = obs.select("place", F.sha2(F.to_json(F.struct(times, amounts)), 256).alias("h"))
    first = own.agg(F.min_by("h", "place").alias("first"))
    return wrong.unionByName(own.join(F.broadcast(first)).where("h <> first").select("place", F.lit("candidates don't share the world's times and amounts").alias("fault")))


def covered(nodes: DataFrame, events: DataFrame, graph: DataFrame) -> DataFrame:
    """A fault, without a place, for coordinates that come twice, events of the graph beside the order or missing from it, and ends that aren't nodes."""
    twice = lambda df, c: df.groupBy(c).count().where("count > 1").select(F.lit("a coordinate comes twice").alias("fault"))
    here, there = events.select("event"), graph.select("event")
    apart = here.exceptAll(there).unionByName(there.exceptAll(here)).select(F.lit("the graph doesn't cover the order of events").alias("fault"))
    ends = graph.select(F.explode(F.array("src", "dst")).alias("node")).join(nodes, "node", "left_anti").select(F.lit("an event ends outside the order of nodes").alias("fault"))
    faults = twice(nodes, "node").unionByName(twice(events, "event")).unionByName(apart).unionByName(ends)
    return faults.distinct().select(F.lit(None).cast("bigint").alias("place"), "fault")


def marked(obs: DataFrame, mask: str, order: DataFrame, item: str, ident: DataFrame, named: str, what: str) -> DataFrame:
    """Places where what a mask marks isn't what the identity names."""
    ones = obs.select("place", F.posexplode(mask).alias("at", "x")).where("x = 1").join(order, "at").select("place", F.col(item).alias("item"), F.lit(1).alias("m"), F.lit(0).alias("i"))
    own = ident.select("place", F.explode(F.array_distinct(named)).alias("item"), F.lit(0).alias("m"), F.lit(1).alias("i"))
    both = ones.unionByName(own).groupBy("place", "item").agg(F.sum("m").alias("m"), F.sum("i").alias("i"))
    return both.where("m <> i").select("place", F.lit(f"mask and identity name other {what}").alias("fault")).distinct()


def bundle(spark: SparkSession, root: str, nodes: DataFrame, events: DataFrame, others: tuple[str, ...] = ("simplicial_subdivision", "hasse_incidence")) -> DataFrame:
    """place, candidate_id, masks, length, events, accounts and boundary of a world's candidates; any fault raises. Labels lie in a file of their own that this doesn't open."""
    observed = inside(root, "candidate_observations.jsonl", {"candidate_observations.jsonl"})
    if names := sorted(r.key for r in json_keys(spark, observed).where(F.col("key").isin(*OBSERVED_NEVER)).collect()):
        raise ValueError(f"observations hold forbidden fields: {names}")
    read = lambda name, schema: placed_json(spark, inside(root, f"{name}.jsonl", {f"{name}.jsonl"}), schema)
    parts = {"observations": read("candidate_observations", OBSERVATIONS), "identity": read("candidate_identity", IDENTITY), "cells": read("cellular_polygonal_boundaries", CELLS)} | {n: read(n, OTHERS) for n in others}
    graph = read("world_directed_multigraph_identity", GRAPH).select(F.col("physical_event_id").alias("event"), F.col("source_account").alias("src"), F.col("target_account").alias("dst"))
    if bad := bundle_faults(parts, nodes, events, graph).limit(5).collect():
        raise ValueError(f"the bundle isn't whole: {[tuple(r) for r in bad]}")
    return parts["observations"].join(parts["identity"], "place").join(parts["cells"].drop("candidate_id"), "place")


def labelled_census(spark: SparkSession, root: str, candidates: DataFrame, index: DataFrame, world: str, role: str, frame: int) -> DataFrame:
    """The candidates of a world (from bundle()) with their labels: exactly `frame` of them, each with one label that is written as a whole number 0 or 1, no label beside them, in a world that the index gives this role. Anything else raises."""
    index_entries(index.where((F.col("world") == world) | (F.col("role") != role)), [world], role)
    raw = written_lines(spark, inside(root, "candidate_labels.jsonl", {"candidate_labels.jsonl"}))
    labels = raw.select(strict_json(F.col("value"), "candidate_id string").getField("candidate_id").alias("candidate_id"), F.regexp_extract("value", r'"label"\s*:\s*([01])\s*[,}]', 1).alias("label"))
    counts = labels.agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("ids"), F.count_if(F.col("label") == "").alias("bad")).first()
    n = candidates.count()
    if counts.bad:
        raise ValueError(f"{counts.bad} labels aren't 0 or 1")
    if not n == counts.n == counts.ids == frame:
        raise ValueError(f"the frame has {frame} candidates, the world {n}, with {counts.n} labels of {counts.ids}")
    out = candidates.join(labels.select("candidate_id", F.col("label").cast("int").alias("label")), "candidate_id")
    if out.count() != frame:
        raise ValueError("labels and candidates don't join")
    return out


#: A native event's line: eleven fields, of which these are read.
STEP, AMOUNT, SOURCE, TARGET, PERIOD = 0, 2, 3, 6, 120.0


def native_events(lines: DataFrame) -> DataFrame:
    """(event, src, dst, time, log_amount) of native lines (event, csv_line): times in periods, ln(1 + amount). A line that hasn't eleven fields, a whole step and an amount above 0 raises."""
    f = csv_fields(F.col("csv_line"), 11)
    read = lines.select("event", f.alias("f")).select("event", "f", F.get("f", F.lit(STEP)).try_cast("int").alias("step"), F.get("f", F.lit(AMOUNT)).try_cast("double").alias("amount"))
    good = F.coalesce((F.col("amount") > 0) & (F.col("amount") < float("inf")) & F.col("step").isNotNull(), F.lit(False))
    event = F.when(good, F.col("event")).otherwise(F.raise_error(F.lit("a native event isn't valid")).cast("bigint"))
    return read.select(event.alias("event"), F.get("f", F.lit(SOURCE)).alias("src"), F.get("f", F.lit(TARGET)).alias("dst"), (F.col("step") / PERIOD).alias("time"), F.log1p("amount").alias("log_amount"))


def physical_faults(candidates: DataFrame, native: DataFrame, graph: DataFrame, events: DataFrame) -> DataFrame:
    """(place, event, fault): where a bundle's observations differ from the native events. candidates: bundle(); native: native_events(); graph: (event, src, dst); events: (at, event), the order of coordinates.

    The native events are those of the graph, once each, with its ends; every candidate's world times and amounts are theirs in the order of coordinates, to the last bit.
    """
    seen = reduce(DataFrame.unionByName, [df.select("event", F.lit(k).alias("k")) for k, df in enumerate((native, graph, events))])
    aligned = seen.groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("k").alias("k")).where("n <> 3 OR k <> 3").select(F.lit(None).cast("bigint").alias("place"), "event", F.lit("events don't join").alias("fault"))
    ends = native.join(graph.select("event", F.col("src").alias("_a"), F.col("dst").alias("_b")), "event").where("src <> _a OR dst <> _b").select(F.lit(None).cast("bigint").alias("place"), "event", F.lit("ends differ").alias("fault"))
    placed = events.join(native, "event")
    values = candidates.select("place", F.posexplode(F.arrays_zip("world_event_time_steps", "world_event_log1p_amounts")).alias("at", "x")).select("place", "at", "x.*")
    met = values.join(placed, "at")
    differs = met.where("NOT (world_event_time_steps <=> time AND world_event_log1p_amounts <=> log_amount)").select("place", "event", F.lit("values differ").alias("fault"))
    return aligned.unionByName(ends).unionByName(differs)


def feature_gap(ours: DataFrame, theirs: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(feature, gap): the largest difference of each feature between two tables of the same candidates; a candidate that one of them lacks raises."""
    met = ours.select(key, F.struct(*names).alias("_a")).join(theirs.select(key, F.struct(*names).alias("_b")), key, "full")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the tables hold other candidates")).cast("double"))
    gaps = met.agg(*(F.max(F.coalesce(whole, F.abs(F.col(f"_a.{n}") - F.col(f"_b.{n}")))).alias(n) for n in names))
    return gaps.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("gap")) for n in names))))


def index_entries(index: DataFrame, wanted: list[str], role: str) -> DataFrame:
    """The entries of the wanted worlds that are no replays. index: (world, role, status, exit_code, replay). A wanted world that is missing, comes twice, has another role or didn't succeed raises, and so does a world of the role that isn't wanted."""
    own = index.where(~F.coalesce("replay", F.lit(False)))
    bad = own.where(F.col("world").isin(wanted) & ~F.coalesce((F.col("role") == role) & (F.col("status") == "complete") & (F.col("exit_code") == 0), F.lit(False))).select("world")
    asked = index.sparkSession.createDataFrame([(w,) for w in wanted], "world string")
    here = own.where(F.col("role") == role).select("world")
    faults = bad.unionByName(asked.exceptAll(here)).unionByName(here.exceptAll(asked))
    if found := [r.world for r in faults.limit(5).collect()]:
        raise ValueError(f"the index doesn't cover the worlds exactly: {found}")
    return own.where(F.col("world").isin(wanted))


def panel(df: DataFrame, dims: dict[str, list], valid: Column | None = None) -> DataFrame:
    """df, if it has every combination of the dimensions' values once, and no other, and `valid` holds in every row."""
    spark = df.sparkSession
    grid = reduce(lambda a, b: a.join(b), [spark.createDataFrame([(v,) for v in values], f"{c} {dict(df.dtypes)[c]}") for c, values in dims.items()])  # what the caller listed
    keys = df.select(*dims)
    faults = grid.exceptAll(keys).unionByName(keys.exceptAll(grid))
    if found := [tuple(r) for r in faults.limit(5).collect()]:
        raise ValueError(f"the panel isn't complete: {found}")
    if valid is not None and (found := [tuple(r) for r in df.where(~F.coalesce(valid, F.lit(False))).select(*dims).limit(5).collect()]):
        raise ValueError(f"rows aren't valid: {found}")
    return df


def undefined_or(x: str, reason: str, low: float = 0.0, high: float = 1.0) -> Column:
    """Whether x is a number in its range without a reason, or missing with one."""
    v, why = F.col(x), F.coalesce(F.trim(reason), F.lit(""))
    return (v.isNull() & (why != "")) | (v.isNotNull() & ~F.isnan(v) & (v >= low) & (v <= high) & (why == ""))


def cached_vectors(df: DataFrame, key: str, vector: str, label: str, width: int) -> DataFrame:
    """df, if keys are given once, vectors are finite and of one width, and labels are 0 or 1."""
    good = F.col(key).isNotNull() & (F.size(vector) == width) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.col(label).isin(0, 1)
    if df.where(~F.coalesce(good, F.lit(False))).limit(1).count():
        raise ValueError("a cached vector isn't valid")
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key comes twice")
    return df
