"""Joins that check themselves: strict one-to-one, reconciliation, matching, custody with a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import dealt


def join_faults(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(fault, n): keys that come twice on a side or on one side alone; a strict join needs all to be 0. One pass over the keys of both."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    faults = {"repeated left": F.col("l") > 1, "repeated right": F.col("r") > 1, "left alone": F.col("r") == 0, "right alone": F.col("l") == 0}
    sums = n.agg(*(F.count_if(c).alias(k) for k, c in faults.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("fault"), F.col(f"`{k}`").alias("n")) for k in faults))))


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of two sides with the same keys, each once; anything else raises."""
    bad = {r.fault: r.n for r in join_faults(left, right, keys).where("n > 0").collect()}
    if bad:
        raise ValueError(f"not one to one: {bad}")
    return left.join(right, keys)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field): every field in which rows of the same key differ, nulls compared as values."""
    other = right.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields))
    differ = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    return left.join(other, keys).select(*keys, F.explode(differ).alias("field"))


def signature_join(rows: DataFrame, signatures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the value of their signature, null without one. A signature with several values raises."""
    one = signatures.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    sure = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(F.lit("a signature is ambiguous")).cast(dict(signatures.dtypes)[value]))
    return rows.join(one.select(*keys, sure.alias(value)), keys, "left")


def draw(salt: str, key: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string")))


def matched(df: DataFrame, strata: list[str], key: str, case: Column, salt: str) -> DataFrame:
    """(strata, pair, case_key, control_key): cases with controls of their stratum, one to one and without replacement, in the order of a draw."""
    order = Window.partitionBy(*strata, "_case").orderBy(draw(salt, key), key)
    ranked = df.withColumn("_case", case).withColumn("pair", F.row_number().over(order))
    cases = ranked.where("_case").select(*strata, "pair", F.col(key).alias("case_key"))
    controls = ranked.where("NOT _case").select(*strata, "pair", F.col(key).alias("control_key"))
    return cases.join(controls, [*strata, "pair"])


def worst_gap(left: DataFrame, right: DataFrame, keys: list[str], x: str, by: list[str]) -> DataFrame:
    """by, n and the largest absolute difference of x."""
    other = right.select(*keys, F.col(x).alias("_x"))
    return left.join(other, keys).groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs(F.col(x) - F.col("_x"))).alias("gap"))


def reconcile_all(parts: dict[str, DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, fault, what): how several versions of the same rows differ: `missing` and `repeated` name a version, `differs` names a field that isn't the same in all versions that have the key, nulls compared as values. One shuffle, whatever the number of versions."""
    names = list(parts)
    rows = reduce(DataFrame.unionByName, [df.select(*keys, *fields, F.lit(i).alias("_v")) for i, df in enumerate(parts.values())])
    of = [F.count_if(F.col("_v") == i).alias(f"_n{i}") for i in range(len(names))]
    same = [((F.count(f) == 0) | (F.count(f) == F.count("*")) & (F.min(f) == F.max(f))).alias(f"_s{j}") for j, f in enumerate(fields)]
    seen = rows.groupBy(*keys).agg(*of, *same)
    fault = lambda c, kind, what: F.when(c, F.struct(F.lit(kind).alias("fault"), F.lit(what).alias("what")))
    found = [fault(F.col(f"_n{i}") == 0, "missing", n) for i, n in enumerate(names)] + [fault(F.col(f"_n{i}") > 1, "repeated", n) for i, n in enumerate(names)] + [fault(~F.col(f"_s{j}"), "differs", f) for j, f in enumerate(fields)]
    return seen.select(*keys, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def custody(predictions: DataFrame, population: DataFrame, keys: list[str], group: str, label: str = "y", split: str = "split") -> DataFrame:
    """group, expected, predicted, missing, stray, repeated, label_mismatch and split_mismatch: what stands against taking the predictions for those of the population. group is one of the keys."""
    side = lambda df, i: df.select(*keys, F.lit(i).alias("_v"), F.col(label).alias("_l"), F.col(split).alias("_s"))
    rows = side(predictions, 0).unionByName(side(population, 1))
    pred, pop = F.col("_v") == 0, F.col("_v") == 1
    one = rows.groupBy(*keys).agg(F.count_if(pred).alias("p"), F.count_if(pop).alias("q"), F.max(F.when(pred, F.col("_l"))).alias("lp"), F.max(F.when(pop, F.col("_l"))).alias("lq"), F.max(F.when(pred, F.col("_s"))).alias("sp"), F.max(F.when(pop, F.col("_s"))).alias("sq"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    checks = {"expected": F.col("q") > 0, "predicted": F.col("p") > 0, "missing": F.col("p") == 0, "stray": F.col("q") == 0, "repeated": (F.col("p") > 1) | (F.col("q") > 1), "label_mismatch": both & ~F.col("lp").eqNullSafe(F.col("lq")), "split_mismatch": both & ~F.col("sp").eqNullSafe(F.col("sq"))}
    return one.groupBy(group).agg(*(F.count_if(c).alias(k) for k, c in checks.items()))


def membership(candidates: DataFrame, instances: DataFrame, by: list[str]) -> DataFrame:
    """candidates (by, cycle, events) with instance and sar, null where no instance has the same members and events. An instance may begin anywhere: members and events are turned together until the least member is first. instances: (by, instance, members, events, sar)."""
    turned = F.array_min(F.transform(F.sequence(F.lit(0), F.size("members") - 1), lambda i: F.concat(F.slice(F.arrays_zip("members", "events"), i + 1, F.size("members")), F.slice(F.arrays_zip("members", "events"), F.lit(1), i))))
    own = instances.withColumn("_t", turned).select(*by, F.col("_t")["members"].alias("cycle"), F.col("_t")["events"].alias("events"), "instance", "sar")
    return candidates.join(own, [*by, "cycle", "events"], "left")


def realization(schedules: DataFrame, attempts: DataFrame, events: DataFrame, frame: tuple) -> DataFrame:
    """alert, arcs, attempted, persisted, stray, complete, in_frame: how much of each scheduled alert came about. schedules: (alert, arcs), attempts: (attempt, alert, arc), events: (attempt, time). An alert is complete if its persisted arcs are exactly 0 to arcs - 1; in frame if it is complete within the frame. Tasks are as many as the rows need."""
    many = max(x.count() for x in (schedules, attempts, events))
    times = dealt(events.select("attempt", "time"), many, "attempt").groupBy("attempt").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    met = dealt(attempts, many, "attempt").join(times, "attempt", "left").select("alert", "arc", "first", "last")
    met = dealt(met, many, "alert").join(dealt(schedules, many, "alert"), "alert", "right")
    there, inside = F.col("first").isNotNull(), (F.col("arc") >= 0) & (F.col("arc") < F.col("arcs"))
    sums = met.groupBy("alert", "arcs").agg(F.count("arc").alias("attempted"), F.count_if(there).alias("persisted"), F.count_if(there & ~inside).alias("stray"), F.count_distinct(F.when(there & inside, F.col("arc"))).alias("_arcs"), F.min("first").alias("_first"), F.max("last").alias("_last"))
    complete = (F.col("_arcs") == F.col("arcs")) & (F.col("stray") == 0)
    return sums.select("alert", "arcs", "attempted", "persisted", "stray", complete.alias("complete"), (complete & F.coalesce((F.col("_first") >= frame[0]) & (F.col("_last") <= frame[1]), F.lit(False))).alias("in_frame"))
