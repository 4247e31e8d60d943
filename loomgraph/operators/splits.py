"""Folds that keep linked candidates together, splits, leakage, label rules and flow checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.operators.components import stars
from loomgraph.operators.joins import draw


def groups(tokens: DataFrame) -> DataFrame:
    """(candidate, grp): candidates that share a token, however far along, in one group named by its least member. tokens: (candidate, token). A token links its candidates by a star, so a common one costs as many edges as it has rows."""
    least = tokens.groupBy("token").agg(F.min("candidate").alias("b"))
    edges = tokens.join(least, "token").select(F.col("candidate").alias("a"), "b")
    roots = stars(edges).select(F.col("a").alias("candidate"), F.col("b").alias("grp"))
    return tokens.select("candidate").distinct().join(roots, "candidate", "left").select("candidate", F.coalesce("grp", "candidate").alias("grp"))


def group_profile(labelled: DataFrame) -> DataFrame:
    """(grp, n, positives) of (candidate, grp, y)."""
    return labelled.groupBy("grp").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


def dealt(load: list[list[int]], positives: int, rows: int, count: int) -> list[tuple[int, list[int]]]:
    """Deals `count` equal groups one by one, each to the best fold, without a step for each: runs of (number of groups, folds in turn). load: [positives, rows] of each fold, brought up to date.

    The best fold has the least (positives, rows) for groups of positives alone, (negatives, rows) for those of negatives alone, and (rows, positives, negatives) for mixed ones, ties going to the first.
    A fold's key grows by the same step with each group it takes, so the folds whose keys lie within a step of the least take turns, until another's key is reached.
    """
    if positives == rows:
        key, step = (lambda f: (load[f][0], load[f][1], f)), (positives, rows)
    elif not positives:
        key, step = (lambda f: (load[f][1] - load[f][0], load[f][1], f)), (rows, rows)
    else:
        key, step = (lambda f: (load[f][1], load[f][0], load[f][1] - load[f][0], f)), (rows, positives, rows - positives)

    def below(f: int, g: int) -> int:
        """How many groups f takes before g's key is the lesser."""
        own, other = key(f), key(g)
        n = max(0, -(-(other[0] - own[0]) // step[0]))
        moved = (*(x + n * d for x, d in zip(own, step, strict=False)), f)
        return n + (moved < other)

    waiting, turn, out = sorted(range(len(load)), key=key), [], []
    while count:
        if waiting:
            turn.append(waiting.pop(0))
        turn.sort(key=key)
        most = [below(f, waiting[0]) for f in turn] if waiting else [count] * len(turn)
        n = min(count, sum(most))
        if not n:
            continue
        each = [n // len(turn) + (k < n % len(turn)) for k in range(len(turn))]
        for f, e in zip(turn, each, strict=True):
            load[f][0] += positives * e
            load[f][1] += rows * e
        out.append((n, list(turn)))
        count -= n
    return out


def fold_of_groups(profile: DataFrame, folds: int, salt: str) -> DataFrame:
    """(grp, fold): groups in order of positives and size, those with most first, equal ones in the order of a draw, each to the best fold at its time (dealt()).

    Groups with the same positives and size form a class, whose folds follow from the loads in at most `folds` runs. The driver holds a row for each class: sizes that differ add up to the rows, so N rows have
    at most about the root of 2 N sizes. Groups are numbered by ranges; none comes to the driver.
    """
    spark = profile.sparkSession
    kind = dict(profile.dtypes)["grp"]
    ordered = profile.select("grp", (-F.col("positives")).cast("bigint").alias("_p"), (-F.col("n")).cast("bigint").alias("_m"), draw(salt, "grp").alias("_d"))
    placed = with_ordinal(ordered, ["_p", "_m", "_d", "grp"], "_at")
    load, start, rows = [[0, 0] for _ in range(folds)], 0, []
    for r in placed.groupBy("_p", "_m").count().orderBy("_p", "_m").collect():
        runs = []
        for n, turn in dealt(load, -r["_p"], -r["_m"], r["count"]):
            runs.append((start, start + n, turn))
            start += n
        rows.append((r["_p"], r["_m"], runs))
    turns = spark.createDataFrame(rows, "_p bigint, _m bigint, _runs array<struct<start: bigint, stop: bigint, turn: array<int>>>")
    met = placed.join(turns, ["_p", "_m"]).withColumn("_run", F.filter("_runs", lambda x: (F.col("_at") >= x["start"]) & (F.col("_at") < x["stop"]))[0])
    turn = F.col("_run.turn")
    return met.select(F.col("grp").cast(kind).alias("grp"), F.get(turn, F.pmod(F.col("_at") - F.col("_run.start"), F.size(turn)).cast("int")).alias("fold"))


def leaks(placed: DataFrame, token: str = "token") -> DataFrame:
    """Tokens that come in more than one fold, with the number of folds."""
    return placed.groupBy(token).agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def three_way(fold: Column, test: int, folds: int) -> Column:
    """test, validation (the next fold) or train."""
    return F.when(fold == test, "test").when(fold == (test + 1) % folds, "validation").otherwise("train")


def cycle_labels(arcs: DataFrame, events: DataFrame, bad: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cycle, label): 1 if every arc has a bad event, 0 if no event of its arcs is bad; cycles between are left out. arcs: (by, cycle, src, dst)."""
    some = events.groupBy(*by, "src", "dst").agg(F.bool_or(bad).alias("bad"))
    all_ = arcs.join(some, [*by, "src", "dst"], "left").groupBy(*by, "cycle").agg(F.bool_and(F.coalesce("bad", F.lit(False))).alias("every"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("any"))
    return all_.where(F.col("every") | ~F.col("any")).select(*by, "cycle", F.col("every").cast("int").alias("label"))


def single_pattern(arcs: DataFrame, patterns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cycle, pattern): the pattern of a cycle's labelled arcs where there is exactly one, else null. patterns: (by, src, dst, pattern)."""
    met = arcs.join(patterns.select(*by, "src", "dst", "pattern").distinct(), [*by, "src", "dst"], "left").groupBy(*by, "cycle").agg(F.min("pattern").alias("a"), F.max("pattern").alias("b"))
    return met.select(*by, "cycle", F.when(F.col("a") == F.col("b"), F.col("a")).alias("pattern"))


def flow_faults(hops: DataFrame, ring: str, place: str, most_fee: float = 0.02, tolerance: float = 1e-4) -> DataFrame:
    """ring and what breaks its flow: a gap between one hop's end and the next one's start, a time that goes back, an amount that grows, or a fee beyond most_fee. hops: (src, dst, time, amount)."""
    w = Window.partitionBy(ring).orderBy(place)
    end, time, amount = F.lag("dst").over(w), F.lag("time").over(w), F.lag("amount").over(w)
    checks = {"gap": F.col("src") != end, "time": F.col("time") < time, "growth": F.col("amount") > amount + tolerance, "fee": F.col("amount") < amount * (1 - most_fee) - tolerance}
    marked = hops.withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    return marked.groupBy(ring).agg(F.count("*").alias("hops"), *(F.count_if(F.col(f"_{k}")).alias(k) for k in checks))


def ring_labels(arcs: DataFrame, injected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cycle, label): 1 if every arc of a cycle carries an injected edge and all are of one ring, 0 if none does; others are left out. arcs: (by, cycle, src, dst), injected: (by, src, dst, ring)."""
    own = injected.select(*by, "src", "dst", "ring").distinct()
    met = arcs.join(own, [*by, "src", "dst"], "left").groupBy(*by, "cycle").agg(F.count_if(F.col("ring").isNull()).alias("_bare"), F.count("ring").alias("_some"), F.count_distinct("ring").alias("_rings"))
    whole = (F.col("_bare") == 0) & (F.col("_rings") == 1)
    return met.where(whole | (F.col("_some") == 0)).select(*by, "cycle", whole.cast("int").alias("label"))
