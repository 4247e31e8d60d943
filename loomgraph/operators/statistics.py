"""Exact and resampling statistics over small panels of worlds, and detectors over histories."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.running import running


def midranks(df: DataFrame, by: list[str], x: str, name: str = "doubled_rank") -> DataFrame:
    """df with twice the midrank of x within by, a whole number: from the counts of equal values, so a group with many rows isn't gathered."""
    tied = running(df.groupBy(*by, x).agg(F.count("*").alias("_tied")), by, F.col(x).asc(), {"_upto": "_tied"})
    keys = [*by, x]
    met = df.join(tied.select(*(F.col(c).alias(f"_key_{c}") for c in keys), (2 * F.col("_upto") - F.col("_tied") + 1).alias(name)), [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return met.drop(*(f"_key_{c}" for c in keys))


def signed_rank(df: DataFrame, by: list[str], x: str, most: int = 30) -> DataFrame:
    """by, n, n_zero, w_plus (doubled), ways, p: the exact two-sided signed-rank test.

    Differences are rounded to 12 places, zeros left out, ties share their midrank. The distribution of the doubled rank
    sum under random signs is a fold over the ranks of an array of counts; p is exact up to the last division.
    """
    own = df.select(*by, F.round(F.col(x), 12).alias("d"))
    zero = own.groupBy(*by).agg(F.count_if(F.col("d") == 0).alias("n_zero"))
    ranked = midranks(own.where("d <> 0").withColumn("_abs", F.abs("d")), by, "_abs")
    one = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("doubled_rank")).otherwise(0)).alias("w_plus"), F.collect_list("doubled_rank").alias("ranks"))
    one = one.withColumn("ranks", F.when(F.col("n") <= most, F.col("ranks")).otherwise(F.raise_error(F.lit(f"more than {most} differences"))))
    total = F.aggregate("ranks", F.lit(0).cast("bigint"), lambda a, r: a + r)
    start = F.array(F.lit(1).cast("bigint"))

    def step(ways: Column, r: Column) -> Column:
        pad = F.array_repeat(F.lit(0).cast("bigint"), r.cast("int"))
        return F.zip_with(F.concat(ways, pad), F.concat(pad, ways), lambda a, b: a + b)

    ways = F.aggregate("ranks", start, step)
    least = F.least("w_plus", total - F.col("w_plus"))
    tail = F.aggregate(F.slice("ways", F.lit(1), (least + 1).cast("int")), F.lit(0).cast("bigint"), lambda a, w: a + w)
    made = one.withColumn("ways", ways).select(*by, "n", "w_plus", tail.alias("tail"))
    return zero.join(made, by, "left").select(*by, "n_zero", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0)).alias("w_plus"), F.least(F.lit(1.0), F.coalesce(2 * F.col("tail") / F.pow(F.lit(2.0), "n"), F.lit(1.0))).alias("p"))


def holm(df: DataFrame, family: list[str], name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """df with adjusted, the step-down p-value, and rejected: all smaller p-values pass their own bound too."""
    order, all_ = Window.partitionBy(*family).orderBy(p, name), Window.partitionBy(*family)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count("*").over(all_) - F.row_number().over(order) + 1
    out = df.withColumn("_left", left)
    return out.select(*df.columns, F.max(F.least(F.lit(1.0), F.col("_left") * F.col(p))).over(so_far).alias("adjusted"), F.min(F.col(p) <= alpha / F.col("_left")).over(so_far).alias("rejected"))


def holm_rounded(df: DataFrame, family: list[str], order: str, p: str, alpha: float = 0.05, places: int = 5) -> DataFrame:
    """df with adjusted, to some places, and rejected, as holm() but ties in the order of a column."""
    return holm(df, family, order, p, alpha).withColumn("adjusted", F.round("adjusted", places))


def cohens_d(df: DataFrame, by: list[str], x: str, group: Column) -> DataFrame:
    """by, d: the difference of means of group and rest over their pooled deviation; 0 where a side has fewer than two."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    s = df.groupBy(*by).agg(*(f(c).alias(n) for c, k in ((a, "a"), (b, "b")) for f, n in ((F.count, f"n{k}"), (F.avg, f"m{k}"), (F.var_samp, f"v{k}"))))
    pooled = F.sqrt(F.greatest(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2), F.lit(1e-12)))
    return s.select(*by, F.when((F.col("na") < 2) | (F.col("nb") < 2), 0.0).otherwise((F.col("ma") - F.col("mb")) / pooled).alias("d"))


def bootstrap(values: DataFrame, unit: str, by: list[str], x: str, draws: int, salt: str, quantiles: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """by, lower, upper: percentile interval of the mean of x over resampled units; the same draws for all of by.

    A unit takes part in a draw as often as a hash of (draw, slot) lands on its place, so the index table is the same anywhere.
    """
    means = resampled(values, unit, by, x, draws, salt)
    return means.groupBy(*by).agg(*(F.percentile("mean", q).alias(c) for q, c in zip(quantiles, ("lower", "upper"), strict=True)))


def runs(df: DataFrame, by: list[str], order: str, good: Column) -> DataFrame:
    """df with run: how many rows in a row up to this one are good; 0 where it isn't."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.row_number().over(w) - F.sum(F.when(good, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_good", good).withColumn("_island", island)
    inside = Window.partitionBy(*by, "_island", "_good").orderBy(order)
    return marked.withColumn("run", F.when(F.col("_good"), F.row_number().over(inside)).otherwise(0)).drop("_good", "_island")


def stable_windows(df: DataFrame, by: list[str], step: str, x: str, width: int, most: float) -> DataFrame:
    """df with stable: the last `width` steps are complete and x ranges over at most a share `most` of its least value there."""
    w = Window.partitionBy(*by).orderBy(step).rangeBetween(-(width - 1), 0)
    low, high, n = F.min(x).over(w), F.max(x).over(w), F.count(x).over(w)
    return df.withColumn("stable", (n == width) & (high - low <= most * low))


def resampled(values: DataFrame, unit: str, by: list[str], x: str, draws: int, salt: str, n_of: str | None = None) -> DataFrame:
    """by, draw, mean: the resampled means behind bootstrap(). With n_of, x is a sum over so many observations of the unit, and the mean is that over all of them."""
    placed = values.select(unit).distinct().withColumn("_at", F.row_number().over(Window.orderBy(unit)) - 1)  # units are the worlds of a study
    n = max(placed.agg(F.count("*")).first()[0], 1)
    slots = values.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    picks = slots.select("draw", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "draw", "slot")), 1, 12), 16, 10).cast("bigint"), F.lit(n)).cast("int").alias("_at"))
    counted = picks.groupBy("draw", "_at").agg(F.count("*").alias("times")).join(placed, "_at")
    return counted.join(values, unit).groupBy(*by, "draw").agg((F.sum(F.col(x) * F.col("times")) / F.sum(F.col("times") * (F.col(n_of) if n_of else F.lit(1)))).alias("mean"))


def cluster_sums(pairs: DataFrame, cluster: str, by: list[str], a: str, b: str) -> DataFrame:
    """by, cluster, _d and _n: the sum of a - b over a cluster's observations, and their number."""
    return pairs.groupBy(*by, cluster).agg(F.sum(F.col(a) - F.col(b)).alias("_d"), F.count("*").alias("_n"))


def cluster_difference(pairs: DataFrame, cluster: str, by: list[str], a: str, b: str, draws: int, salt: str, alpha: float = 0.05) -> DataFrame:
    """by, lower, upper, p, sd: the mean difference a - b over all observations of resampled clusters, so a large cluster weighs more; p is the share of draws at or below 0."""
    means = resampled(cluster_sums(pairs, cluster, by, a, b), cluster, by, "_d", draws, salt, "_n")
    return means.groupBy(*by).agg(F.percentile("mean", alpha / 2).alias("lower"), F.percentile("mean", 1 - alpha / 2).alias("upper"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"), F.stddev_samp("mean").alias("sd"))


def equivalence(pairs: DataFrame, cluster: str, by: list[str], a: str, b: str, margin: float, draws: int, salt: str, alpha: float = 0.05) -> DataFrame:
    """by, p_lower, p_upper, equivalent: two one-sided tests of the mean difference against -margin and margin; equivalent if the interval from alpha to 1 - alpha lies between them."""
    m = resampled(cluster_sums(pairs, cluster, by, a, b), cluster, by, "_d", draws, salt, "_n")
    inside = (F.percentile("mean", alpha) > -margin) & (F.percentile("mean", 1 - alpha) < margin)
    return m.groupBy(*by).agg(F.avg((F.col("mean") <= -margin).cast("double")).alias("p_lower"), F.avg((F.col("mean") >= margin).cast("double")).alias("p_upper"), inside.alias("equivalent"))


#: Stirling's series beyond n ln n - n + ln(2 pi n) / 2: fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def stirling_rest(n: float) -> float:
    """ln n! less n ln n - n + ln(2 pi n) / 2, exact to the last digits."""
    if n < 16:
        return math.lgamma(n + 1) - (n * math.log(n) - n + math.log(2 * math.pi * n) / 2) if n else 0.0
    return sum(c / n ** (2 * i + 1) for i, c in enumerate(STIRLING))


def deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without the loss of digits where x is near its mean."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v, out = d / (x + mean), 0.0
    term, power = 2 * x * v, v * v
    total = d * v
    for k in range(1, 200):
        term *= power
        out, total = total, total + term / (2 * k + 1)
        if total == out:
            break
    return total


def binomial_log(x: int, n: int, p: float) -> float:
    """ln of the chance of x hits in n trials, by saddle point."""
    if not 0 <= x <= n:
        return -math.inf
    if x == 0:
        return n * math.log1p(-p) if p < 1 else (0.0 if n == 0 else -math.inf)
    if x == n:
        return n * math.log(p)
    rest = stirling_rest(n) - stirling_rest(x) - stirling_rest(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return rest + math.log(n / (2 * math.pi * x * (n - x))) / 2


def hypergeometric_mass(population: int, positives: int, drawn: int, hits: int) -> float:
    """The chance of exactly so many hits."""
    if not max(0, drawn - (population - positives)) <= hits <= min(positives, drawn):
        return 0.0
    if drawn in (0, population):
        return 1.0
    p = drawn / population
    return math.exp(binomial_log(hits, positives, p) + binomial_log(drawn - hits, population - positives, p) - binomial_log(drawn, population, p))


def hypergeometric_tail(population: int, positives: int, drawn: int, hits: int, up: bool) -> float:
    """The chance of at least (up) or at most so many hits. The tail that falls away from the mode is summed by the ratio of neighbours until terms no longer count; the other is what it leaves."""
    low, high = max(0, drawn - (population - positives)), min(positives, drawn)
    if up and hits <= low or not up and hits >= high:
        return 1.0
    if up and hits > high or not up and hits < low:
        return 0.0
    mode = (drawn + 1) * (positives + 1) // (population + 2)
    if up and hits <= mode or not up and hits >= mode:
        return max(0.0, 1.0 - hypergeometric_tail(population, positives, drawn, hits - 1 if up else hits + 1, not up))
    x, term, total = hits, hypergeometric_mass(population, positives, drawn, hits), 0.0
    while term > total * 1e-18 and low <= x <= high:
        total += term
        if up:
            term *= (positives - x) / (x + 1) * (drawn - x) / (population - positives - drawn + x + 1)
            x += 1
        else:
            term *= x / (positives - x + 1) * (population - positives - drawn + x) / (drawn - x + 1)
            x -= 1
    return min(1.0, total)


def bisected(low: int, high: int, good) -> int:
    """The first number in [low, high] that is good, where all after it are; high is taken as good."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle + 1, high)
    return low


def hypergeometric(df: DataFrame, population: str, positives: str, drawn: str, hits: str) -> DataFrame:
    """df with tail: the chance of at least so many hits among the drawn. Time grows with the tail's width, not with the population."""

    @F.pandas_udf("double")
    def run(big: pd.Series, k: pd.Series, n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_tail(*map(int, r), True) for r in zip(big, k, n, h, strict=True)], dtype=float)

    return df.withColumn("tail", run(*(F.col(c).cast("bigint") for c in (population, positives, drawn, hits))))


def confidence_sets(df: DataFrame, population: str, drawn: str, hits: str, alpha: float = 0.05) -> DataFrame:
    """df with least and most: the numbers of positives in the population that the hits among the drawn leave open, each tail at alpha / 2.

    A number k is open if neither so many hits nor so few are rarer than alpha / 2 under it. Both tails are monotone in k, so either end is found by bisection.
    """

    @F.pandas_udf("least long, most long")
    def run(big: pd.Series, n: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for pop, m, x in zip(big.astype(int).tolist(), n.astype(int).tolist(), h.astype(int).tolist(), strict=True):
            low, high = x, pop - m + x
            least = bisected(low, high, lambda k, a=(pop, m, x): hypergeometric_tail(a[0], k, a[1], a[2], True) > alpha / 2)
            most = bisected(low, high + 1, lambda k, a=(pop, m, x): hypergeometric_tail(a[0], k, a[1], a[2], False) <= alpha / 2) - 1
            out.append((least, most))
        return pd.DataFrame(out, columns=["least", "most"])

    return df.withColumn("_open", run(*(F.col(c).cast("bigint") for c in (population, drawn, hits)))).select(*df.columns, "_open.least", "_open.most")


def no_hit(population: int, positives: int, drawn: int) -> Fraction:
    """The exact chance that none of the positives is drawn."""
    if positives > population - drawn:
        return Fraction(0)
    if min(positives, drawn) > MOST_FACTORS:
        raise ValueError(f"an exact chance of more than {MOST_FACTORS} factors")
    few, many = sorted((positives, drawn))
    return Fraction(math.prod(population - many - i for i in range(few)), math.prod(population - i for i in range(few)))


#: Factors of an exact chance.
MOST_FACTORS = 1_000_000


def precision_frontier(df: DataFrame, negatives: str, positives: str, halfwidth: str, budget: str) -> DataFrame:
    """df with allowed, drawn, tail and tail_before: the least sample of the negatives that, without a hit, bounds the precision at a threshold with so many certain positives to within a half-width,
    at half a budget of error, the chance that decides it, and that of a sample with one less, which is over the bound (null if none need be drawn).

    With p positives and at most u hits among the negatives the precision lies within [p / (p + u), 1], so u may be floor(2 e p / (1 - 2 e)); u + 1 hits must be ruled out. halfwidth and budget are text
    (a fraction or decimal), as all is worked out in whole numbers; the sample is found by bisection.
    """

    @F.pandas_udf("allowed long, drawn long, tail double, tail_before double")
    def run(q: pd.Series, p: pd.Series, e: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for big, k, half, error in zip(q.astype(int).tolist(), p.astype(int).tolist(), e, b, strict=True):
            eps, most = Fraction(half), Fraction(error) / 2
            u = min(big, int(2 * eps * k / (1 - 2 * eps)))
            if u >= big:
                out.append((u, 0, 0.0, None))
                continue
            n = bisected(0, big, lambda n, a=(big, u + 1, most): no_hit(a[0], a[1], n) <= a[2])
            out.append((u, n, float(no_hit(big, u + 1, n)), float(no_hit(big, u + 1, n - 1)) if n else None))
        return pd.DataFrame(out, columns=["allowed", "drawn", "tail", "tail_before"])

    made = run(F.col(negatives).cast("bigint"), F.col(positives).cast("bigint"), F.col(halfwidth).cast("string"), F.col(budget).cast("string"))
    return df.withColumn("_f", made).select(*df.columns, "_f.*")


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: term by term up to 64, beyond that by the asymptotic series, which is exact to the last digits there."""
    few = F.aggregate(F.transform(F.sequence(F.lit(1).cast("bigint"), F.least(n, F.lit(64).cast("bigint"))), lambda i: F.lit(1.0) / i), F.lit(0.0), lambda a, x: a + x)
    many = F.log(n) + F.lit(0.5772156649015329) + 1 / (2 * n) - 1 / (12 * F.pow(n, F.lit(2))) + 1 / (120 * F.pow(n, F.lit(4)))
    return F.when(n <= 64, few).otherwise(many)
