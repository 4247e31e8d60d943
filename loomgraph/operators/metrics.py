"""Ranking metrics with exact ties, classification counts, means of means and contrasts.

A block holds the rows of one world with one score; all of a block enters a ranking together. Everything is counted in whole numbers and
divided last, in one grouping by block and one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.running import MOST, running


def whole(x: Column) -> Column:
    """A whole number whose products don't overflow below 38 digits."""
    return x.cast("decimal(38,0)")


def blocks(df: DataFrame, by: list[str], y: str = "y", s: str = "s", weight: Column | None = None, positive: Column | None = None, most: int = MOST) -> DataFrame:
    """by, s, p, m: positives and rows of each score, with tp and n so far and totals. With weights these count instead of rows. A group with very many scores is summed by ranges."""
    m = F.sum(weight) if weight is not None else F.count("*")
    p = F.sum(positive) if positive is not None else F.sum(F.col(y).cast("bigint"))
    own = running(df.groupBy(*by, s).agg(p.alias("p"), m.alias("m")), by, F.desc(s), {"tp": "p", "n": "m"}, most)
    totals = own.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("m").alias("all_m"))
    return own.join(totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), "all_p", "all_m"), [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*(f"_by_{c}" for c in by))


def ranking(df: DataFrame, by: list[str], y: str = "y", s: str = "s", weight: Column | None = None, positive: Column | None = None, most: int = MOST) -> DataFrame:
    """by, positives, negatives, ap, auroc. ap is null without positives, auroc with one class. Counts may have up to 19 digits."""
    b = blocks(df, by, y, s, weight, positive, most)
    part = (whole(F.col("p")) * F.col("tp")).cast("double") / F.col("n")
    below = F.col("all_m") - F.col("all_p") - (F.col("n") - F.col("tp"))
    wins = whole(whole(F.col("p")) * (2 * whole(below) + (F.col("m") - F.col("p"))))
    sums = b.groupBy(*by).agg(F.max("all_p").alias("positives"), (F.max("all_m") - F.max("all_p")).alias("negatives"), F.sum(part).alias("_a"), F.sum(wins).alias("_w"))
    pos, neg = F.col("positives"), F.col("negatives")
    pairs = (2 * whole(pos) * neg).cast("double")
    return sums.select(*by, pos, neg, F.when(pos > 0, F.col("_a") / pos).alias("ap"), F.when((pos > 0) & (neg > 0), F.col("_w").cast("double") / pairs).alias("auroc"))


def exact_ranking(df: DataFrame, by: list[str], y: str = "y", s: str = "s", weight: Column | None = None, positive: Column | None = None, most: int = MOST) -> DataFrame:
    """by, positives, negatives, blocks and the numerators and denominators, as text in lowest terms, of ap and auroc; null where ranking() is. A fraction has as many digits as it needs: only the blocks with positives go into it, and those of a group are added in one task."""
    b = blocks(df, by, y, s, weight, positive, most)
    counts = b.groupBy(*by).agg(F.max("all_p").alias("positives"), (F.max("all_m") - F.max("all_p")).alias("negatives"), F.count("*").alias("blocks"))
    told = b.where("p > 0").select(*by, *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("p", "m", "tp", "n", "all_p", "all_m")))
    names = ("ap_numerator", "ap_denominator", "auroc_numerator", "auroc_denominator")
    kinds = [(c, k) for c, k in df.select(*by).dtypes]

    def run(key, rows: Iterator):
        ap, wins, p_all, m_all = Fraction(0), 0, 0, 0
        for batch in rows:
            for p, m, tp, n, p_all, m_all in zip(*(map(int, batch.column(c).to_pylist()) for c in ("p", "m", "tp", "n", "all_p", "all_m")), strict=True):
                ap += Fraction(p * tp, n)
                wins += p * (2 * (m_all - p_all - (n - tp)) + m - p)
        ap /= p_all
        auroc = Fraction(wins, 2 * p_all * (m_all - p_all)) if m_all > p_all else None
        parts = [str(ap.numerator), str(ap.denominator), *((None, None) if auroc is None else (str(auroc.numerator), str(auroc.denominator)))]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), *(pa.array([x], pa.string()) for x in parts)], [*by, *names])

    made = told.groupBy(*by).applyInArrow(lambda key, table: pa.Table.from_batches(run(key, table.to_batches())), ", ".join([*(f"{c} {k}" for c, k in kinds), *(f"{c} string" for c in names)]))
    return counts.join(made, by, "left")


def family_scores(families: DataFrame, by: list[str]) -> DataFrame:
    """(by, column, s, capacity, positives): each of the families' six quantities in both directions, and a constant, as a score. families: (by, length, capacity, positives, sum_m, max_m, mean_degree, max_degree); a family stands for as many tuples as its capacity."""
    quantities = {"length": "length", "capacity": "capacity", "multiplicity_sum": "sum_m", "multiplicity_max": "max_m", "degree_mean": "mean_degree", "degree_max": "max_degree"}
    as_score = lambda name, x: F.struct(F.lit(name).alias("column"), x.cast("double").alias("s"))
    scores = [as_score(f"{q}_{way}", F.col(c) * sign) for q, c in quantities.items() for way, sign in (("increasing", -1), ("decreasing", 1))]
    return families.select(*by, "capacity", "positives", F.inline(F.array(*scores, as_score("constant", F.lit(0)))))


def bce(logit: Column, y: Column) -> Column:
    """The mean of log(1 + e^z) - y z, without overflow."""
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit))))


def confusion(df: DataFrame, by: list[str], cut: Column, y: str = "y", s: str = "s") -> DataFrame:
    """Counts and rates where rows of s >= cut are called positive; a rate without a base is 0."""
    hit, pos = F.col(s) >= cut, F.col(y) == 1
    c = df.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def best_threshold(df: DataFrame, by: list[str], y: str = "y", s: str = "s") -> DataFrame:
    """by, threshold, f1: of 0, the scores (from 0 to 1) and 1 the least with the highest F1 of s >= threshold; 0.5 if none is above 0. A group with one class has no threshold."""
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("all_p"))
    tried = blocks(df, by, y, s).select(*by, F.col(s).alias("threshold"), f1.alias("f1"), "all_p", "all_m")
    best = tried.groupBy(*by).agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("at"), F.max("f1").alias("f1"), F.max("all_p").alias("p"), F.max("all_m").alias("m"))
    everything = 2 * F.col("p") / (F.col("m") + F.col("p"))  # at 0 all are called positive
    threshold = F.when(F.col("f1") <= 0, 0.5).when(everything >= F.col("f1"), 0.0).otherwise(F.col("at"))
    return best.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("m")), threshold).alias("threshold"), "f1")


def best_cutoff(df: DataFrame, by: list[str], y: str = "y", s: str = "s") -> DataFrame:
    """by, cutoff, accuracy: the best accuracy of calling s <= cutoff positive, at the least such cutoff."""
    b = blocks(df, by, y, s)
    right = (F.col("all_p") - F.col("tp") + F.col("p")) + (F.col("n") - F.col("tp") - F.col("m") + F.col("p"))
    own = b.select(*by, F.col(s).alias("cutoff"), (right / F.col("all_m")).alias("accuracy"))
    return own.groupBy(*by).agg(F.min_by("cutoff", F.struct(-F.col("accuracy"), "cutoff")).alias("cutoff"), F.max("accuracy").alias("accuracy"))


def strict_mean(x: str) -> Column:
    """The mean, null if any value is null."""
    return F.when(F.count(x) == F.count("*"), F.avg(x))


def macro_mean(df: DataFrame, outer: list[str], inner: str, x: str) -> DataFrame:
    """outer and the mean over `inner` groups of their means; a null anywhere makes it null."""
    one = df.groupBy(*outer, inner).agg(strict_mean(x).alias(x))
    return one.groupBy(*outer).agg(strict_mean(x).alias(x), F.count("*").alias("groups"))


def contrasts(df: DataFrame, arm: str, reference: str, by: list[str], x: str) -> DataFrame:
    """by, arm, difference from the reference arm."""
    base = df.where(F.col(arm) == reference).select(*by, F.col(x).alias("_base"))
    return df.where(F.col(arm) != reference).join(base, by).select(*by, arm, (F.col(x) - F.col("_base")).alias("difference"))


def selected(df: DataFrame, by: list[str], split: str, logit: str = "logit", y: str = "y", column: str = "split") -> DataFrame:
    """by, n, positives, bce, ap and auroc of the rows of one split."""
    rows = df.where(F.col(column) == split)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), bce(F.col(logit), F.col(y)).alias("bce"))
    return counts.join(ranking(rows, by, y, logit), by).select(*by, "n", "positives", "bce", "ap", "auroc")


def exact_ap(df: DataFrame, by: list[str], y: str = "y", s: str = "s") -> DataFrame:
    """by, numerator, denominator: average precision of a score of two values as an exact fraction, for instance of a rule that holds or not."""
    b = blocks(df, by, y, s)
    one = b.groupBy(*by).agg(F.max("all_p").alias("pos"), F.max("all_m").alias("all"), F.min_by("tp", "n").alias("tp"), F.min("n").alias("n"), F.count("*").alias("values"))
    good = F.when(F.col("values") <= 2, F.lit(True)).otherwise(F.raise_error(F.lit("the score has more than two values")).cast("boolean"))
    # First block: tp / pos * tp / n; second: (pos - tp) / pos * pos / all.
    big = lambda c: c.cast("decimal(19,0)")
    tp, n, pos, m = map(F.col, ("tp", "n", "pos", "all"))
    return one.where(good & (pos > 0)).select(*by, (big(tp * tp) * big(m) + big((pos - tp) * pos) * big(n)).cast("decimal(38,0)").alias("numerator"), (big(pos * n) * big(m)).cast("decimal(38,0)").alias("denominator"))
