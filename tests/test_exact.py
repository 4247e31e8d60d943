import random
import time
from collections import defaultdict
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.running import running
from loomgraph.operators import graph, metrics, statistics


def test_running_sums_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", None]), x, rng.randrange(9)) for x in rng.sample(range(10_000), 600)]
    df = spark.createDataFrame(rows, "g string, x int, n long").repartition(5)
    want, so_far = set(), defaultdict(int)
    for g, x, n in sorted(rows, key=lambda r: -r[1]):
        so_far[g] += n
        want.add((g, x, n, so_far[g]))
    for most in (1, 1 << 20):
        assert {tuple(r) for r in running(df, ["g"], F.desc("x"), {"up_to": "n"}, most).collect()} == want


def exact(rows):
    """(score, positives, weight) of one population: P, Q, blocks, AP, AUROC."""
    p, m = defaultdict(int), defaultdict(int)
    for s, pos, w in rows:
        p[s] += pos
        m[s] += w
    total, everything, tp, n, ap, wins = sum(p.values()), sum(m.values()), 0, 0, Fraction(0), 0
    for s in sorted(m, reverse=True):
        below = everything - total - (n - tp) - (m[s] - p[s])
        tp, n = tp + p[s], n + m[s]
        ap += Fraction(p[s] * tp, n)
        wins += p[s] * (2 * below + m[s] - p[s])
    q = everything - total
    return total, q, len(m), ap / total if total else None, Fraction(wins, 2 * total * q) if total and q else None


@pytest.mark.parametrize("most", [2, 1 << 20])
def test_rankings_with_large_weights(spark, most):
    """Counts of ten billions, whose products pass 64 bits."""
    rng = random.Random(most)
    rows = [("w", float(rng.randrange(30)), rng.choice([0, 0, 3 * 10**9]), 9 * 10**9 + rng.randrange(10**9)) for _ in range(60)] + [("none", 1.0, 0, 5), ("all", 1.0, 7, 7)]
    df = spark.createDataFrame(rows, "g string, s double, p long, w long")
    weights = {"weight": F.col("w"), "positive": F.col("p")}
    got = {r.g: r for r in metrics.exact_ranking(df, ["g"], most=most, **weights).collect()}
    near = {r.g: r for r in metrics.ranking(df, ["g"], most=most, **weights).collect()}
    for g in ("w", "none", "all"):
        p, q, blocks, ap, auroc = exact([r[1:2] + r[2:] for r in rows if r[0] == g])
        r = got[g]
        assert (int(r.positives), int(r.negatives), r.blocks) == (p, q, blocks)
        assert (r.ap_numerator, r.ap_denominator) == ((None, None) if ap is None else (str(ap.numerator), str(ap.denominator)))
        assert (r.auroc_numerator, r.auroc_denominator) == ((None, None) if auroc is None else (str(auroc.numerator), str(auroc.denominator)))
        assert (near[g].ap, near[g].auroc) == (ap if ap is None else pytest.approx(float(ap)), auroc if auroc is None else pytest.approx(float(auroc)))


def test_families_stand_for_their_tuples(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.randrange(5), rng.randrange(5), rng.random() < 0.6) for i in range(60)]
    events = spark.createDataFrame(rows, "g int, event_id long, src long, dst long, bad boolean")
    found = graph.cycles(graph.arcs(events, ("g",)), range(2, 5), by=("g",))
    families = graph.families(found, events, F.col("bad"), ("g",))
    got = {(r.g, r["column"]): r for r in metrics.exact_ranking(metrics.family_scores(families, ["g"]), ["g", "column"], weight=F.col("capacity"), positive=F.col("positives")).collect()}
    bad = {r[1]: r[4] for r in rows}
    many, near = defaultdict(int), defaultdict(set)
    for _, _, a, b, _ in rows:
        if a != b:
            many[a, b] += 1
            near[a].add(("out", b))
            near[b].add(("in", a))
    scored = defaultdict(list)
    for t in graph.event_tuples(found, events, 10**6, ("g",)).collect():
        ms = [many[a, b] for a, b in zip(t.cycle, t.cycle[1:] + t.cycle[:1], strict=True)]
        degrees = [len(near[a]) for a in t.cycle]
        capacity = 1
        for m in ms:
            capacity *= m
        y = int(all(bad[e] for e in t.events))
        for name, v in (("length", t.length), ("capacity", capacity), ("multiplicity_sum", sum(ms)), ("multiplicity_max", max(ms)), ("degree_mean", sum(degrees) / len(degrees)), ("degree_max", max(degrees))):
            scored[f"{name}_increasing"].append((-v, y, 1))
            scored[f"{name}_decreasing"].append((v, y, 1))
        scored["constant"].append((0, y, 1))
    assert len(scored) == 13 == len(got)
    for name, population in scored.items():
        p, q, blocks, ap, auroc = exact(population)
        r = got[1, name]
        assert (int(r.positives), int(r.negatives), r.blocks, Fraction(int(r.ap_numerator), int(r.ap_denominator)), Fraction(int(r.auroc_numerator), int(r.auroc_denominator))) == (p, q, blocks, ap, auroc)


def test_tails_and_sets_equal_exact_counts():
    for big, k, n in [(40, 7, 12), (30, 30, 5), (25, 0, 4), (60, 31, 60), (100, 50, 49)]:
        mass = [Fraction(comb(k, x) * comb(big - k, n - x), comb(big, n)) for x in range(n + 1)]
        for h in range(n + 1):
            assert statistics.hypergeometric_tail(big, k, n, h, True) == pytest.approx(float(sum(mass[h:])), rel=1e-11, abs=1e-300)
            assert statistics.hypergeometric_tail(big, k, n, h, False) == pytest.approx(float(sum(mass[: h + 1])), rel=1e-11, abs=1e-300)


def test_populations_of_billions(spark):
    df = spark.createDataFrame([(10**9, 10**6, 1000), (10**9, 10**6, 0), (10**9, 5, 5), (40, 12, 3), (40, 12, 0)], "big long, n long, h long")
    began = time.time()
    got = {(r.big, r.n, r.h): (r.least, r.most) for r in statistics.confidence_sets(df, "big", "n", "h").collect()}
    assert time.time() - began < 20

    def open_(big, n, h, k, alpha=0.05):
        return statistics.hypergeometric_tail(big, k, n, h, True) > alpha / 2 and statistics.hypergeometric_tail(big, k, n, h, False) > alpha / 2

    for (big, n, h), (least, most) in got.items():
        assert open_(big, n, h, least) and open_(big, n, h, most)
        assert (least == h or not open_(big, n, h, least - 1)) and (most == big - n + h or not open_(big, n, h, most + 1))
    for n, h in ((12, 3), (12, 0)):
        ks = [k for k in range(h, 40 - n + h + 1) if all(sum(comb(k, x) * comb(40 - k, n - x) for x in xs) / comb(40, n) > 0.025 for xs in (range(h, n + 1), range(h + 1)))]
        assert got[40, n, h] == (ks[0], ks[-1])


def test_precision_frontier(spark):
    df = spark.createDataFrame([(10**11, 100, "1/100", "1/2000"), (10**6, 1, "1/50", "1/20"), (200, 60, "1/50", "1/20"), (2, 100, "1/50", "1/20")], "q long, p long, e string, b string")
    for r in statistics.precision_frontier(df, "q", "p", "e", "b").collect():
        most, eps = Fraction(r.b) / 2, Fraction(r.e)
        assert r.allowed == min(r.q, 2 * eps * r.p // (1 - 2 * eps))
        if r.allowed >= r.q:
            assert (r.drawn, r.tail_before) == (0, None)
            continue
        assert statistics.no_hit(r.q, r.allowed + 1, r.drawn) <= most < statistics.no_hit(r.q, r.allowed + 1, r.drawn - 1)
        assert r.tail <= float(most) < r.tail_before
