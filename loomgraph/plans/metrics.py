"""Queries on scores, panels and statistics. A world is a source of documents, a day, or a month of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import metrics, statistics
from loomgraph.plans.relations import SCORED, TRANSFERS, scored, transfers
from loomgraph.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names, places=9):
    return df.withColumns({c: F.round(c, places) for c in names})


def blocks_sql(by: str, source: str = "z", y: str = "y", s: str = "s") -> str:
    return f"""g AS (SELECT {by}, {s} AS s, sum({y}) AS p, count(*) AS m FROM {source} GROUP BY ALL),
b AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS n, sum(p) OVER (PARTITION BY {by}) AS ap, sum(m) OVER (PARTITION BY {by}) AS am FROM g WINDOW w AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


RANK = """CAST(max(ap) AS BIGINT) AS positives, CAST(max(am) - max(ap) AS BIGINT) AS negatives, round(CASE WHEN max(ap) > 0 THEN sum(CAST(p * tp AS DOUBLE) / n) / max(ap) END, 9) AS ap,
 round(CASE WHEN max(ap) > 0 AND max(am) > max(ap) THEN CAST(sum(p * (2 * (am - ap - (n - tp)) + m - p)) AS DOUBLE) / (2 * max(ap) * (max(am) - max(ap))) END, 9) AS auroc"""


@query(f"WITH {SCORED}, {blocks_sql('world')} SELECT world, {RANK} FROM b GROUP BY world")
def world_ranking(spark, sf_dir):
    """Average precision with grouped ties and AUROC with half credit, in each world."""
    return rounded(metrics.ranking(scored(spark, sf_dir), ["world"]), "ap", "auroc")


@query(f"WITH {SCORED}, l AS (SELECT world, y, (s - 3000) / 1000 AS v FROM z) SELECT world, round(avg(greatest(v, 0) - v * y + ln(1 + exp(-abs(v)))), 8) AS bce FROM l GROUP BY world")
def world_bce(spark, sf_dir):
    """The mean logistic loss of a linear score in each world."""
    z = scored(spark, sf_dir).withColumn("v", (F.col("s") - 3000) / 1000)
    return rounded(z.groupBy("world").agg(metrics.bce(F.col("v"), F.col("y")).alias("bce")), "bce", places=8)


@query(f"""WITH {SCORED}, c AS (SELECT world, count_if(s >= 3000 AND y = 1) AS tp, count_if(s >= 3000 AND y = 0) AS fp, count_if(s < 3000 AND y = 0) AS tn, count_if(s < 3000 AND y = 1) AS fn FROM z GROUP BY world)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy FROM c""")
def confusion_counts(spark, sf_dir):
    """Confusion counts and rates at a frozen threshold."""
    return rounded(metrics.confusion(scored(spark, sf_dir), ["world"], F.lit(3000.0)), "precision", "recall", "f1", "accuracy")


@query(f"""WITH {SCORED}, q AS (SELECT world, y, s / (s + 5000) AS s FROM z), c AS (SELECT DISTINCT world, unnest([0.0, 1.0]) AS t FROM q UNION SELECT world, s FROM q),
f AS (SELECT c.world, c.t, count_if(q.s >= c.t AND q.y = 1) AS tp, count_if(q.s >= c.t) AS called, count_if(q.y = 1) AS p, count(*) AS m FROM c JOIN q USING (world) GROUP BY ALL),
g AS (SELECT *, CASE WHEN called + p > 0 THEN 2.0 * tp / (called + p) ELSE 0 END AS f1, row_number() OVER (PARTITION BY world ORDER BY 2.0 * tp / (called + p) DESC, t) AS k FROM f)
SELECT world, CAST(CASE WHEN p = 0 OR p = m THEN NULL WHEN f1 = 0 THEN 0.5 ELSE t END AS DOUBLE) AS threshold, CAST(round(f1, 9) AS DOUBLE) AS f1 FROM g WHERE k = 1""")
def f1_threshold(spark, sf_dir):
    """The first threshold with the best F1 in each world, of 0, the scores and 1."""
    z = scored(spark, sf_dir).withColumn("s", F.col("s") / (F.col("s") + 5000))
    return rounded(metrics.best_threshold(z, ["world"]), "f1")


@query(f"WITH {SCORED}, {blocks_sql('world')}, f AS (SELECT world, s, ((ap - tp + p) + (n - tp - m + p)) / am AS a FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY a DESC, s) AS k FROM f) SELECT world, s AS cutoff, round(a, 9) AS accuracy FROM r WHERE k = 1")
def univariate_cutoff(spark, sf_dir):
    """The best accuracy of a rule score <= cutoff in each world."""
    return rounded(metrics.best_cutoff(scored(spark, sf_dir), ["world"]), "accuracy")


@query(f"WITH {SCORED} SELECT world, round(CASE WHEN sum(y) > 0 THEN (count(*) - sum(y)) / sum(y) END, 9) AS weight FROM z GROUP BY world")
def class_weight(spark, sf_dir):
    """Negatives for each positive."""
    z = scored(spark, sf_dir).groupBy("world").agg(F.count_if(F.col("y") == 0).alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    return rounded(z.select("world", F.when(F.col("p") > 0, F.col("n") / F.col("p")).alias("weight")), "weight")


PANEL = """a AS (SELECT world, 'length' AS arm, s AS v, y FROM z UNION ALL SELECT world, 'quality', CAST(quality AS DOUBLE), y FROM z UNION ALL SELECT world, 'parity', CAST(candidate % 7 AS DOUBLE), y FROM z UNION ALL SELECT world, 'constant', 0.0, y FROM z)"""


def panel(spark, sf_dir):
    z = scored(spark, sf_dir)
    arms = F.array(*(F.struct(F.lit(n).alias("arm"), c.cast("double").alias("v")) for n, c in (("length", F.col("s")), ("quality", F.col("quality")), ("parity", F.col("candidate") % 7), ("constant", F.lit(0)))))
    return z.select("world", "y", F.inline(arms))


@query(f"WITH {SCORED}, {PANEL}, {blocks_sql('world, arm', 'a', 'y', 'v')} SELECT world, arm, {RANK} FROM b GROUP BY world, arm")
def shortcut_rankings(spark, sf_dir):
    """Four fixed scores ranked in each world, in one pass over an unpivoted table."""
    return rounded(metrics.ranking(panel(spark, sf_dir), ["world", "arm"], s="v"), "ap", "auroc")


@query(f"""WITH {SCORED}, {PANEL}, {blocks_sql('world, arm', 'a', 'y', 'v')}, r AS (SELECT world, arm, {RANK} FROM b GROUP BY world, arm)
SELECT arm, CASE WHEN count(ap) = count(*) THEN round(avg(ap), 7) END AS ap, count(*) AS groups FROM r GROUP BY arm""")
def macro_means(spark, sf_dir):
    """The equal-world mean of AP for each arm; a world without positives makes it null."""
    r = rounded(metrics.ranking(panel(spark, sf_dir), ["world", "arm"], s="v"), "ap", "auroc")
    return rounded(metrics.macro_mean(r, ["arm"], "world", "ap"), "ap", places=7)


@query(f"""WITH {SCORED}, {PANEL}, {blocks_sql('world, arm', 'a', 'y', 'v')}, r AS (SELECT world, arm, {RANK} FROM b GROUP BY world, arm)
SELECT r.world, r.arm, round(r.ap - c.ap, 7) AS difference FROM r JOIN r c ON r.world = c.world AND c.arm = 'constant' WHERE r.arm <> 'constant'""")
def paired_contrasts(spark, sf_dir):
    """AP of each arm less that of the constant score, by world."""
    r = rounded(metrics.ranking(panel(spark, sf_dir), ["world", "arm"], s="v"), "ap", "auroc")
    return rounded(metrics.contrasts(r, "arm", "constant", ["world"], "ap"), "difference", places=7)


@query(f"""WITH {TRANSFERS}, f AS (SELECT kind, src % 10 AS v, count(*) AS w, count_if(amount > 100) AS pos FROM t GROUP BY ALL), g AS (SELECT kind AS world, v AS s, sum(pos) AS p, sum(w) AS m FROM f GROUP BY ALL),
b AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS n, sum(p) OVER (PARTITION BY world) AS ap, sum(m) OVER (PARTITION BY world) AS am FROM g WINDOW w AS (PARTITION BY world ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT world, {RANK} FROM b GROUP BY world""")
def weighted_ranking(spark, sf_dir):
    """Ranking of families of rows by whole-number weights instead of row counts."""
    f = transfers(spark, sf_dir).groupBy(F.col("kind").alias("world"), (F.col("src") % 10).alias("s")).agg(F.count("*").alias("w"), F.count_if(F.col("amount") > 100).alias("pos"))
    return rounded(metrics.ranking(f, ["world"], weight=F.col("w"), positive=F.col("pos")), "ap", "auroc")


@query(f"WITH {TRANSFERS}, r AS (SELECT kind, amount, row_number() OVER (PARTITION BY kind ORDER BY amount) AS k, count(*) OVER (PARTITION BY kind) AS n FROM t) SELECT kind, CAST(q AS DOUBLE) AS q, min(amount) AS value FROM r, (SELECT unnest([0.25, 0.5, 0.9]) AS q) WHERE k >= ceil(q * n) GROUP BY ALL")
def nearest_rank(spark, sf_dir):
    """Quantiles as the value at the rank ceil(q n)."""
    t = transfers(spark, sf_dir).groupBy("kind").agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY amount)").alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.9))))
    return t.select("kind", F.inline(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("value")) for i, q in enumerate((0.25, 0.5, 0.9))))))


@query("SELECT lang, least(n_chars // 1000, 5) AS bucket, toxic AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def stratum_support(spark, sf_dir):
    """Candidates in each stratum by label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.groupBy("lang", F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).alias("bucket"), F.col("toxic").alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT CAST(candidate % 5 AS BIGINT) AS fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(y) / count(*), 9) AS ratio, count(DISTINCT world) AS worlds FROM z GROUP BY 1")
def fold_audit(spark, sf_dir):
    """Counts, positives and distinct worlds of each fold."""
    z = scored(spark, sf_dir).groupBy((F.col("candidate") % 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.count_distinct("world").alias("worlds"))
    return rounded(z.withColumn("ratio", F.col("positives") / F.col("n")), "ratio")


@query(f"WITH {TRANSFERS} SELECT src, dst, kind, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT amount > 50) > 1")
def signature_conflicts(spark, sf_dir):
    """Signatures whose rows disagree on a label."""
    label = F.col("amount") > 50
    t = transfers(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.min(label).alias("a"), F.max(label).alias("b"))
    return t.where(F.col("a") != F.col("b")).drop("a", "b")


DAILY = f"WITH {TRANSFERS}, d AS (SELECT hours // 24 AS day, kind, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT x.kind, x.day, CAST(x.n - y.n AS DOUBLE) AS d FROM d x JOIN d y ON x.day = y.day AND y.kind = 'view' WHERE x.kind <> 'view')"


def daily(spark, sf_dir):
    d = transfers(spark, sf_dir).groupBy(F.floor(F.col("hours") / 24).alias("day"), "kind").agg(F.count("*").cast("double").alias("n"))
    return metrics.contrasts(d, "kind", "view", ["day"], "n").withColumnRenamed("difference", "d")


SIGNED = DAILY.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT kind, round(d, 12) AS d FROM e), n0 AS (SELECT kind, count_if(d = 0) AS n_zero FROM o GROUP BY kind),
x AS (SELECT kind, d, CAST(2 * rank() OVER (PARTITION BY kind ORDER BY abs(d)) + count(*) OVER (PARTITION BY kind, abs(d)) - 1 AS BIGINT) AS r, row_number() OVER (PARTITION BY kind ORDER BY abs(d), d) AS i FROM o WHERE d <> 0),
g AS (SELECT kind, count(*) AS n, sum(r) AS total, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS plus FROM x GROUP BY kind),
w AS (SELECT kind, CAST(0 AS BIGINT) AS i, [CAST(1 AS BIGINT)] AS ways FROM g UNION ALL
 SELECT w.kind, w.i + 1, list_transform(generate_series(0, len(ways) - 1 + x.r), lambda j: (CASE WHEN j < len(ways) THEN ways[j + 1] ELSE 0 END) + (CASE WHEN j >= x.r THEN ways[j - x.r + 1] ELSE 0 END)) FROM w JOIN x ON x.kind = w.kind AND x.i = w.i + 1),
f AS (SELECT g.*, list_sum(ways[1:CAST(least(plus, total - plus) AS BIGINT) + 1]) AS tail FROM g JOIN w ON w.kind = g.kind AND w.i = g.n)
SELECT kind, n_zero, coalesce(n, 0) AS n, CAST(coalesce(plus, 0) AS BIGINT) AS w_plus, round(least(1.0, coalesce(2 * tail / pow(2.0, n), 1.0)), 9) AS p FROM n0 LEFT JOIN f USING (kind)"""


@query(SIGNED)
def exact_signed_rank(spark, sf_dir):
    """The exact signed-rank test of daily counts against those of views."""
    return rounded(statistics.signed_rank(daily(spark, sf_dir), ["kind"], "d"), "p")


@query(DAILY + """, q AS (SELECT kind, round(least(1.0, abs(avg(d)) / 10 + 0.01), 6) AS p FROM e GROUP BY kind), r AS (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, kind) + 1 AS m, row_number() OVER (ORDER BY p, kind) AS k FROM q)
SELECT kind, p, round(max(least(1.0, m * p)) OVER w, 6) AS adjusted, bool_and(p <= 0.05 / m) OVER w AS rejected FROM r WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def holm_adjusted(spark, sf_dir):
    """Step-down adjustment of one p-value for each kind."""
    q = daily(spark, sf_dir).groupBy("kind").agg(F.round(F.least(F.lit(1.0), F.abs(F.avg("d")) / 10 + 0.01), 6).alias("p")).withColumn("family", F.lit(1))
    return rounded(statistics.holm(q, ["family"], "kind", "p").drop("family"), "adjusted", places=6)


@query(f"""WITH {SCORED}, a AS (SELECT world, count_if(y = 1) AS na, avg(CASE WHEN y = 1 THEN s END) AS ma, var_samp(CASE WHEN y = 1 THEN s END) AS va, count_if(y = 0) AS nb, avg(CASE WHEN y = 0 THEN s END) AS mb, var_samp(CASE WHEN y = 0 THEN s END) AS vb FROM z GROUP BY world)
SELECT world, round(CASE WHEN na < 2 OR nb < 2 THEN 0.0 ELSE (ma - mb) / sqrt(greatest(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2), 1e-12)) END, 4) AS d FROM a""")
def standardized_difference(spark, sf_dir):
    """Cohen's d of the lengths of toxic and other documents."""
    return rounded(statistics.cohens_d(scored(spark, sf_dir), ["world"], "s", F.col("y") == 1), "d", places=4)


@query(f"""WITH {SCORED}, m AS (SELECT world, avg(s) AS x FROM z GROUP BY world), u AS (SELECT *, row_number() OVER (ORDER BY world) - 1 AS spot FROM m), n AS (SELECT count(*) AS n FROM m),
k AS (SELECT d.range AS draw, s.range AS slot FROM range(20000) d, range((SELECT count(*) FROM m)) s), p AS (SELECT draw, CAST(('0x' || substr(md5('means:' || draw || ':' || slot), 1, 12)) AS BIGINT) % (SELECT n FROM n) AS spot FROM k),
b AS (SELECT draw, avg(x) AS mean FROM p JOIN u USING (spot) GROUP BY draw) SELECT 'length' AS arm, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper FROM b""")
def bootstrap_interval(spark, sf_dir):
    """A percentile interval of the equal-world mean length, over 20,000 resamples of the worlds."""
    m = scored(spark, sf_dir).groupBy("world").agg(F.avg("s").alias("x")).withColumn("arm", F.lit("length"))
    return rounded(statistics.bootstrap(m, "world", ["arm"], "x", 20_000, "means"), "lower", "upper", places=6)


@query(f"WITH {SCORED}, c AS (SELECT world, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM z GROUP BY world) SELECT world, round(p / n, 9) AS prevalence, round((CASE WHEN n > 1 THEN (p - 1) / (n - 1) * (n - list_sum(list_transform(generate_series(1, n), lambda i: 1.0 / i))) ELSE 0 END + list_sum(list_transform(generate_series(1, n), lambda i: 1.0 / i))) / n, 9) AS random_ap FROM c WHERE p > 0")
def chance_references(spark, sf_dir):
    """Prevalence, and the expected average precision of a random order without ties, in closed form."""
    c = scored(spark, sf_dir).groupBy("world").agg(F.count("*").alias("n"), F.sum("y").alias("p")).where("p > 0")
    c = c.withColumn("h", statistics.harmonic(F.col("n")))
    rest = F.when(F.col("n") > 1, (F.col("p") - 1) / (F.col("n") - 1) * (F.col("n") - F.col("h"))).otherwise(0.0)
    return rounded(c.select("world", (F.col("p") / F.col("n")).alias("prevalence"), ((rest + F.col("h")) / F.col("n")).alias("random_ap")), "prevalence", "random_ap")


HISTORY = f"WITH {TRANSFERS}, h AS (SELECT kind, hours // 24 - min(hours // 24) OVER () AS day, amount FROM t), c AS (SELECT kind, day, count(*) AS n FROM h GROUP BY ALL)"


def history(spark, sf_dir):
    t = transfers(spark, sf_dir).withColumn("d", F.floor(F.col("hours") / 24))
    first = t.agg(F.min("d").alias("first"))
    return t.join(F.broadcast(first)).groupBy("kind", (F.col("d") - F.col("first")).alias("day")).agg(F.count("*").alias("n"))


@query(HISTORY + " SELECT kind, day, n, count(*) OVER w = 5 AND max(n) OVER w - min(n) OVER w <= 0.5 * min(n) OVER w AS stable FROM c WINDOW w AS (PARTITION BY kind ORDER BY day RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)")
def stability_windows(spark, sf_dir):
    """Days whose last five days are complete and vary by at most half their least count."""
    return statistics.stable_windows(history(spark, sf_dir), ["kind"], "day", "n", 5, 0.5)


@query(HISTORY + ", g AS (SELECT *, n >= 60 AS good, row_number() OVER (PARTITION BY kind ORDER BY day) - sum(CASE WHEN n >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY day) AS isle FROM c) SELECT kind, day, n, CASE WHEN good THEN row_number() OVER (PARTITION BY kind, isle, good ORDER BY day) ELSE 0 END AS run FROM g")
def endpoint_runs(spark, sf_dir):
    """How many days in a row each kind has reached 60 events."""
    return statistics.runs(history(spark, sf_dir), ["kind"], "day", F.col("n") >= 60)


@query(HISTORY + ", r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n, day) AS k FROM c) SELECT kind, day, n FROM r WHERE k = 1")
def first_minimum(spark, sf_dir):
    """The earliest day with the fewest events of each kind."""
    return history(spark, sf_dir).groupBy("kind").agg(F.min(F.struct("n", "day")).alias("x")).select("kind", "x.day", "x.n")


@query(f"WITH {SCORED}, r AS (SELECT world, y, candidate, row_number() OVER (PARTITION BY world, y ORDER BY candidate) AS k FROM z) SELECT world, y, candidate, k FROM r WHERE k <= 2")
def first_two(spark, sf_dir):
    """The first two candidates of each world and label."""
    z = scored(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("world", "y").orderBy("candidate")))
    return z.where("k <= 2").select("world", "y", "candidate", F.col("k").cast("bigint").alias("k"))


@query(f"WITH {SCORED} SELECT world, candidate, 2 * rank() OVER (PARTITION BY world ORDER BY s) + count(*) OVER (PARTITION BY world, s) - 1 AS doubled_rank FROM z")
def midrank_table(spark, sf_dir):
    """Twice the midrank of each score in its world."""
    return statistics.midranks(scored(spark, sf_dir), ["world"], "s").select("world", "candidate", F.col("doubled_rank").cast("bigint").alias("doubled_rank"))


@query(f"WITH {SCORED}, {blocks_sql('world')}, r AS (SELECT world, max(ap) / max(am) AS share FROM b GROUP BY world), h AS (SELECT world, round(greatest(share, 0.01), 6) AS h FROM r) SELECT world, CAST(h AS DOUBLE) AS h, CAST(ceil(2 * ln(2 / 0.05) / pow(h, 2)) AS BIGINT) AS n FROM h")
def design_size(spark, sf_dir):
    """Worlds needed for a mean on [-1, 1] to lie within each world's share of positives, a hundredth at least, at level 0.05."""
    z = scored(spark, sf_dir).groupBy("world").agg(F.round(F.greatest(F.sum("y") / F.count("*"), F.lit(0.01)), 6).alias("h"))
    return z.select("world", "h", F.ceil(2 * F.log(F.lit(2 / 0.05)) / F.pow("h", F.lit(2))).alias("n"))


@query(f"WITH {SCORED}, g AS (SELECT CAST(candidate % 4 AS BIGINT) AS setting, CAST(candidate % 3 AS BIGINT) AS seed, avg(s) AS v FROM z GROUP BY ALL), m AS (SELECT setting, avg(v) AS v, count(*) AS n FROM g GROUP BY setting HAVING count(*) = 3) SELECT setting, round(v, 6) AS v FROM m ORDER BY m.v, setting LIMIT 1")
def grid_choice(spark, sf_dir):
    """The setting with the least mean over a complete set of seeds."""
    g = scored(spark, sf_dir).groupBy((F.col("candidate") % 4).alias("setting"), (F.col("candidate") % 3).alias("seed")).agg(F.avg("s").alias("v"))
    return g.groupBy("setting").agg(F.avg("v").alias("v"), F.count("*").alias("n")).where("n = 3").orderBy("v", "setting").limit(1).select("setting", F.round("v", 6).alias("v"))


PAIRS = f"WITH {TRANSFERS}, c AS (SELECT hours // 24 AS day, kind, src % 20 AS cluster, sum(amount) AS v FROM t WHERE kind IN ('click', 'view') GROUP BY ALL), q AS (SELECT x.day, x.cluster, x.v AS a, y.v AS b FROM c x JOIN c y USING (day, cluster) WHERE x.kind = 'click' AND y.kind = 'view')"
DRAWS = """, m AS (SELECT 'all' AS arm, cluster, sum(a - b) AS d, count(*) AS c FROM q GROUP BY cluster), u AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS spot FROM m),
k AS (SELECT d.range AS draw, s.range AS slot FROM range(2000) d, range((SELECT count(*) FROM m)) s), p AS (SELECT draw, CAST(('0x' || substr(md5('pairs:' || draw || ':' || slot), 1, 12)) AS BIGINT) % (SELECT count(*) FROM m) AS spot FROM k),
b AS (SELECT arm, draw, sum(d) / sum(c) AS mean FROM p JOIN u USING (spot) GROUP BY ALL)"""


def day_pairs(spark, sf_dir):
    c = transfers(spark, sf_dir).where("kind IN ('click', 'view')").groupBy(F.floor(F.col("hours") / 24).alias("day"), (F.col("src") % 20).alias("cluster")).pivot("kind", ["click", "view"]).agg(F.sum("amount"))
    return c.where("click IS NOT NULL AND view IS NOT NULL").withColumn("arm", F.lit("all"))


@query(PAIRS + DRAWS + " SELECT arm, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, round(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p, round(stddev_samp(mean), 6) AS sd FROM b GROUP BY arm")
def cluster_bootstrap(spark, sf_dir):
    """The daily difference of clicks and views over resampled clusters of users."""
    return rounded(statistics.cluster_difference(day_pairs(spark, sf_dir), "cluster", ["arm"], "click", "view", 2_000, "pairs"), "lower", "upper", "p", "sd", places=6)


@query(PAIRS + DRAWS + ", e AS (SELECT arm, avg(CASE WHEN mean <= -40 THEN 1.0 ELSE 0.0 END) AS l, avg(CASE WHEN mean >= 40 THEN 1.0 ELSE 0.0 END) AS h, quantile_cont(mean, 0.05) > -40 AND quantile_cont(mean, 0.95) < 40 AS equivalent FROM b GROUP BY arm) SELECT arm, round(l, 6) AS p_lower, round(h, 6) AS p_upper, equivalent FROM e")
def equivalence_test(spark, sf_dir):
    """Whether the same difference lies within 40 either way."""
    return rounded(statistics.equivalence(day_pairs(spark, sf_dir), "cluster", ["arm"], "click", "view", 40.0, 2_000, "pairs"), "p_lower", "p_upper", places=6)


@query(f"""WITH {SCORED}, c AS (SELECT world, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, least(count(*), 5) AS d FROM z GROUP BY world)
SELECT world, round(1 - CASE WHEN n - k >= d THEN exp(list_sum(list_transform(generate_series(1, d), lambda i: ln((n - k - d + i) / (n - d + i)))))ELSE 0 END, 9) AS tail FROM c WHERE k > 0""")
def hypergeometric_tail(spark, sf_dir):
    """The chance that five drawn documents hold a toxic one."""
    c = scored(spark, sf_dir).groupBy("world").agg(F.count("*").alias("n"), F.sum("y").alias("k")).where("k > 0").withColumns({"d": F.least("n", F.lit(5)), "h": F.lit(1).cast("bigint")})
    return rounded(statistics.hypergeometric(c, "n", "k", "d", "h").select("world", "tail"), "tail")


@query(f"WITH {TRANSFERS}, o AS (SELECT kind, hours // 24 AS day, sum(amount) AS s, max(amount) AS m FROM t GROUP BY ALL) SELECT kind, round(sum(s), 4) AS total, round(avg(s), 6) AS mean_day, round(sum(m), 4) AS sum_of_largest FROM o GROUP BY kind")
def cost_rollup(spark, sf_dir):
    """Two levels: totals and largest amounts of days, then their sums and means by kind."""
    o = transfers(spark, sf_dir).groupBy("kind", F.floor(F.col("hours") / 24).alias("day")).agg(F.sum("amount").alias("s"), F.max("amount").alias("m"))
    return o.groupBy("kind").agg(F.round(F.sum("s"), 4).alias("total"), F.round(F.avg("s"), 6).alias("mean_day"), F.round(F.sum("m"), 4).alias("sum_of_largest"))


@query(f"WITH {SCORED}, a AS (SELECT DISTINCT lang FROM documents), w AS (SELECT DISTINCT world FROM z), g AS (SELECT d.lang, d.source AS world, count(*) AS n FROM documents d JOIN labels USING (doc_id) GROUP BY ALL) SELECT a.lang, w.world, coalesce(CAST(g.n AS VARCHAR), 'NOT_RUN') AS n FROM a, w LEFT JOIN g USING (lang, world)".replace("FROM a, w LEFT JOIN g USING (lang, world)", "FROM a CROSS JOIN w LEFT JOIN g ON g.lang = a.lang AND g.world = w.world"))
def endpoint_grid(spark, sf_dir):
    """Every cell of languages by worlds, with NOT_RUN where there is nothing."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("source").alias("world"))
    # A grid by an equi-join on a constant that spreads: every world goes to each of 16 parts, every language to one.
    worlds = d.select("world").distinct().select("world", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_part"))
    langs = table(spark, sf_dir, "documents").select("lang").distinct().withColumn("_part", F.pmod(F.xxhash64("lang"), F.lit(16)).cast("int"))
    grid = worlds.join(langs, "_part").drop("_part")
    n = d.groupBy("lang", "world").agg(F.count("*").alias("n"))
    n = n.select(F.col("lang").alias("l"), F.col("world").alias("w"), "n")
    return grid.join(n, F.col("lang").eqNullSafe(F.col("l")) & F.col("world").eqNullSafe(F.col("w")), "left").select("lang", "world", F.coalesce(F.col("n").cast("string"), F.lit("NOT_RUN")).alias("n"))


@query(HISTORY + " SELECT x.kind, x.day, x.n - y.n AS change, abs(x.n - y.n) > 0.2 * y.n AS late FROM c x JOIN c y ON x.kind = y.kind AND y.day = x.day - 7")
def late_changes(spark, sf_dir):
    """How each day differs from the same day a week before, and whether by more than a fifth."""
    h = history(spark, sf_dir)
    before = h.select("kind", (F.col("day") + 7).alias("day"), F.col("n").alias("was"))
    return h.join(before, ["kind", "day"]).select("kind", "day", (F.col("n") - F.col("was")).alias("change"), (F.abs(F.col("n") - F.col("was")) > 0.2 * F.col("was")).alias("late"))


@query(f"""WITH {SCORED}, l AS (SELECT world, candidate % 3 = 0 AS held, y, (s - 3000) / 1000 AS s FROM z), h AS (SELECT * FROM l WHERE held), {blocks_sql('world', 'h')}, r AS (SELECT world, {RANK} FROM b GROUP BY world)
SELECT world, n, r.positives, bce, r.ap, r.auroc FROM (SELECT world, count(*) AS n, round(avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))), 8) AS bce FROM h GROUP BY world) JOIN r USING (world)""")
def selected_metrics(spark, sf_dir):
    """Counts, cross-entropy, AP and AUROC of the validation rows of each world."""
    z = scored(spark, sf_dir).select("world", "y", ((F.col("s") - 3000) / 1000).alias("logit"), F.when(F.col("candidate") % 3 == 0, "validation").otherwise("train").alias("split"))
    return rounded(rounded(metrics.selected(z, ["world"], "validation"), "bce", places=8), "ap", "auroc")


@query(f"""WITH {SCORED}, q AS (SELECT world, y, s >= 3000 AS v FROM z), g AS (SELECT world, count(*) AS m, sum(y) AS pos, count_if(v) AS n, sum(CASE WHEN v THEN y ELSE 0 END) AS tp FROM q GROUP BY world)
SELECT world, CAST(CASE WHEN n = 0 OR n = m THEN pos * pos * m ELSE tp * tp * m + (pos - tp) * pos * n END AS VARCHAR) AS numerator, CAST(CASE WHEN n = 0 OR n = m THEN pos * m * m ELSE pos * n * m END AS VARCHAR) AS denominator FROM g WHERE pos > 0""")
def exact_rule_ap(spark, sf_dir):
    """AP of a rule on the length as an exact fraction."""
    z = scored(spark, sf_dir).withColumn("s", (F.col("s") >= 3000).cast("double"))
    return metrics.exact_ap(z, ["world"]).select("world", F.col("numerator").cast("string").alias("numerator"), F.col("denominator").cast("string").alias("denominator"))


@query(f"""WITH RECURSIVE {SCORED}, w AS (SELECT world, CAST(count(*) AS BIGINT) AS big, CAST(count(*) // 5 AS BIGINT) AS n, CAST(sum(y) AS BIGINT) // 5 AS h FROM z GROUP BY world HAVING count(*) >= 5), f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS v UNION ALL SELECT i + 1, v + ln(i + 1) FROM f WHERE i < (SELECT max(big) FROM w)),
k AS (SELECT w.*, unnest(generate_series(h, big - n + h)) AS k FROM w), x AS (SELECT k.*, unnest(generate_series(0, n)) AS j FROM k),
p AS (SELECT x.world, x.k, x.h, x.j, CASE WHEN j > k OR n - j > big - k THEN 0 ELSE exp(a.v - b.v - c.v + d.v - e.v - g.v - q.v + r.v + t.v) END AS pr FROM x LEFT JOIN f a ON a.i = k LEFT JOIN f b ON b.i = j LEFT JOIN f c ON c.i = k - j LEFT JOIN f d ON d.i = big - k LEFT JOIN f e ON e.i = n - j LEFT JOIN f g ON g.i = big - k - n + j LEFT JOIN f q ON q.i = big LEFT JOIN f r ON r.i = n LEFT JOIN f t ON t.i = big - n),
o AS (SELECT world, k, sum(CASE WHEN j >= h THEN pr ELSE 0 END) AS up, sum(CASE WHEN j <= h THEN pr ELSE 0 END) AS lo FROM p GROUP BY ALL) SELECT world, min(k) AS least, max(k) AS most FROM o WHERE up > 0.025 AND lo > 0.025 GROUP BY world""")
def confidence_sets(spark, sf_dir):
    """How many of a world's documents may be toxic if a fifth of them are drawn and a fifth of the toxic ones are among these."""
    c = scored(spark, sf_dir).groupBy("world").agg(F.count("*").alias("big"), F.sum("y").alias("p")).where("big >= 5")
    c = c.select("world", "big", F.floor(F.col("big") / 5).alias("n"), F.floor(F.col("p") / 5).alias("h"))
    return statistics.confidence_sets(c, "big", "n", "h").select("world", "least", "most")


@query(f"""WITH {SCORED}, c AS (SELECT world, CAST(count(*) - sum(y) AS BIGINT) AS q, CAST(sum(y) AS BIGINT) AS p FROM z GROUP BY world),
g AS (SELECT world, q, p, CAST(e.n AS VARCHAR) || '/' || e.d AS halfwidth, '1/' || b AS budget, least(q, 2 * e.n * p // (e.d - 2 * e.n)) AS u, 1.0::DOUBLE / b / 2 AS most FROM c, (SELECT unnest([1, 1]) AS n, unnest([100, 50]) AS d) e, (SELECT unnest([20, 100, 2000]) AS b)),
n AS (SELECT g.*, unnest(generate_series(0, q)) AS n FROM g), t AS (SELECT *, CASE WHEN u >= q OR u + 1 > q - n THEN 0 ELSE list_product(list_transform(generate_series(0, u), lambda i: (q - n - i)::DOUBLE / (q - i))) END AS tail FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY world, halfwidth, budget ORDER BY n) AS k, lag(tail) OVER (PARTITION BY world, halfwidth, budget ORDER BY n) AS before FROM t), w AS (SELECT *, row_number() OVER (PARTITION BY world, halfwidth, budget ORDER BY n) AS j FROM o WHERE tail <= most * (1 + 1e-12))
SELECT world, halfwidth, budget, q AS negatives, p AS positives, CAST(u AS BIGINT) AS allowed, n AS drawn, round(tail, 9) AS tail, round(before, 9) AS tail_before FROM w WHERE j = 1""")
def precision_frontier(spark, sf_dir):
    """The least sample of a world's clean documents that, without a hit, settles the precision of a rule that finds all toxic ones."""
    c = scored(spark, sf_dir).groupBy("world").agg(F.count_if(F.col("y") == 0).alias("negatives"), F.sum("y").alias("positives"))
    cells = F.array(*(F.struct(F.lit(e).alias("halfwidth"), F.lit(b).alias("budget")) for e in ("1/100", "1/50") for b in ("1/20", "1/100", "1/2000")))
    return rounded(statistics.precision_frontier(c.select("*", F.inline(cells)), "negatives", "positives", "halfwidth", "budget"), "tail", "tail_before")
