"""Queries on joins that check themselves, splits, labels and flows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import features, graph, joins, splits
from loomgraph.plans.graphs import CYCLES, TUPLES, census, tuples
from loomgraph.plans.relations import SCORED, TRANSFERS, scored, transfers
from loomgraph.session import dealt, staged, table
from loomgraph.sources.readers import strict_json

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH k AS (SELECT doc_id, sum(l) AS l, sum(r) AS r FROM (SELECT doc_id, 1 AS l, 0 AS r FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels) GROUP BY doc_id)
SELECT unnest(['repeated left', 'repeated right', 'left alone', 'right alone']) AS fault, unnest([count_if(l > 1), count_if(r > 1), count_if(r = 0), count_if(l = 0)]) AS n FROM k""")
def join_faults(spark, sf_dir):
    """What stands against a strict join of documents and labels."""
    return joins.join_faults(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT o_orderkey, field FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM CASE WHEN o_totalprice > 200000 THEN 'O' ELSE o_orderstatus END THEN 'o_orderstatus' END, CASE WHEN o_orderpriority IS DISTINCT FROM upper(o_orderpriority) THEN 'o_orderpriority' END], lambda x: x IS NOT NULL)) AS field FROM orders)")
def reconciled_fields(spark, sf_dir):
    """Fields in which orders differ from a second version of them."""
    o = table(spark, sf_dir, "orders")
    other = o.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "O").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.upper("o_orderpriority"))
    return joins.reconcile(o, other, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {TRANSFERS}, s AS (SELECT src, dst, min(event_id) AS pattern FROM t WHERE amount > 150 GROUP BY ALL) SELECT event_id, pattern FROM t LEFT JOIN s USING (src, dst)")
def signature_lookup(spark, sf_dir):
    """Every event with the pattern of its signature, if it has one."""
    t = transfers(spark, sf_dir)
    s = t.where("amount > 150").groupBy("src", "dst").agg(F.min("event_id").alias("pattern"))
    return joins.signature_join(t, s, ["src", "dst"], "pattern").select("event_id", "pattern")


@query("""WITH d AS (SELECT doc_id, lang, least(n_chars // 1000, 5) AS bucket, toxic = 1 AS c FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket, c ORDER BY md5('match:' || doc_id), doc_id) AS pair FROM d)
SELECT a.lang, a.bucket, a.pair, a.doc_id AS case_key, b.doc_id AS control_key FROM r a JOIN r b ON a.lang = b.lang AND a.bucket = b.bucket AND a.pair = b.pair AND a.c AND NOT b.c""")
def matched_controls(spark, sf_dir):
    """Toxic documents with others of their language and length, one to one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).alias("bucket")).join(table(spark, sf_dir, "labels"), "doc_id")
    m = joins.matched(d, ["lang", "bucket"], "doc_id", F.col("toxic") == 1, "match")
    return m.withColumn("pair", F.col("pair").cast("bigint"))


@query("SELECT l_returnflag, count(*) AS n, round(max(abs(l_extendedprice * (1 - l_discount) - round(l_extendedprice * (1 - l_discount), 2))), 6) AS gap FROM lineitem GROUP BY l_returnflag")
def rounding_gap(spark, sf_dir):
    """The largest difference between prices and their rounded copies."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", price.alias("x"))
    keyed = a.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "x")))
    return joins.worst_gap(keyed, keyed.withColumn("x", F.round("x", 2)), ["l_orderkey", "k"], "x", ["l_returnflag"]).withColumn("gap", F.round("gap", 6))


LINKS = f"{TRANSFERS}, n AS (SELECT event_id AS candidate, 'n:' || world || ':' || src AS token FROM t UNION ALL SELECT event_id, 'm:' || world || ':' || dst FROM t)"


def linked(spark, sf_dir):
    token = lambda k, c: F.concat(F.lit(k), F.col("world").cast("string"), F.lit(":"), F.col(c).cast("string"))
    return transfers(spark, sf_dir).select(F.col("event_id").alias("candidate"), F.explode(F.array(token("n:", "src"), token("m:", "dst"))).alias("token"))


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT x.candidate AS a, y.candidate AS b FROM n x JOIN n y USING (token)), r AS (SELECT DISTINCT candidate AS a, candidate AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS candidate, min(b) AS grp FROM r GROUP BY a""")
def token_groups(spark, sf_dir):
    """Events of a world that share an account, however far along, in one group."""
    return splits.groups(linked(spark, sf_dir))


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT x.candidate AS a, y.candidate AS b FROM n x JOIN n y USING (token)), r AS (SELECT DISTINCT candidate AS a, candidate AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS candidate, min(b) AS grp FROM r GROUP BY a), f AS (SELECT grp, count(*) AS n, CAST(sum(CAST(kind = 'error' AS INTEGER)) AS BIGINT) AS p FROM g JOIN t ON t.event_id = g.candidate GROUP BY grp),
o AS (SELECT grp, p, n, row_number() OVER (ORDER BY p DESC, n DESC, md5('folds:' || grp), grp) AS k FROM f),
s AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(generate_series(0, 4), lambda i: {{'p': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'i': i}}) AS load, CAST(NULL AS BIGINT) AS fold
 UNION ALL SELECT k + 1, list_transform(load, lambda x: CASE WHEN x.i = best THEN {{'p': x.p + p, 'n': x.n + n, 'i': x.i}} ELSE x END), best
 FROM (SELECT s.k, s.load, o.p, o.n, list_sort(list_transform(s.load, lambda x: CASE WHEN o.p = o.n THEN [x.p, x.n, x.i, 0] WHEN o.p = 0 THEN [x.n - x.p, x.n, x.i, 0] ELSE [x.n, x.p, x.n - x.p, x.i] END))[1] AS least, CAST(CASE WHEN o.p = o.n OR o.p = 0 THEN least[3] ELSE least[4] END AS BIGINT) AS best FROM s JOIN o ON o.k = s.k + 1) q)
SELECT g.candidate, g.grp, CAST(s.fold AS INTEGER) AS fold FROM g JOIN o USING (grp) JOIN s ON s.k = o.k""")
def safe_folds(spark, sf_dir):
    """Five folds that no group crosses."""
    g = splits.groups(linked(spark, sf_dir))
    y = g.join(transfers(spark, sf_dir).select(F.col("event_id").alias("candidate"), (F.col("kind") == "error").cast("int").alias("y")), "candidate")
    return y.join(splits.fold_of_groups(splits.group_profile(y), 5, "folds"), "grp").select("candidate", "grp", "fold")


@query(f"WITH {LINKS} SELECT token, count(DISTINCT candidate % 5) AS folds FROM n GROUP BY token HAVING count(DISTINCT candidate % 5) > 1")
def fold_leaks(spark, sf_dir):
    """Accounts that folds by number would share."""
    return splits.leaks(linked(spark, sf_dir).withColumn("fold", F.col("candidate") % 5))


@query("SELECT CASE doc_id % 5 WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS part, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM labels GROUP BY 1")
def three_way_split(spark, sf_dir):
    """Rows and positives of test, validation and training for test fold 1."""
    return table(spark, sf_dir, "labels").groupBy(splits.three_way(F.col("doc_id") % 5, 1, 5).alias("part")).agg(F.count("*").alias("n"), F.sum("toxic").alias("positives"))


@query(CYCLES + """, e AS (SELECT world, length, cycle, unnest(generate_series(1, length)) AS i FROM c), s AS (SELECT world, src, dst, bool_or(amount > 60) AS bad FROM t GROUP BY ALL),
k AS (SELECT e.world, cycle, bool_and(bad) AS full_, bool_or(bad) AS hit FROM e JOIN s ON s.world = e.world AND s.src = e.cycle[i] AND s.dst = e.cycle[CASE WHEN i = e.length THEN 1 ELSE i + 1 END] GROUP BY ALL)
SELECT world, array_to_string(cycle, '-') AS cycle, CAST(full_ AS INTEGER) AS label FROM k WHERE full_ OR NOT hit""")
def cycle_labels(spark, sf_dir):
    """Cycles with a large event on every arc, or on none."""
    arcs = graph.cycle_arcs(census(spark, sf_dir)).select("world", F.array_join("cycle", "-").alias("cycle"), "src", "dst")
    return splits.cycle_labels(arcs, transfers(spark, sf_dir), F.col("amount") > 60, ("world",))


@query(CYCLES + """, e AS (SELECT world, length, cycle, unnest(generate_series(1, length)) AS i FROM c), s AS (SELECT world, src, dst, min(kind) AS lo, max(kind) AS hi FROM t WHERE amount > 60 GROUP BY ALL)
SELECT e.world, array_to_string(cycle, '-') AS cycle, CASE WHEN min(lo) = max(hi) THEN min(lo) END AS pattern FROM e LEFT JOIN s ON s.world = e.world AND s.src = e.cycle[i] AND s.dst = e.cycle[CASE WHEN i = e.length THEN 1 ELSE i + 1 END] GROUP BY ALL""")
def single_patterns(spark, sf_dir):
    """The kind of a cycle's large events where there is exactly one."""
    arcs = graph.cycle_arcs(census(spark, sf_dir)).select("world", F.array_join("cycle", "-").alias("cycle"), "src", "dst")
    return splits.single_pattern(arcs, transfers(spark, sf_dir).where("amount > 60").withColumn("pattern", F.col("kind")), ("world",))


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS before, lag(o_orderdate) OVER w AS then_, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, count(*) AS hops, CAST(0 AS BIGINT) AS gap, count_if(coalesce(o_orderdate < then_, false)) AS time, count_if(coalesce(o_totalprice > before + 0.0001, false)) AS growth, count_if(coalesce(o_totalprice < before * (1 - 0.02) - 0.0001, false)) AS fee FROM h GROUP BY o_custkey""")
def flow_faults(spark, sf_dir):
    """Each customer's orders as the hops of a ring, held against the rules of a conserved flow."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("src"), F.lit(1).alias("dst"), F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("amount"))
    return splits.flow_faults(o, "o_custkey", "o_orderkey")


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def strict_properties(spark, sf_dir):
    """The events' properties, read as strict JSON."""
    return table(spark, sf_dir, "events").select("event_id", strict_json(F.col("props"), "k bigint").alias("x")).select("event_id", "x.k")


@query("SELECT lang, source, count(*) AS n, grouping(lang) + grouping(source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def rolled_counts(spark, sf_dir):
    """Documents by language and source, with totals."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), (F.grouping("lang") + F.grouping("source")).cast("bigint").alias("level"))


@query(f"""WITH {TRANSFERS} SELECT event_id, unnest(CASE WHEN kind = 'signup' THEN ['missing'] ELSE [] END || CASE WHEN round(amount, 1) <> amount THEN ['differs'] ELSE [] END || CASE WHEN kind = 'error' THEN ['repeated'] ELSE [] END) AS fault, unnest(CASE WHEN kind = 'signup' THEN ['persisted'] ELSE [] END || CASE WHEN round(amount, 1) <> amount THEN ['amount'] ELSE [] END || CASE WHEN kind = 'error' THEN ['bound'] ELSE [] END) AS what FROM t""")
def five_way_reconciliation(spark, sf_dir):
    """Events as emitted, bound, buffered, persisted and native: what is missing, repeated or different."""
    t = transfers(spark, sf_dir).select("event_id", "src", "dst", "kind", "amount")
    parts = {"emitted": t, "bound": t.unionByName(t.where("kind = 'error'")), "buffered": t.withColumn("amount", F.round("amount", 1)), "persisted": t.where("kind <> 'signup'"), "native": t}
    return joins.reconcile_all(parts, ["event_id"], ["src", "dst", "amount"])


@query(f"""WITH {SCORED}, p AS (SELECT world, candidate, CASE WHEN s > 9000 THEN 1 - y ELSE y END AS y, CASE WHEN quality = 0 THEN 'test' ELSE 'train' END AS split FROM z WHERE s < 12000), q AS (SELECT world, candidate, y, CASE WHEN quality = 0 AND y = 1 THEN 'validation' WHEN quality = 0 THEN 'test' ELSE 'train' END AS split FROM z WHERE s > 100)
SELECT coalesce(p.world, q.world) AS world, count(q.candidate) AS expected, count(p.candidate) AS predicted, CAST(count_if(p.candidate IS NULL) AS BIGINT) AS missing, CAST(count_if(q.candidate IS NULL) AS BIGINT) AS stray, CAST(0 AS BIGINT) AS repeated, CAST(count_if(p.y <> q.y) AS BIGINT) AS label_mismatch, CAST(count_if(p.split <> q.split) AS BIGINT) AS split_mismatch FROM p FULL JOIN q ON p.world = q.world AND p.candidate = q.candidate GROUP BY 1""")
def prediction_custody(spark, sf_dir):
    """Predictions held against the population of each world."""
    z = scored(spark, sf_dir)
    split = F.when(F.col("quality") == 0, "test").otherwise("train")
    p = z.where("s < 12000").withColumn("split", split).withColumn("y", F.when(F.col("s") > 9000, 1 - F.col("y")).otherwise(F.col("y")))
    q = z.where("s > 100").withColumn("split", F.when((F.col("quality") == 0) & (F.col("y") == 1), "validation").otherwise(split))
    return joins.custody(p, q, ["world", "candidate"], "world")


@query(CYCLES + TUPLES + """, i AS (SELECT k.world, k.cycle, k.events, min(t.amount) AS low, bool_or(t.kind = 'error') AS sar FROM (SELECT *, unnest(events) AS event_id FROM k) k JOIN t USING (event_id) GROUP BY ALL)
SELECT world, array_to_string(cycle, '-') AS cycle, array_to_string(events, '-') AS events, low > 20 AS member, CASE WHEN low > 20 THEN sar END AS sar FROM i""")
def instance_membership(spark, sf_dir):
    """Every candidate with whether it is one of the complete instances, which are recorded from their second member on."""
    k = tuples(spark, sf_dir)
    e = k.select("world", "cycle", "events", F.explode("events").alias("event_id")).join(transfers(spark, sf_dir).drop("world"), "event_id").groupBy("world", "cycle", "events").agg(F.min("amount").alias("low"), F.bool_or(F.col("kind") == "error").alias("sar"))
    turn = lambda c: F.concat(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(1), F.lit(1)))
    instances = e.where("low > 20").select("world", F.monotonically_increasing_id().alias("instance"), turn("cycle").alias("members"), turn("events").alias("events"), "sar")
    m = joins.membership(k, instances, ["world"])
    return m.select("world", F.array_join("cycle", "-").alias("cycle"), F.array_join("events", "-").alias("events"), F.col("instance").isNotNull().alias("member"), "sar")


@query("""WITH l AS (SELECT l_orderkey AS alert, l_linenumber - 1 AS arc, max(l_shipdate) AS shipped FROM lineitem GROUP BY ALL), s AS (SELECT o_orderkey AS alert, CAST(o_custkey % 4 + 2 AS BIGINT) AS arcs FROM orders)
SELECT s.alert, s.arcs, count(arc) AS attempted, CAST(count_if(arc % 5 <> 4 AND arc IS NOT NULL) AS BIGINT) AS persisted, CAST(coalesce(count_if(arc % 5 <> 4 AND arc >= arcs), 0) AS BIGINT) AS stray,
 count(DISTINCT CASE WHEN arc % 5 <> 4 AND arc < arcs THEN arc END) = arcs AND coalesce(count_if(arc % 5 <> 4 AND arc >= arcs), 0) = 0 AS complete,
 count(DISTINCT CASE WHEN arc % 5 <> 4 AND arc < arcs THEN arc END) = arcs AND coalesce(count_if(arc % 5 <> 4 AND arc >= arcs), 0) = 0 AND coalesce(min(CASE WHEN arc % 5 <> 4 THEN shipped END) >= TIMESTAMP '1995-01-01', false) AS in_frame FROM s LEFT JOIN l USING (alert) GROUP BY s.alert, s.arcs""")
def realization_report(spark, sf_dir):
    """Orders as scheduled alerts, their lines as attempts and all but every fifth line as events: what was attempted, persisted and completed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("alert"), (F.col("l_linenumber") - 1).alias("arc"), "l_shipdate")
    arcs = dealt(lines, lines.count(), "alert", "arc").groupBy("alert", "arc").agg(F.max("l_shipdate").alias("time"))
    arcs = staged(arcs.withColumn("attempt", F.concat_ws("-", "alert", "arc")), "attempts")
    schedules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert"), (F.col("o_custkey") % 4 + 2).alias("arcs"))
    frame = (F.lit("1995-01-01").cast("timestamp"), F.lit("2999-01-01").cast("timestamp"))
    return joins.realization(schedules, arcs.select("attempt", "alert", "arc"), arcs.where("arc % 5 <> 4").select("attempt", "time"), frame)


@query("""WITH s AS (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS z FROM events) SELECT event_id, round((epoch(z) - (SELECT epoch(z) FROM s ORDER BY event_id LIMIT 1)) / 3600, 6) AS since FROM s""")
def parsed_hours(spark, sf_dir):
    """Times read from text in two forms, as hours from the first event."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm")).alias("text"))
    return features.relative_hours(e, "text", "event_id").select("event_id", F.round("since", 6).alias("since"))


@query(f"""WITH {TRANSFERS}, a AS (SELECT DISTINCT world, src, dst FROM t WHERE kind NOT IN ('signup', 'view') AND src <> dst) SELECT world, CAST(count_if(kind IN ('signup', 'view')) AS BIGINT) AS cash, CAST(count_if(kind NOT IN ('signup', 'view')) AS BIGINT) AS noncash, CAST(count_if(src = dst) AS BIGINT) AS loops, (SELECT count(*) FROM a WHERE a.world = t.world) AS arcs FROM t GROUP BY world""")
def cash_counts(spark, sf_dir):
    """Cash and other events of each world, with the arcs that a cycle may take."""
    return features.cash_counts(transfers(spark, sf_dir), ["world"], ["signup", "view"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN isnan(x) THEN 0.0 ELSE trunc(greatest(least(x * 100, 2147483647.0::DOUBLE), -2147483648.0::DOUBLE)) / 100 END AS native, CAST(CAST(x AS FLOAT) AS DOUBLE) AS narrow FROM (SELECT *, (l_extendedprice * (1 - l_discount) - 30000) * 1000 AS x FROM lineitem)")
def native_precision(spark, sf_dir):
    """Prices as 32 bits would hold their hundredths, and after a round trip through a narrow float."""
    x = (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000) * 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", features.native_precision(x).alias("native"), features.through_float(x).alias("narrow"))


@query("SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS worlds FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def repeated_inputs(spark, sf_dir):
    """Texts that come in more than one source."""
    return features.repeated_inputs(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text"), "source")


@query(f"""WITH {TRANSFERS} SELECT world, count(DISTINCT world || ':event:' || event_id) AS events, (SELECT count(*) FROM (SELECT src FROM t i WHERE i.world = t.world UNION SELECT dst FROM t i WHERE i.world = t.world)) AS accounts FROM t GROUP BY world""")
def world_ledger(spark, sf_dir):
    """Names of events and accounts that hold across worlds, counted."""
    t = transfers(spark, sf_dir)
    name = lambda kind, c: F.concat_ws(":", F.col("world"), F.lit(kind), F.col(c))
    names = t.select("world", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), name(k, c).alias("name")) for k, c in (("event", "event_id"), ("account", "src"), ("account", "dst"))))))
    return names.groupBy("world").agg(F.count_distinct(F.when(F.col("kind") == "event", F.col("name"))).alias("events"), F.count_distinct(F.when(F.col("kind") == "account", F.col("name"))).alias("accounts"))
