"""Operator 1: URL filters by association rules.

Fixed rules for hosts and paths come first. Other URLs are judged by rules mined from labelled URLs: Spark's FP-growth finds the
frequent combinations of URL tokens with the class `bad`; a rule stays if its support and confidence suffice and no other rule's tokens are
all among its own, as that one fires wherever it does. The rules form an inverted index on their rarest token, so a URL meets only rules
that share such a token with it, and a rule fires if the URL has all of its tokens.

Tokens that stand in fewer bad URLs than the least support are in no rule and go first, which changes none. Tokens that stand in the same labelled
URLs are mined as one class, so that a long or often repeated URL doesn't multiply combinations; each of a class's tokens meets a rule's
need for it, as a rule with any of them has the same support and confidence. Classes that make a rule by themselves come from counts alone and
leave the combinations, where they could only be parts of rules that don't stay. What is left goes to FP-growth whole.

Mining looks at a sample of at most about MOST_LABELLED labelled URLs, picked by a hash; the index joins as Spark sees fit by its
written size. DataFrame operations alone; URLs are grouped after partial aggregation, so repeated ones cost nothing.

Defined results: a null URL, or one without ://, has an empty host and path, no tokens and, without a rule, the verdict allow;
repeated rows are returned as often as they come; without labels no rule is mined.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import staged, table

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MOST_LABELLED, MIN_SUPPORT, MIN_CONFIDENCE = 200_000, 0.005, 0.8
BAD = "class:bad"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(c, F.lit("")) for c in (ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels, the path's words with numbers made alike, the names of the query's fields."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.transform(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "0"), "[^a-z0-9\x80-\U0010ffff]+"), lambda x: F.concat(F.lit("path:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    fields = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("field:"), F.substring_index(x, "=", 1)))
    return F.filter(F.array_distinct(F.concat(labels, words, fields)), lambda x: ~x.isin("host:", "path:", "field:"))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", most: int = MOST_LABELLED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The index: (token, rules array<struct<needs, confidence>>); a need is met by any of its tokens."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(url).alias("url"), F.col(bad).alias("bad")).where("url IS NOT NULL AND bad IS NOT NULL")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    items = tokens(F.col("url"), *parts(F.col("url")))
    named = staged(rows.select(F.monotonically_increasing_id().alias("row"), "bad", items.alias("items")).repartition(8), "labelled-urls")  # at most about `most` short rows
    total, n_bad = named.agg(F.count("*"), F.count_if("bad")).first()
    empty = spark.createDataFrame([], "token string, rules array<struct<needs: array<array<string>>, confidence: double>>")
    if not n_bad:
        return empty
    stands = F.xxhash64("row")
    counted = named.select("row", "bad", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad_n"), F.bit_xor(stands).alias("x"), F.sum(F.shiftright(stands, 20)).alias("s"))
    classes = staged(counted.where(F.col("bad_n") >= math.ceil(min_support * total)).groupBy("n", "bad_n", "x", "s").agg(F.array_sort(F.collect_set("item")).alias("members")).withColumn("item", F.col("members")[0]), "token-classes")  # a class's tokens stand in one URL
    alone = F.col("bad_n") / F.col("n") >= min_confidence
    own = named.select("row", F.explode("items").alias("item")).join(classes.where(~alone).select("item"), "item").groupBy("row").agg(F.collect_list("item").alias("own"))  # as many as a URL has tokens
    items = F.coalesce("own", F.array().cast("array<string>"))
    baskets = staged(named.select("row", "bad").join(own, "row", "left").select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BAD)))).otherwise(items).alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=8).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(F.array_sort("antecedent").alias("needs"), "confidence")
    found = staged(found, "rules")
    # A rule falls to one whose tokens are among its own: rules meet by their least token.
    parts_of = found.select(F.col("needs")[0].alias("item"), F.col("needs").alias("part"))
    beaten = found.where(F.size("needs") > 1).select("needs", F.explode("needs").alias("item")).join(parts_of, "item").where((F.size("part") < F.size("needs")) & (F.size(F.array_except("part", "needs")) == 0)).select("needs").distinct()
    kept = found.join(beaten, "needs", "left_anti").union(classes.where(alone).select(F.array("item"), F.col("bad_n") / F.col("n")))
    each = kept.select("needs", "confidence", F.explode("needs").alias("item")).join(classes.select("item", F.col("n").alias("freq"), "members"), "item")
    rarest = each.groupBy("needs", "confidence").agg(F.min(F.struct("freq", "item", "members"))["members"].alias("tokens"), F.sort_array(F.collect_list("members")).alias("met"))
    return staged(rarest.select(F.explode("tokens").alias("token"), "met", "confidence").groupBy("token").agg(F.sort_array(F.collect_list(F.struct(F.col("met").alias("needs"), "confidence"))).alias("rules")), "rule-index")


def judge(pages: DataFrame, index: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, url, host, path, rule, verdict and the confidence of the surest mined rule that fires."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    rows = rows.select("key", "url", tokens(F.col("url"), host, path).alias("tokens"))
    at = rows.select("key", "url", "tokens", F.posexplode_outer("tokens").alias("pos", "token")).join(index, "token", "left")
    fires = F.filter("rules", lambda r: F.forall(r["needs"], lambda n: F.arrays_overlap(n, F.col("tokens"))))
    sure = at.select("key", "url", F.array_max(F.transform(fires, lambda r: r["confidence"])).alias("confidence"), F.coalesce("pos", F.lit(0)).alias("pos"))
    one = sure.groupBy("key", "url").agg(F.max("confidence").alias("confidence"), F.count_if(F.col("pos") == 0).alias("copies"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return one.select("key", "url", "confidence", "copies", host.alias("host"), path.alias("path")).select(F.col("key").alias(key), "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    # A page shows the document whose number its path holds; bad are those of low quality and toxic ones.
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) AS bigint)").alias("doc_id")).where("doc_id IS NOT NULL")
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return judge(pages, mine(shown.join(bad, "doc_id"))).drop("url")
