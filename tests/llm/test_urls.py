import itertools
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def fixed(host, path):
    best = None
    for what, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return best


URLS = [None, "", "nohost", "http://", "HTTP://EXAMPLE.NET/en/x?y=1", "https://a.Example.net/en", "http://b.example.com/de/1#t", "http://xexample.com/de/", "x://q.org/fr/a?b://c", "x://q.org/FR/", "http://net/", "http://net", "http://a.net?x=/", "http://É.com/a\nb", "://net/x", "http://a.com/" + "p/" * 5000]


def test_parts_and_fixed_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, None), (3, "http://")], "page_id long, url string")
    index = urls.mine(df.select("url", F.lit(None).cast("boolean").alias("bad")))
    rows = urls.judge(df.withColumn("verdict", F.lit(1)).withColumn("host", F.lit(2)), index).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path = parse(r.url)
        rule = fixed(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[1], rule[0] if rule else "allow"), r.url
    assert urls.judge(df.limit(0), index).collect() == []


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host = rng.choice(["shop.spam.com", "blog.site.com", "www.site.com", "spam.site.com"])
        path = rng.choice(["/win/", "/news/", "/win/cash/"]) + str(rng.randrange(9))
        bad = ("spam" in host and "win" in path) if rng.random() > 0.05 else rng.random() < 0.5
        rows.append((i, f"http://{host}{path}" + rng.choice(["", "?ref=1"]), bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    host, path = urls.parts(F.col("url"))
    own = df.select("bad", urls.tokens(F.col("url"), host, path).alias("t")).collect()
    stand = {w: frozenset(i for i, r in enumerate(own) if w in r.t) for r in own for w in r.t}
    like = {w: tuple(sorted(v for v in stand if stand[v] == stand[w])) for w in stand}  # the tokens of the same URLs
    least, sure = 0.05, 0.8
    count, bad = Counter(), Counter()
    for r in own:
        for n in range(1, len(r.t) + 1):
            for s in itertools.combinations(sorted({like[w] for w in r.t}), n):
                count[s] += 1
                bad[s] += r.bad
    rules = {s: bad[s] / count[s] for s in count if bad[s] >= least * len(rows) and bad[s] / count[s] >= sure}
    kept = {s: c for s, c in rules.items() if not any(set(f) < set(s) for f in rules)}
    index = urls.mine(df, min_support=least, min_confidence=sure)
    got = {tuple(map(tuple, r.needs)): r.confidence for x in index.collect() for r in x.rules}
    assert {s: round(c, 9) for s, c in got.items()} == {s: round(c, 9) for s, c in kept.items()}
    assert kept
    rows = urls.judge(df.union(df), index, rules=[]).collect()
    want = {r.page_id: any(all(set(c) & set(o.t) for c in s) for s in kept) for r, o in zip(df.collect(), own, strict=True)}
    assert len(rows) == 800
    assert all((r.verdict == "block") == want[r.page_id] for r in rows)


def test_tokens_of_the_same_urls_all_make_rules(spark):
    """Each of two tokens that always came together blocks by itself; a rule may have more than eight tokens."""
    rows = [(f"http://a.com/aaa/bbb/{'x' * i}", True) for i in range(50)] + [(f"http://a.com/ccc/{'x' * i}", False) for i in range(50)]
    index = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    pages = spark.createDataFrame([(i, f"http://a.com/{w}/1") for i, w in enumerate(["aaa", "bbb", "ccc", "ddd"])], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, index, rules=[]).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]
    words = [f"w{chr(97 + i)}" for i in range(10)]
    rows = [(f"http://a.com/{'/'.join(words)}", True)] * 30 + [(f"http://a.com/{'/'.join(w for w in words if w != out)}", False) for out in words] * 30
    index = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    assert {len(r.needs) for x in index.collect() for r in x.rules} == {10}
    pages = spark.createDataFrame([(i, f"http://b.com/{'/'.join(words[:n])}") for i, n in enumerate([10, 9])], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, index, rules=[]).orderBy("page_id").collect()] == ["block", "allow"]


def test_sample_is_bounded(spark):
    df = spark.range(3000).select(F.concat(F.lit("http://a.com/x/"), "id").alias("url"), (F.col("id") % 2 == 0).alias("bad"))
    assert urls.mine(df, most=300, min_confidence=0.1).count() > 0


def test_long_and_frequent_urls_are_mined_fast(spark):
    """A URL of 30 words as a third of all labels, and others with nearly the same words."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)]
    rows = [(f"http://trap.com/{'/'.join(words)}", True)] * 700
    rows += [(f"http://trap.com/{'/'.join(w for w in words if rng.random() < 0.9)}", rng.random() < 0.9) for _ in range(600)]
    rows += [(f"http://good.com/{rng.choice(words)}/{i}", False) for i in range(800)]
    df = spark.createDataFrame(rows, "url string, bad boolean").repartition(4)
    began = time.time()
    index = urls.mine(df)
    pages = spark.createDataFrame([(1, rows[0][0]), (2, "http://good.com/x/1"), (2, "http://good.com/x/1")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages, index, rules=[]).collect()) == [(1, "block"), (2, "allow"), (2, "allow")]
    assert time.time() - began < 90
