"""Operator 7: quality rules, with the divergence of a document from its language.

Base rules judge the number of words and the share of words in repeated 5-word windows. The method then compares two
histograms of the document, of its characters by class and of its common words (with one bin for all others), with the same
histograms summed over each language's documents that pass the base rules. Common words are learned: the TOP words of each language that most of
its documents hold, two at least. The words of all languages share BINS bins, dealt by a hash, so a histogram is as wide for a thousand languages as for one. The measure is the Jensen-Shannon distance, the root
of the divergence in bits, from 0 to 1. A document is kept if some language is near in both. Documents under MIN_COMMON
words are too short for the histogram of common words and are held against that of characters alone; those under MIN_WORDS are left to
the base rules.

Two passes over the texts, DataFrame operations alone, count the words' documents and write the counts of every document; texts are never shuffled, and windows are
compared inside their row: by 64-bit hashes to see that all differ, and word by word where any two hashes agree. The
references, one row for each language, are sums over all documents: those of the MOST_LITERALS largest stand in the plan itself, all
others are a written table that is broadcast in blocks of about BLOCK_LANGUAGES.

Defined results: null and empty texts have no words and fail the base rule; every row is judged by itself, repeated ones too;
without any reference (no labelled document passes) the base rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import staged, table

MIN_WORDS, MIN_COMMON, WINDOW, FEWEST, MOST_REPEATED = 50, 150, 5, 10, 20
#: Languages whose references are constants of the plan; languages of a block of the others.
MOST_LITERALS, BLOCK_LANGUAGES = 16, 1024
#: Largest Jensen-Shannon distances from a language.
MOST_CLASSES, MOST_COMMON = 0.27, 0.32
BLANK = r"[\x20\x09-\x0D]+"
#: What to remove from a text so that one class of characters is left; the last bin holds all others.
CLASSES = [r"[^\x20\x09-\x0D]+", "[^A-Z]+", "[^0-9]+", r"[^.,;:!?'\"()-]+", r"[^#*$%&|<>@~^_=+/\[\]{}\\]+", r"[\x00-\x7F]+"]
#: Common words of a language that are learned (the plan holds those of all languages); bins that they share.
TOP, BINS = 40, 64


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def removed(text: Column, pattern: str) -> Column:
    """Characters left without the matches of the pattern."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows that come twice or more in the row."""
    n = F.size(words) - (size - 1)

    def exact(_: Column) -> Column:
        windows = F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda i: F.named_struct(F.lit("w"), F.array_join(F.slice(words, i, size), " "), F.lit("i"), i)))

        def covered(w: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(w, a)["w"] == F.get(w, b)["w"], F.lit(False))
            again = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(w, k)["i"])), lambda i: i.isNotNull())
            start = F.named_struct(F.lit("end"), F.lit(0), F.lit("n"), F.lit(0))
            # Windows by place: each adds the words that the one before did not reach.
            return F.aggregate(F.array_sort(again), start, lambda acc, i: F.named_struct(F.lit("end"), i + (size - 1), F.lit("n"), acc["n"] + F.least(F.lit(size), i + (size - 1) - acc["end"])), lambda acc: acc["n"])

        return let(windows, covered)

    def differ(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(exact(hashes))

    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n < 2, 0).otherwise(let(hashes, differ))


def learned(df: DataFrame, text: str, lang: str, top: int = TOP) -> list[str]:
    """The common words of all languages: of each the `top` words in most of its documents, ties going to the lesser word; a word in one document alone isn't common."""
    words = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.array_distinct(words_of(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    held = words.groupBy("lang", "word").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = held.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    return sorted(r.word for r in best.select("word").distinct().collect())  # `top` for each language at most


def counts(df: DataFrame, text: str, lang: str, known: list[str]) -> DataFrame:
    """df with `_quality`: the base counts and both histograms of every row, and its language."""
    # Small letters, most of a text, are in none of the classes: they go once, and the passes by class read what is left.
    rows = df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_sparse", F.regexp_replace("_text", "[a-z]+", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        def common(h: Column) -> Column:
            own = F.array(*(F.size(h) - F.size(F.array_remove(h, F.lit(k).cast("long"))) for k in range(BINS)))
            return F.concat(own, F.array(F.size(words) - F.size(h)))

        hits = F.transform(F.filter(words, lambda w: w.isin(known)), lambda w: F.pmod(F.xxhash64(w), F.lit(BINS))) if known else F.array().cast("array<bigint>")
        return F.named_struct(F.lit("n_words"), F.size(words), F.lit("word_chars"), F.char_length(F.array_join(words, "")), F.lit("n_repeat_words"), repeated_words(words), F.lit("common"), let(hits, common))

    classes = [removed(F.col("_sparse"), p) for p in CLASSES]
    rest = F.char_length("_text") - sum(classes[1:], classes[0])
    made = rows.select(
        *df.columns,
        let(words_of(F.col("_text")), of_words).alias("_words"),
        removed(F.col("_sparse"), "[^#*$%&|<>]+").alias("_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("_lines"),
        F.array(*classes, rest).alias("_classes"),
    )
    failed = (F.col("_words.n_words") < FEWEST) | (100 * F.col("_words.n_repeat_words").cast("long") > MOST_REPEATED * F.col("_words.n_words").cast("long"))
    own = F.struct(F.col(lang).alias("lang"), "_words.*", F.col("_symbols").alias("n_symbols"), F.col("_lines").alias("n_dup_lines"), F.col("_classes").alias("classes"), failed.alias("base_failed"))
    return made.select(*df.columns, own.alias("_quality"))


def distance(own: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from shares; 1 for an empty histogram."""
    shares = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))
    total = F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def of(n: Column) -> Column:
        def term(x: Column, q: Column) -> Column:
            p = x / n
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

        terms = F.zip_with(own, shares, term)
        return F.when(n == 0, 1.0).otherwise(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))

    return let(total, of)


def references(made: DataFrame, most: int = MOST_LITERALS) -> tuple[dict[str, tuple[list[float], list[float]]], DataFrame]:
    """The shares of both histograms for the languages with the most documents, and for all others as a table (lang, a, b)."""
    bins = {"a": ("classes", len(CLASSES) + 1), "b": ("common", BINS + 1)}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{x}{i}") for x, (c, n) in bins.items() for i in range(n)]
    good = made.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS) & F.col("lang").isNotNull())
    added = good.groupBy("lang").agg(F.count("*").alias("n"), *sums)

    def shares(x: str) -> Column:
        own = [F.col(f"{x}{i}") for i in range(bins[x][1])]
        return F.array(*[c / sum(own[1:], own[0]) for c in own]).alias(x)

    known = staged(added.select("lang", "n", shares("a"), shares("b")), "references")
    out = {r.lang: (r.a, r.b) for r in known.orderBy(F.desc("n"), "lang").limit(most).collect()}
    return out, known.where(~F.col("lang").isin(list(out))).select("lang", "a", "b")


def judged(df: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, min_common: int = MIN_COMMON, most_classes: float = MOST_CLASSES, most_common: float = MOST_COMMON, carry: list[str] | None = None, most_literals: int = MOST_LITERALS, block_languages: int = BLOCK_LANGUAGES) -> DataFrame:
    """df, or its columns `carry`, with `_quality`, the counts, and `_kept`, `_nearest`: the verdict, and the nearest language with its distance as a share of what is allowed. These columns are written once more, so that a text is judged by its own row and never joined."""
    made = staged(counts(df, text, lang, learned(df, text, lang)).select(*(df.columns if carry is None else carry), "_quality"), "quality-counts")
    known, others = references(made.select("_quality.*"), most_literals)
    own = lambda c: F.col(f"_quality.{c}")

    def far(a: list[float] | Column, b: list[float] | Column, x: Column) -> Column:
        return F.named_struct(F.lit("far"), F.greatest(distance(own("classes"), a) / most_classes, F.when(own("n_words") >= min_common, distance(own("common"), b) / most_common)), F.lit("lang"), x)

    pairs = [far(a, b, F.lit(x)) for x, (a, b) in known.items()]
    nearest = F.array_min(F.array(*pairs)) if pairs else F.lit(None).cast("struct<far: double, lang: string>")
    columns = made.columns
    n_blocks = -(-others.count() // block_languages) if len(known) == most_literals else 0
    for i in range(n_blocks):
        block = others.where(F.pmod(F.xxhash64("lang"), F.lit(n_blocks)) == i).agg(F.collect_list(F.struct("lang", "a", "b")).alias(f"_block{i}"))
        made = made.crossJoin(F.broadcast(block))
        here = F.when(own("n_words") >= min_words, F.array_min(F.transform(f"_block{i}", lambda r: far(r["a"], r["b"], r["lang"]))))
        made = made.select(*columns, *[f"_near{k}" for k in range(i)], here.alias(f"_near{i}"))
    if n_blocks:
        nearest = F.array_min(F.array(nearest, *[F.col(f"_near{i}") for i in range(n_blocks)]))
    out = made.withColumn("_nearest", F.when(own("n_words") >= min_words, nearest))
    return out.withColumn("_kept", ~own("base_failed") & F.coalesce(F.col("_nearest.far") <= 1, F.lit(True))).drop(*[f"_near{i}" for i in range(n_blocks)])


def passed(df: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The rows of df that are kept."""
    nested = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return judged(nested, carry=["row"], **limits).where("_kept").select("row.*")


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """key, the base counts, base_failed, kept, the distance of the nearest language and its name."""
    slim = df.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return judged(slim, "text", "lang", carry=["key"], **limits).select(
        F.col("key").alias(key),
        *[F.col(f"_quality.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "_quality.base_failed",
        F.col("_kept").alias("kept"),
        F.col("_nearest.far").alias("divergence"),
        F.col("_nearest.lang").alias("nearest_lang"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
