"""Operator 11: phrase collocations, counted as packed keys of word ids.

Texts become blocks of word places with a vocabulary of their own. The vocabularies' counts give the frequent words, which get ids in
the order of (lang, word); a block's vocabulary is joined with those ids, so no task ever holds the whole dictionary. A word that isn't
frequent breaks its piece, as no phrase over the least count can hold it. Phrases of 2 to 4 ids are packed into binary keys of one width.
A task sorts its keys by radix, two million at a time, and counts their runs, so that a very common phrase is a key or a few for each task; what
is left goes in compressed runs to ranges of keys of about two millions, which are sorted by radix and run-length counted again. Scores
and the rule on longer phrases are joins of the counted phrases; quotients are taken in decimals.

Defined results: a null text has no words; a null lang is `und`; ids, repeated rows and other columns play no part, but each row's words count;
an empty table, or one without a phrase of the least count, gives no rows. A very long text is cut at the ends of its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.llm.texts import batches_of, flat, slices
from loomgraph.session import discard, staged, table

LEAST = 30
FIRST = 2000
MOST_WORDS = 4
#: A candidate inside a longer one with at least so many hundredths of its count goes.
SHARE = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Bytes of text in a block, about. Rows of a block are that long, and Parquet's writer holds a hundred.
BLOCK_BYTES = 1 << 20
#: Keys that a task sorts at once, and keys, about, that are counted together.
HELD_KEYS, PART_KEYS = 1 << 21, 1 << 21
#: Blocks that the bounds between tasks are taken from.
SAMPLED = 64

BLOCK = "block long, lang string, words array<string>, counts array<long>, ids binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
CODED, CODED_SCHEMA = "block long, ids binary, n long", pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("n", pa.int64())])
DEALT, DEALT_SCHEMA = "part int, keys binary, n binary", pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in runs of about so many bytes, cut where a piece ends."""
    a = 0
    while a < data.size:
        b = min(a + most, data.size)
        end = int(offsets[np.searchsorted(offsets, b)])  # of the text that b lies in
        while b < end:
            found = np.flatnonzero(KIND[data[b : min(b + most, end)]] == 2)
            if found.size:
                end = b + int(found[0])
            b = min(b + most, end)
        inner = offsets[(offsets > a) & (offsets < end)]
        yield data[a:end], np.concatenate([[0], inner - a, [end - a]])
        a = end


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words in lower case, and the number of each one's piece (any numbers that grow from piece to piece)."""
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < data.size]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[heads[heads > 0] - 1] |= inside[heads[heads > 0] - 1]
    at = np.flatnonzero(first)
    ends = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - at))
    words = pa.LargeStringArray.from_buffers(at.size, pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]]))
    return words, np.searchsorted(np.flatnonzero(kind == 2), at) + np.searchsorted(offsets, at, "right")


def blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The texts as (block, lang, words, counts, ids): ids are 32-bit places in words, from 1, with 0 between pieces."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                for own in pc.unique(batch.column("lang")).to_pylist():
                    data, offsets = flat(batch.filter(pc.equal(batch.column("lang"), own)).column("text"))
                    for d, o in runs(data, offsets):
                        words, piece = pieces(d, o)
                        if len(words):
                            coded = words.dictionary_encode()
                            local = coded.indices.to_numpy()
                            ids = np.zeros(local.size + int(np.count_nonzero(np.diff(piece))), "<u4")
                            ids[np.arange(local.size) + np.cumsum(np.diff(piece, prepend=piece[0]) != 0)] = local + 1
                            row = {"block": part << 32 | k, "lang": own, "words": coded.dictionary.to_pylist(), "counts": np.bincount(local).tolist(), "ids": ids.tobytes()}
                            yield pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)
                            k += 1

    return docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang")).mapInArrow(run, BLOCK)


def counted(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in ascending order and their counts: least significant digits first, sixteen bits a pass, then lengths of runs."""
    n = columns[0].size
    if not n:
        return columns, np.zeros(0, np.int64)
    if len(columns) == 1 and weights is None:
        columns = [np.sort(columns[0])]
    else:
        order = np.arange(n)
        for c in reversed(columns):
            for shift in range(0, 64, 16):
                digit = (c >> np.uint64(shift)).astype(np.uint16)
                if (digit != digit[0]).any():
                    order = order[np.argsort(digit[order], kind="stable")]
        columns = [c[order] for c in columns]
        weights = None if weights is None else weights[order]
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, n)) if weights is None else np.add.reduceat(weights, at)


def packed(g: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    """The keys of the runs of n ids without a 0, as one or two columns of 64 bits."""
    at = np.flatnonzero(np.all([g[i : g.size - n + 1 + i] != 0 for i in range(n)], axis=0)) if g.size >= n else np.zeros(0, np.int64)
    each = 64 // bits
    out = []
    for c in range(MOST_WORDS // each):
        key = np.zeros(at.size, np.uint64)
        for i in range(c * each, min(n, (c + 1) * each)):
            key |= g[at + i].astype(np.uint64) << np.uint64(64 - bits * (i - c * each + 1))
        out.append(key)
    return out


def planes(columns: list[np.ndarray]) -> bytes:
    """Ascending keys, the first column as differences, byte by byte: zeros stand together and compress."""
    first = np.diff(columns[0], prepend=np.zeros(1, np.uint64))
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in [first, *columns[1:]])


def unplaned(data: bytes, width: int) -> list[np.ndarray]:
    rows = np.frombuffer(data, np.uint8).reshape(width, 8, -1)
    first, *rest = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in rows)
    return [np.cumsum(first, dtype=np.uint64), *rest]


def bounds(coded: DataFrame, bits: int, parts: int) -> np.ndarray:
    """parts - 1 ascending keys (first columns) that deal the keys about evenly, from SAMPLED blocks at most; they decide where a key is counted, not what is counted."""
    chosen = [r.block for r in coded.select("block").orderBy(F.xxhash64("block")).limit(SAMPLED).collect()]
    near = coded.where(F.col("block").isin(chosen))

    def run(batches):
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                g = np.frombuffer(ids, f"<u{bits // 8}")
                keys = np.unique(np.concatenate([packed(g, n, bits)[0] for n in range(2, MOST_WORDS + 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:: keys.size // 4096 + 1].astype(np.int64))], ["key"])

    keys = np.sort(near.mapInArrow(run, "key long").toArrow().column("key").to_numpy().astype(np.uint64))
    return np.unique(keys[np.arange(1, parts) * keys.size // parts]) if keys.size else keys


def phrases(coded: DataFrame, bits: int, least: int) -> DataFrame:
    """(key, a): the phrases with at least so many occurrences. coded: (block, ids, n)."""
    width = MOST_WORDS * bits // 64
    total = coded.agg(F.sum("n")).first()[0] or 0
    cuts = bounds(coded, bits, max(1, -(-3 * total // PART_KEYS)))

    def grams(batches):
        held, size = [[] for _ in range(width)], 0

        def dealt():
            columns, n = counted([np.concatenate(c) for c in held])
            ends = np.searchsorted(columns[0], cuts)
            for part, (a, b) in enumerate(zip([0, *ends], [*ends, n.size], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_pylist([{"part": part, "keys": planes([c[a:b] for c in columns]), "n": np.ascontiguousarray(n[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()}], DEALT_SCHEMA)

        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                g = np.frombuffer(ids, f"<u{bits // 8}")
                for n in range(2, MOST_WORDS + 1):
                    key = packed(g, n, bits)
                    for c, x in zip(held, key, strict=True):
                        c.append(x)
                    size += key[0].size
                if size >= HELD_KEYS:
                    yield from dealt()
                    held, size = [[] for _ in range(width)], 0
        if size:
            yield from dealt()

    def lengths(batches):
        part, keys, n = None, [], []

        def done():
            columns, a = counted([np.concatenate(c) for c in zip(*keys, strict=True)], np.concatenate(n))
            keep = np.flatnonzero(a >= least)
            data = np.stack([c[keep] for c in columns], axis=1).astype(">u8").tobytes()
            size = 8 * width
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary()), pa.array(a[keep], pa.int64())], ["key", "a"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if keys:
                        yield from done()
                    part, keys, n = r["part"], [], []
                keys.append(unplaned(r["keys"], width))
                n.append(np.ascontiguousarray(np.frombuffer(r["n"], np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
        if keys:
            yield from done()

    with batches_of(coded.sparkSession, 16):
        dealt = coded.select("ids").mapInArrow(grams, DEALT).repartition(F.col("part")).sortWithinPartitions("part")
        return staged(dealt.mapInArrow(lengths, "key binary, a long"), "phrases")


def encoded(made: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """(block, ids, n): the blocks in ids of the frequent words, 0 elsewhere; n is the number of ids. words: (id, lang, word)."""
    known = made.select("block", "lang", F.posexplode("words").alias("pos", "word")).join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))  # at most the words of a block

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), "<u4")
                own = batch.column("known")[i].values
                to = np.zeros(int(ids.max()) + 1, f"<u{bits // 8}")
                to[own.field("pos").to_numpy() + 1] = own.field("id").to_numpy()
                g = to[ids]
                g = g[(g != 0) | np.append(False, g[:-1] != 0)]  # one 0 parts as well as many
                yield pa.RecordBatch.from_pylist([{"block": batch.column("block")[i].as_py(), "ids": g.tobytes(), "n": g.size}], CODED_SCHEMA)

    with batches_of(made.sparkSession, 16):
        return staged(made.select("block", "ids").join(known, "block").select("block", "ids", "known").mapInArrow(run, CODED), "coded")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int | None = FIRST, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's phrases of 2 to 4 words, best first; all of them where first is None."""
    with batches_of(docs.sparkSession, 1024):
        made = staged(blocks(docs, text, lang), "blocks")
    each = made.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("a")).where(F.col("a") >= least)
    words = staged(with_ordinal(each, ["lang", "word"], "place").withColumn("id", F.col("place") + 1).drop("place"), "words")
    totals = staged(made.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    most = words.agg(F.max("id")).first()[0] or 0
    if most >= 1 << 32:
        raise ValueError(f"{most} frequent words don't fit 32 bits")
    bits = 16 if most < 1 << 16 else 32
    size = bits // 8
    coded = encoded(made, words, bits)
    discard(made)
    found = phrases(coded, bits, least)

    def part(key: Column, start: Column, count: Column) -> Column:
        return F.rpad(F.substring(key, start * size + 1, count * size), MOST_WORDS * size, F.lit(b"\0"))

    def at(key: Column, i: int | Column) -> Column:
        return F.conv(F.hex(F.substring(key, F.lit(i) * size + 1, F.lit(size))), 16, 10).cast("long")

    own = found.withColumn("words", F.when(at(F.col("key"), 3) > 0, 4).when(at(F.col("key"), 2) > 0, 3).otherwise(2))
    one = words.select(F.rpad(F.unhex(F.lpad(F.hex("id"), 2 * size, "0")), MOST_WORDS * size, F.lit(b"\0")).alias("key"), "a")
    counts = found.select("key", "a").union(one)
    longer = own.where("words > 2").select("a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("words") - m), lambda s: part(F.col("key"), s, m))))).alias("key"))
    within = longer.groupBy("key").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = own.join(within, "key", "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * share)).drop("most")
    cuts = kept.select("key", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": part(F.col("key"), F.lit(0), F.col("k")), "right": part(F.col("key"), F.col("k"), F.col("words") - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    scored = cuts.withColumns({"a2": wide("a") * SCALE, "lr": wide("l") + wide("r")}).withColumn("score", F.expr("a2 div lr"))
    best = scored.groupBy("key", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    spelt = best.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: at(F.col("key"), i))).alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    named = spelt.groupBy("key", "a", "x", "lang").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w.word)).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = named.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN range(1, 5) AS t(k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
subs AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM c, range(2, 4) AS t(m) WHERE m < k),
inside AS (SELECT lang, phrase, max(a) AS most FROM subs GROUP BY lang, phrase),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * c.a),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, j, x.a AS l, y.a AS r, (2000000 * kept.a) // (x.a + y.a) AS score
  FROM kept JOIN range(1, 4) AS t(j) ON j < k
  JOIN f AS x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.w[1:j], ' ')
  JOIN f AS y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
