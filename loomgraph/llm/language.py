"""Operator 4: language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ORDER bytes long with the counts of what followed them. A byte that followed
the longest known context costs -log2(count / (total + distinct)) bits; else the escape, -log2(distinct / (total + distinct)), is
paid and the next shorter context decides, down to 8 bits for a byte that the language never showed. The statistics are frozen
after training, so the cost of a byte depends on the bytes before it alone, and a text's code length is a sum of table look-ups.
The language with the shortest code wins; the score is its posterior under equal priors.

Training: Spark counts (language, context, byte) over a sample of passages, about SAMPLE_BYTES of each language at most. Passages are
stretches of BLOCK_BYTES picked by a hash of row and place, so a few very long texts are sampled like many short ones, and
a language with any text is met. A language's tree depends on its own passages alone; nothing is pruned, and any number of languages
is learned. Trees go to the workers BLOCK_LANGUAGES at a time, which bounds the broadcast. With one such block prediction is one pass without
a shuffle; with more, each block passes over the texts once and the best of the blocks is found by row.

Defined results: a null text or one without a letter is `und` with score 0 and no code length; without any training text all are
`und`; ties go to the first name; repeated rows are each judged; an existing column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.llm.texts import arrow_rows, flat, slices
from loomgraph.session import staged, table

ORDER = 4
SAMPLE_BYTES, BLOCK_BYTES = 1_000_000, 4096
#: Languages whose trees are in memory at once.
BLOCK_LANGUAGES = 32
#: Rows of rates that may be broadcast.
MOST_BROADCAST = 50_000
#: Costs that are kept for grams met before, and costs looked up at once: numbers of floats.
MEMO, STEP = 1 << 23, 1 << 22
UNKNOWN = "und"
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Each of data[lo:hi] behind the ORDER bytes before it, as one number; zeros stand before a text."""
    begins = offsets[(offsets > lo - ORDER) & (offsets < hi)]
    out = data[lo:hi].astype(np.uint64)
    for k in range(1, ORDER + 1):
        a = max(lo - k, 0)
        x = np.zeros(hi - lo, np.uint64)
        x[a + k - lo :] = data[a : hi - k]
        for j in range(k):
            at = begins + j
            x[at[(at >= lo) & (at < hi)] - lo] = 0
        out |= x << np.uint64(8 * k)
    return out


def places(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each wanted value stands in the ascending known ones, whether it does)."""
    at = np.minimum(np.searchsorted(known, wanted), known.size - 1)
    return at, known[at] == wanted


class Tree:
    """The contexts of one language. For each length: the contexts with their escapes, and the contexts followed by a byte with its cost, both ascending."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            own, which = np.unique(gram & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(which, n, own.size)
            context, first = np.unique(own >> np.uint64(8), return_index=True)
            distinct = np.diff(np.append(first, own.size))
            all_ = np.add.reduceat(count, first) + distinct
            self.levels.append((context, np.log2(all_ / distinct).astype(np.float32), own, np.log2(np.repeat(all_, distinct) / count).astype(np.float32)))

    def costs(self, gram: np.ndarray) -> np.ndarray:
        out = np.full(gram.size, 8, np.float32)
        left = np.arange(gram.size)  # those whose contexts are known so far
        for order, (context, escape, own, cost) in enumerate(self.levels):
            key = gram[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            at, known = places(context, key >> np.uint64(8))
            left, key, at = left[known], key[known], at[known]
            where, met = places(own, key)
            out[left] = np.where(met, cost[where], out[left] + escape[at])
        return out


@dataclass
class Model:
    """The trees of some languages."""

    languages: list[str]
    trees: list[Tree]
    _memo: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    @classmethod
    def of(cls, counts: pa.Table) -> Model:
        """counts: lang, gram, n."""
        lang = counts.column("lang").combine_chunks().dictionary_encode()
        which, gram, n = lang.indices.to_numpy(), counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy()
        names = lang.dictionary.to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i])
        return cls([names[i] for i in order], [Tree(gram[which == i], n[which == i]) for i in order])

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """[gram, language] in bits. Those met before are read from a table with one place for each hash; others are worked out."""
        if self._memo is None:
            bits = max(10, (MEMO // len(self.trees)).bit_length() - 1)
            self._memo = np.full(1 << bits, NONE), np.zeros((1 << bits, len(self.trees)), np.float32), np.uint64(64 - bits)
        keys, values, shift = self._memo
        slot = gram * np.uint64(0x9E3779B97F4A7C15) >> shift
        out = values[slot]
        new = np.flatnonzero(keys[slot] != gram)
        if new.size:
            distinct, back = np.unique(gram[new], return_inverse=True)
            made = np.stack([t.costs(distinct) for t in self.trees], axis=1)
            out[new] = made[back]
            slot = distinct * np.uint64(0x9E3779B97F4A7C15) >> shift
            slot, last = np.unique(slot[::-1], return_index=True)
            keys[slot], values[slot] = distinct[::-1][last], made[::-1][last]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((offsets.size - 1, len(self.languages)))
        step = max(1, STEP // len(self.languages))
        for lo in range(0, data.size, step):
            hi = min(lo + step, data.size)
            begins = np.unique(np.append(lo, offsets[(offsets > lo) & (offsets < hi)]))
            texts = np.searchsorted(offsets, begins, "right") - 1
            out[texts] += np.add.reduceat(self.costs(grams(data, offsets, lo, hi)), begins - lo, axis=0, dtype=np.float64)
        return out


def sample_counts(df: DataFrame, key: str, text: str, lang: str, sample_bytes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, gram, n) over about sample_bytes of each language's texts."""
    # Drawn by what a row holds, so that the same rows give the same sample however they are dealt to tasks; equal rows count once.
    rows = df.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n"))
    rates = staged(sizes.groupBy("lang").agg((F.lit(float(sample_bytes)) / F.sum("n")).alias("rate")).where("rate IS NOT NULL"), "language-rates")
    rows = rows.join(F.broadcast(rates) if rates.count() <= MOST_BROADCAST else rates, "lang")
    last = F.floor((F.octet_length("text") - 1) / block_bytes)
    drawn = F.filter(F.sequence(F.lit(0), last.cast("int")), lambda k: F.shiftrightunsigned(F.xxhash64("h", k), 11) / float(1 << 53) < F.col("rate"))
    chosen = rows.where(F.octet_length("text") > 0).select("lang", "h", "text", drawn.alias("blocks")).where(F.size("blocks") > 0).dropDuplicates(["lang", "h"])

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = flat(batch.column("text"))
                for i, (name, blocks) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("blocks").to_pylist(), strict=True)):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    own = np.array([a, b])
                    found, n = np.unique(np.concatenate([grams(data, own, a + k * block_bytes, min(b, a + (k + 1) * block_bytes)) for k in blocks]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * found.size, pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    arrow_rows(df.sparkSession)
    return chosen.drop("h").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Languages:
    """The counts of all languages as a written table, in blocks of at most so many languages."""

    counts: DataFrame
    blocks: int

    def models(self) -> Iterator[Model]:
        for i in range(self.blocks):
            yield Model.of(self.counts.where(F.col("block") == i).select("lang", "gram", "n").toArrow())  # bounded by the sample of a block's languages


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, block_languages: int = BLOCK_LANGUAGES, block_bytes: int = BLOCK_BYTES) -> Languages:
    """The languages of the labelled texts in df."""
    counts = staged(sample_counts(df, key, text, lang, sample_bytes, block_bytes), "language-counts")
    names = counts.select("lang").distinct()
    n = names.count()
    if n <= block_languages:
        return Languages(counts.withColumn("block", F.lit(0)), min(n, 1))
    block = with_ordinal(names, ["lang"], "place").select("lang", F.floor(F.col("place") / block_languages).cast("int").alias("block"))
    return Languages(staged(counts.join(block, "lang"), "language-blocks"), -(-n // block_languages))


def scored(df: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """keep, then _bits, _lang, _mass and _size: the shortest code, its language, the sum of 2 ** (_bits - bits) over the languages, and the text's bytes; null _bits for texts without a letter."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        names = pa.array(own.languages, pa.string())
        for whole in batches:
            for batch in slices(whole, text):
                col = batch.column(text)
                data, offsets = flat(col)
                bits = own.code_lengths(data, offsets)
                known = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best = bits.argmin(1)
                least = bits[np.arange(best.size), best]
                mass = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(least, mask=~known), names.take(pa.array(best)), pa.array(mass), pa.array(np.diff(offsets))], [*keep, "_bits", "_lang", "_mass", "_size"])

    arrow_rows(df.sparkSession)
    made = [T.StructField("_bits", T.DoubleType()), T.StructField("_lang", T.StringType()), T.StructField("_mass", T.DoubleType()), T.StructField("_size", T.LongType())]
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *made]))


def predict(df: DataFrame, languages: Languages, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """df with the language, its posterior, and the bits of a byte in it."""
    taken = {x.lower() for x in names}
    cols = [c for c in df.columns if c.lower() not in taken]
    if not languages.blocks:
        return df.select(*cols, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(None).cast("double").alias(names[2]))
    others = [F.col(c) for c in cols if c != text] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*others).alias("_row"), F.col(text).alias("_text"))
    back = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in cols]
    known = F.col("_bits").isNotNull()
    made = [F.when(known, F.col("_lang")).otherwise(UNKNOWN).alias(names[0]), F.when(known, 1 / F.col("_mass")).otherwise(0.0).alias(names[1]), (F.col("_bits") / F.greatest("_size", F.lit(1))).alias(names[2])]
    if languages.blocks == 1:
        return scored(rows, next(languages.models()), "_text", ["_row", "_text"]).select(*back, *made)
    rows = staged(rows.withColumn("_id", F.monotonically_increasing_id()), "language-rows")
    parts = [scored(rows, m, "_text", ["_id"]) for m in languages.models()]
    every = staged(reduce(DataFrame.unionByName, parts), "language-bits")
    least = every.groupBy("_id").agg(F.min(F.struct("_bits", "_lang")).alias("_best"), F.max("_size").alias("_size"), F.collect_list(F.struct("_bits", "_mass")).alias("_all"))  # as many as there are blocks
    mass = F.aggregate("_all", F.lit(0.0), lambda a, x: a + x["_mass"] * F.pow(F.lit(2.0), F.greatest(F.col("_best._bits") - x["_bits"], F.lit(-1000.0))))
    return rows.join(least, "_id").select("_row", "_text", "_best.*", "_size", mass.alias("_mass")).select(*back, *made)


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = train(docs.where(remainder(F.col("doc_id")) != 2))
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), languages).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
