"""Operator 10: documents as ids in binary shards, their boundaries in Elias-Fano form.

Documents go in ascending order of key over tasks by range (a key with many rows is split by a hash of the text) and each task
writes shards: one array of ids, two bytes each where the vocabulary allows, and two monotone sequences in Elias-Fano form, the
ends of the documents and their keys. A monotone sequence of n values below u takes about 2 + log2(u / n) bits a value, against
64 in a table of offsets; every SAMPLE-th one bit of the upper half has its place noted, so select(i) reads a few bytes.

A shard is a row of a Parquet table: any store that Spark writes takes it, commits are Spark's own, and a lost executor costs
the tasks that it ran. Reading back needs the ids of earlier tasks, a number for each task that wrote.

Defined results: null and empty texts hold the end id alone; null keys come first; rows with equal keys follow each other in the
order of their texts' hashes; an empty table gives no shards; other columns aren't carried.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bpe
from loomgraph.llm.texts import arrow_rows, slices
from loomgraph.session import fresh_path, table

END_ID = 2
#: Ids in a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 16
SAMPLE = 64
FIELDS = "part int, shard int, before long, n_docs int, n_nulls int, least long, width int, keys_low binary, keys_high binary, keys_bits int, keys_at binary, ends_low binary, ends_high binary, ends_bits int, ends_at binary, ids binary"


@dataclass
class EliasFano:
    """Values v0 <= v1 <= ... >= 0: the lowest `bits` bits of each, and the rest as gaps in unary."""

    n: int
    bits: int
    low: bytes
    high: bytes
    at: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = v.size
        bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = (v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        a = i * self.bits
        word = int.from_bytes(self.low[a // 8 : (a + self.bits + 7) // 8], "little")
        return word >> a % 8 & (1 << self.bits) - 1

    def select(self, i: int) -> int:
        """Value i, from the sample before it and a few bytes after."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int.from_bytes(self.at[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        left, byte = i % SAMPLE, place // 8
        word = self.high[byte] >> place % 8 << place % 8
        while (have := word.bit_count()) <= left:
            left -= have
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.bits, bitorder="little").reshape(self.n, self.bits)
        return ((ones - np.arange(self.n)) << self.bits) + low.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the texts of df as shards under path, in ascending order of key (a whole number)."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        width = 2 if max(bpe.tokenizer(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys: list[np.ndarray] = []
        nulls, ids, sizes = 0, [], []

        def row():
            nonlocal shard, before, nulls
            own, all_ids = np.concatenate(keys), np.concatenate(ids)
            ends = np.cumsum(np.concatenate(sizes))
            least = int(own[0]) if own.size else 0
            k, e = EliasFano.of((own - least).astype(np.uint64)), EliasFano.of(ends)
            out = [part, shard, before, ends.size, nulls, least, width, k.low, k.high, k.bits, k.at, e.low, e.high, e.bits, e.at, all_ids.astype(f"<u{width}").tobytes()]
            shard, before, nulls = shard + 1, before + all_ids.size, 0
            keys.clear(), ids.clear(), sizes.clear()
            return out

        rows: list[list] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                own, at = bpe.encode_column(batch.column("text"), vocabulary, end_id)
                col = batch.column("key").cast(pa.int64())
                cuts = [0]
                for i in range(1, len(col)):
                    if at[i] - at[cuts[-1]] >= shard_ids:
                        cuts.append(i)
                for a, b in zip(cuts, [*cuts[1:], len(col)], strict=True):
                    piece = col.slice(a, b - a)
                    nulls += piece.null_count
                    keys.append(piece.drop_null().to_numpy())
                    ids.append(own[at[a] : at[b]])
                    sizes.append(np.diff(at[a : b + 1]))
                    if sum(x.size for x in ids) >= shard_ids:
                        rows.append(row())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], SCHEMA)
                rows = []
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], SCHEMA)

    arrow_rows(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spread = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("key", "_tie").sortWithinPartitions("key", "_tie").drop("_tie")
    spread.mapInArrow(run, FIELDS).write.parquet(path)


KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(n, KINDS[k]) for n, k in (f.split() for f in FIELDS.split(", "))])


def sequence(row: dict, name: str, n: int) -> EliasFano:
    return EliasFano(n, *(row[f"{name}_{x}"] for x in ("bits", "low", "high", "at")))


def offsets_before(shards: DataFrame) -> dict[int, int]:
    """The ids before each task's first shard: a number for each task that wrote."""
    before, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.max("before").alias("a"), F.max_by(F.octet_length("ids") / F.col("width"), "before").cast("long").alias("b")).collect()):
        before[r.part] = total
        total += r.a + r.b
    return before


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids of the documents with the given keys (every row of a repeated key); keys without a document give none.

    A shard is met by the keys between its least and its last; select finds each by bisection and reads its two boundaries, without decoding the others.
    """
    shards = spark.read.schema(FIELDS).parquet(path)
    before = offsets_before(shards)
    last = F.udf(lambda *x: x[0] + EliasFano(x[1] - x[2], *x[3:]).select(x[1] - x[2] - 1) if x[1] > x[2] else None, "long")
    spans = shards.select("part", "shard", "least", last("least", "n_docs", "n_nulls", "keys_bits", "keys_low", "keys_high", "keys_at").alias("last")).where("last IS NOT NULL")
    # Keys meet shards by the buckets of their values that both lie in.
    wide = spans.agg(F.max(F.col("last") - F.col("least"))).first()[0]
    if wide is None:
        return spark.createDataFrame([], f"{key} long, start long, n_tokens long, ids array<int>")
    step = F.lit(wide + 1)
    held = spans.select("part", "shard", "least", "last", F.explode(F.array_distinct(F.array(F.floor(F.col("least") / step), F.floor(F.col("last") / step)))).alias("bucket"))
    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key IS NOT NULL").distinct().withColumn("bucket", F.floor(F.col("key") / step))
    found = wanted.join(held, "bucket").where("key BETWEEN least AND last").groupBy("part", "shard").agg(F.collect_list("key").alias("wanted"))  # at most the keys of a shard

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own, ends = sequence(r, "keys", r["n_docs"] - r["n_nulls"]), sequence(r, "ends", r["n_docs"])
                ids, rows = np.frombuffer(r["ids"], f"<u{r['width']}"), []
                for k in sorted(r["wanted"]):
                    i = bisect.bisect_left(range(own.n), k - r["least"], key=own.select)
                    while i < own.n and own.select(i) == k - r["least"]:
                        at = i + r["n_nulls"]
                        a, b = ends.select(at - 1) if at else 0, ends.select(at)
                        rows.append({key: k, "start": a + r["before"] + before[r["part"]], "n_tokens": b - a, "ids": ids[a:b].tolist()})
                        i += 1
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    arrow_rows(spark)
    return shards.join(found, ["part", "shard"]).mapInArrow(run, f"{key} long, start long, n_tokens long, ids array<int>")


def read(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids_crc32 of each document in the shards under path, and its ids if asked for."""
    shards = spark.read.schema(FIELDS).parquet(path)
    before = offsets_before(shards)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ends = sequence(r, "ends", r["n_docs"])
                ends = np.fromiter(map(ends.select, range(ends.n)), np.int64, ends.n)
                keys = sequence(r, "keys", r["n_docs"] - r["n_nulls"])
                keys = np.fromiter(map(keys.select, range(keys.n)), np.int64, keys.n) + r["least"]
                starts = np.append(0, ends[:-1])
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                named = [*[None] * r["n_nulls"], *keys.tolist()]
                columns = [pa.array(named, pa.int64()), pa.array(starts + r["before"] + before[r["part"]]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    arrow_rows(spark)
    return shards.mapInArrow(run, ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
