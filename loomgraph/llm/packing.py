"""Operator 9: packing documents into sequences of fixed capacity, by dominance reduction and best fit.

A document longer than the capacity is cut into full pieces behind a first, shorter one. Packing needs only how many pieces
there are of each length, a histogram with as many bins as the capacity has tokens whatever the corpus holds. On it:

1. Martello-Toth reduction: going down the lengths, a sequence is fixed for good where its set of pieces dominates every other
   set that could hold the same longest piece: it fills the sequence exactly with one partner; or nothing else fits; or one more
   piece at most fits, and the longest that does is taken; or two more at most fit, and no pair is longer than the longest single.
2. Best fit, longest first, packs what is left.

Equal lengths are handled in bulk, so the plan is a short list of (lengths of a sequence, number of such sequences). Spark then
numbers the pieces of each length (counts by length and hash bucket, offsets, a rank in each bucket: a length that holds
a third of all pieces is spread over the buckets) and each piece looks its number up in the plan.

Defined results: null and empty texts are one piece that holds the end id alone; repeated rows are packed each; an empty table
gives no rows; other columns aren't carried.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bpe
from loomgraph.llm.texts import arrow_rows, slices
from loomgraph.session import staged, table

CAPACITY, END_ID = 1024, 2
#: Pieces of one length that meet in a bucket, about.
BUCKET_ROWS = 2000

Plan = list[tuple[tuple[int, ...], int]]


def reduce_dominated(counts: list[int], capacity: int) -> Plan:
    """Fixes sequences whose sets dominate all others; takes their pieces out of counts (counts[n]: pieces of length n)."""
    fixed: Plan = []

    def fix(j: int, i: int | None) -> None:
        m = counts[j] if i is None else counts[j] // 2 if i == j else min(counts[j], counts[i])
        counts[j] -= m
        if i is not None:
            counts[i] -= m
        fixed.append(((j,) if i is None else (j, i), m))

    def smallest(k: int, without: int) -> list[int]:
        """The k shortest pieces, one of length `without` left out."""
        out: list[int] = []
        for n in range(1, capacity + 1):
            have = counts[n] - (n == without)
            out += [n] * min(have, k - len(out))
            if len(out) == k:
                break
        return out

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                room = capacity - j
                least = smallest(3, j)
                if not least or least[0] > room:
                    fix(j, None)
                    changed = True
                    continue
                if room > 0 and counts[room] - (room == j) > 0:
                    fix(j, room)
                    changed = True
                    continue
                best = next(n for n in range(room, 0, -1) if counts[n] - (n == j) > 0)
                if len(least) < 2 or least[0] + least[1] > room or (len(least) < 3 or sum(least) > room) and best >= best_pair(counts, j, room):
                    fix(j, best)
                    changed = True
                    continue
                break
    return fixed


def best_pair(counts: list[int], without: int, room: int) -> int:
    """The longest two pieces together that fit, one of length `without` left out; 0 if no two do."""
    sizes = [n for n in range(1, room) if counts[n] - (n == without) > 0]
    best, a, b = 0, 0, len(sizes) - 1
    while a <= b:
        if sizes[a] + sizes[b] > room:
            b -= 1
        elif a == b and counts[sizes[a]] - (sizes[a] == without) < 2:
            break
        else:
            best = max(best, sizes[a] + sizes[b])
            a += 1
    return best


def best_fit(counts: list[int], capacity: int) -> Plan:
    """Best fit by falling length, equal sequences in bulk; empties counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []  # those of open_, ascending
    done: Plan = []

    def put(pattern: tuple[int, ...], m: int, room: int) -> None:
        if m and room:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((pattern, m))
        elif m:
            done.append((pattern, m))

    for n in range(capacity, 0, -1):
        left, counts[n] = counts[n], 0
        while left:
            k = bisect.bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms[k]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            else:
                pattern, m, room = (), left, capacity
            each = room // n
            full = min(m, left // each)
            put(pattern + (n,) * each, full, room - each * n)
            left -= full * each
            rest = m - full
            if rest and left:
                put(pattern + (n,) * left, 1, room - left * n)
                left, rest = 0, rest - 1
            if pattern:
                put(pattern, rest, room)
    return done + [x for own in open_.values() for x in own]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Sequences for so many pieces of each length."""
    left = [0] * (capacity + 1)
    for n, m in counts.items():
        left[n] = m
    out: Plan = [((capacity,), left[capacity])] if left[capacity] else []
    left[capacity] = 0
    return out + reduce_dominated(left, capacity) + best_fit(left, capacity)


def slots(own: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length << 40 | number of the first piece, its sequence, offset), ascending: runs of equal places, each a piece and a sequence further."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, m in own:
        offset = 0
        for n in pattern:
            rows.append((n << 40 | used[n], sequence, offset))
            used[n] += m
            offset += n
        sequence += m
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length and ids_crc32 of each document's pieces."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = bpe.encode_column(batch.column("text"), path, end_id)
                sizes = np.diff(at)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(n.size), n)
                piece = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
                first = sizes - (n - 1) * capacity
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                begin = at[row] + start
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [key, "piece", "start", "length", "ids_crc32"])

    arrow_rows(df.sparkSession)
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def pack(made: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of lengths 1 to capacity. made is read three times: give a table or a staged frame."""
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length at most
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    keys, sequences, offsets = slots(plan(counts, capacity))
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    made = made.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    # Buckets are summed by shelves of BUCKET_ROWS, so a length of very many pieces takes no long window.
    shelf = F.floor(F.col("_bucket") / BUCKET_ROWS).alias("_shelf")
    counted = staged(made.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("*", shelf), "packing-buckets")
    running = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy("length", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shelves = counted.groupBy("length", "_shelf").agg(F.sum("_n").alias("_n")).select("length", "_shelf", running("_shelf").alias("_first"))
    before = counted.withColumn("_inside", running("_shelf", "_bucket")).join(shelves, ["length", "_shelf"]).select("length", "_bucket", (F.col("_first") + F.col("_inside")).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")
    ranked = made.withColumn("_rank", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"]).select(*[c for c in made.columns if c != "_bucket"], (F.col("_before") + F.col("_rank")).alias("_rank"))
    columns = [c for c in ranked.columns if c != "_rank"]

    def run(batches):
        for batch in batches:
            want = batch.column("length").to_numpy() << 40 | batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequences[k] + (want - keys[k])), pa.array(offsets[k])], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*(ranked.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces of df's documents with their places. The pieces are staged, so that texts are encoded once."""
    return pack(staged(pieces(df, key, text, capacity, path, end_id), "pieces"), key, capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
