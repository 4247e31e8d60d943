"""Operator 8: near-duplicates by SimHash fingerprints, found with anchor points of a covering code.

Fingerprints: a bit is 1 if more than half of a text's shingle hashes have it. Equal fingerprints collapse at once, so
copies cost nothing later. Two fingerprints of 64 bits that differ in at most 4 agree, up to one bit, in one of three sections.
In a section the anchors are the words of a covering code: a Hamming code, whose radius is 1, on 15 of its bits and all values of the
other bits. A fingerprint is at home at its nearest anchor and visits every other anchor that is home to a value within the section's
threshold of its own; all of those lie within radius plus threshold. Two near fingerprints therefore meet at an anchor. At each anchor
all rows are compared with its homes, in blocks of numpy, and only a star for each set of linked rows is
passed on, so a large group of near copies yields as many rows as it has members, not its pairs. Anchors with very many homes are
split: homes by a hash, visitors to each part. Components of the stars are the classes.

Defined results: texts without a word, and null, have fingerprint zero and are linked like any other; repeated rows each get a
row; a class is named by its smallest doc_id, nulls aside (null if it has no other).
"""

from __future__ import annotations

import functools
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from loomgraph.llm.texts import arrow_rows, joined, slices
from loomgraph.operators.components import stars
from loomgraph.session import staged, table

SHINGLE, SEED, DISTANCE, SECTIONS = 4, 42, 4, 3
#: Homes that an anchor, or a part of a split anchor, has at most, about; pairs compared at once.
MOST_HOMES, BLOCK_PAIRS = 2048, 1 << 20
#: Split anchors that a broadcast may hold; more go by a shuffled join.
MOST_BROADCAST = 50_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """The hashes of the word shingles, repeats included; fewer words are one shingle."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(line, seed)]
    ends = [*accumulate((len(w) + 1 for w in words), initial=0)]
    return [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(ends, ends[size:], strict=False)]


def majority(sets: list) -> np.ndarray:
    """The fingerprint of each list of hashes: a bit is 1 if more than half have it; zero for an empty one."""
    n = np.array([len(x) for x in sets])
    some = np.flatnonzero(n)
    out = np.zeros(n.size, np.uint64)
    if some.size:
        hashes = np.concatenate([np.asarray(sets[i], "<u8") for i in some.tolist()])
        starts = (np.cumsum(n) - n)[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64) * 2 > n[some, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """df without its text, with the fingerprint as a long."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                out = majority([shingle_hashes(t, size, seed) for t in batch.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out.view(np.int64))], [*keep, name])

    keep = [c for c in df.columns if c not in (text, name)]
    arrow_rows(df.sparkSession)
    return df.select(*keep, text).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.LongType())]))


@functools.cache
def code(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of 15 bits: its codeword, and the codewords of all words within so many bits, -1 where one comes again."""
    words = np.arange(1 << 15)
    syndrome = np.zeros_like(words)
    for i in range(15):
        syndrome ^= np.where(words >> i & 1, i + 1, 0)
    home = np.where(syndrome, words ^ (1 << np.maximum(syndrome, 1) - 1), words)
    near = words[:, None]
    for _ in range(threshold):
        near = np.concatenate([near, *(near ^ 1 << i for i in range(15))], axis=1)
        near = np.unique(near ^ words[:, None])[None, :] ^ words[:, None]
    found = np.sort(home[near], axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return home, found[:, (found >= 0).any(0)] if threshold else found


def anchors(fps: np.ndarray, distance: int = DISTANCE, sections: int = SECTIONS, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it visits) for every anchor that a fingerprint is replicated to."""
    edges = [64 * i // sections for i in range(sections + 1)]
    threshold = distance // sections
    out = []
    for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        value = (fps >> np.uint64(a) & np.uint64((1 << b - a) - 1)).astype(np.int64)
        free, word = value >> 15, value & 0x7FFF
        flips = [0]
        for _ in range(threshold):
            flips = sorted({f ^ 1 << i for f in flips for i in range(b - a - 15)} | set(flips))
        home = code(0)[0][word]
        base = s << 50
        own = base | free << 15 | home
        out.append((np.arange(fps.size), own, np.zeros(fps.size, bool)))
        if homes_only:
            continue
        for f in flips:
            near = code(threshold - f.bit_count())[1][word]
            anchor = base | (free ^ f)[:, None] << 15 | near
            i, j = np.nonzero((near >= 0) & (anchor != own[:, None]))
            out.append((i, anchor[i, j], np.ones(i.size, bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def replicated(distinct: DataFrame, name: str, distance: int, sections: int, homes_only: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(name).to_numpy().view(np.uint64)
            i, anchor, visits = anchors(fps, distance, sections, homes_only)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(visits), pa.array(fps[i].view(np.int64))], ["anchor", "visits", "fp"])

    return distinct.select(name).mapInArrow(run, "anchor long, visits boolean, fp long")


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node linked with it) for pairs of linked nodes."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.split(at, 2)
    label = np.arange(nodes.size)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[other], nodes[label[other]]


def linked(group: np.ndarray, visits: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at sorted anchors (homes first in each group): each row against the homes before it."""
    n = fps.size
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, n)))
    homes = np.repeat(np.add.reduceat((~visits).astype(np.int64), first), np.diff(np.append(first, n))) if n else first
    partners = np.minimum(np.arange(n) - start, homes)
    ends = np.cumsum(partners)
    found_a, found_b, lo = [], [], 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, "right")))
        row = np.repeat(np.arange(lo, hi), partners[lo:hi])
        home = start[row] + np.arange(row.size) - (ends[row] - partners[row] - done)
        near = np.bitwise_count(fps[row] ^ fps[home]) <= distance
        if near.any():
            a, b = local_stars(fps[row[near]], fps[home[near]])
            found_a.append(a), found_b.append(b)
        lo = hi
    if not found_a:
        return (np.zeros(0, np.uint64),) * 2
    return local_stars(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, name: str = "fp", distance: int = DISTANCE, sections: int = SECTIONS, most_homes: int = MOST_HOMES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(a, b): edges with the same components as all pairs of fingerprints within the distance. distinct: a column of distinct ones."""
    spread = replicated(distinct, name, distance, sections)
    # Counted exactly, over all homes: nearly always none is that large.
    hot = staged(replicated(distinct, name, distance, sections, True).groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most_homes).select("anchor", F.ceil(F.col("n") / most_homes).cast("int").alias("parts")), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        spread = spread.join(F.broadcast(hot) if n_hot <= most_broadcast else hot, "anchor", "left")
        parts = F.coalesce("parts", F.lit(1))
        part = F.when(F.col("visits"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.hash("fp"), parts)))
        # Homes of different parts meet too: each home visits the parts after its own.
        after = F.when(~F.col("visits"), F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x > F.pmod(F.hash("fp"), parts))).otherwise(F.array().cast("array<int>"))
        own = F.transform(part, lambda p: F.struct(p.alias("part"), F.col("visits").alias("visits")))
        more = F.transform(after, lambda p: F.struct(p.alias("part"), F.lit(True).alias("visits")))
        spread = spread.select("anchor", "fp", F.inline(F.concat(own, more)))
    else:
        spread = spread.withColumn("part", F.lit(0))

    def run(batches):
        held, last, seen = None, None, 0
        for batch in joined(batches):
            # The rows of a task come in order, so a running number of (anchor, part) tells groups apart.
            anchor, piece = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            goes_on = held is not None and anchor.size and last == (anchor[0], piece[0])
            new = np.append(not goes_on, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))[: anchor.size]
            number, last = seen + np.cumsum(new), (anchor[-1], piece[-1]) if anchor.size else last
            anchor, seen = number, int(number[-1]) if anchor.size else seen
            visits, fps = batch.column("visits").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)
            if goes_on:
                anchor, visits, fps = (np.concatenate(x) for x in zip(held, (anchor, visits, fps), strict=True))
            a, b = linked(anchor, visits, fps, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            if anchor.size:
                own = (anchor == anchor[-1]) & ~visits
                held = (anchor[own], visits[own], fps[own]) if own.any() else None

    columns = ["anchor", "part", "visits", "fp"]
    return spread.select(*columns).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visits").mapInArrow(run, "a long, b long").distinct()


def grouped(rows: DataFrame, least, distance: int, sections: int) -> DataFrame:
    """(own, rows, root, least): every distinct fingerprint in rows, how many have it, and the least value, of an aggregate over rows, in its component."""
    distinct = staged(rows.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("rows")), "distinct-fingerprints")
    linked_to = stars(links(distinct, "fp", distance, sections))
    rooted = staged(distinct.join(linked_to, F.col("fp") == F.col("a"), "left").select("fp", "least", "rows", F.coalesce("b", "fp").alias("root")), "rooted")
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("least")).withColumnRenamed("root", "of"), "named")
    return rooted.select("fp", "rows", "root").join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("own"), "rows", "root", "least")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, sections: int = SECTIONS) -> DataFrame:
    """key, fingerprint and component_id of every row."""
    rows = staged(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text"))), "fingerprints")
    named = staged(grouped(rows, F.col("key"), distance, sections), "named-fingerprints")
    # Fingerprints of a thousandth of all rows or more are a thousand at most: those are broadcast, the others meet their rows by a shuffle.
    many = F.col("rows") * 1000 >= F.lit(rows.count())
    common = F.broadcast(named.where(many).select(F.col("own").alias("hot"), F.col("least").alias("hot_least")))
    marked = rows.join(common, F.col("fp") == F.col("hot"), "left")
    rest = marked.where("hot IS NULL").join(named.where(~many), F.col("fp") == F.col("own")).select("key", "fp", "least")
    return marked.where("hot IS NOT NULL").select("key", "fp", F.col("hot_least").alias("least")).unionByName(rest).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, sections: int = SECTIONS) -> DataFrame:
    """One row of df for each component: that with the smallest key, nulls last, and among equal keys by a hash of the text."""
    marks = [F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(F.col(key).isNull(), F.col(text)).alias("_mark")]
    own = df.select(F.struct(*df.columns).alias("row"), *marks)
    rows = staged(fingerprints(df.select(F.col(key).alias("key"), *marks, F.col(text).alias("text"))), "fingerprints")
    least = F.struct(F.col("key").isNull().alias("none"), F.col("_id"), F.col("_mark"))
    kept = staged(grouped(rows, least, distance, sections).select("least._id", "least._mark").distinct(), "representatives")
    # Both sides are spread by the row's own key, so copies are not together; equal rows are made one where they meet.
    return own.join(kept, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
