"""Near-duplicates by similarity: the pipeline's stage on word shingles, on top of operator 8.

Two texts are near copies if their sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more. Operator 8's fingerprints
and anchors, here over the sets of five-word shingles, give the first candidates: all texts of a class are held against its least. Texts near 0.8 differ in far more
bits than anchors can bridge, so further candidates are texts that share one of BANDS bands of ROWS
MinHash values each: at a similarity of s a pair is missed with a chance of (1 - s^ROWS)^BANDS, 3 in a million at 0.8. Every candidate
is then held against the exact similarity, so no pair below it is linked.

Equal sets collapse at once. At each band all texts are held against the most central one there, that which shares most bands with others: of a text
and its edited copies, which are often nearer to it than to each other, that is the text, so a large group costs its members, not its pairs. Texts
of a band that still lie in different components meet in one task, in blocks: counts of hashed shingles bound from above how many two texts share, only pairs
that may be near copies are held against each other exactly, and only links that join two components are passed on. A band with very many such texts is split:
each has a part of its own and visits those after it. Shingles are written for candidates alone.

Defined results: texts without a word, and null, have the empty set and are copies of each other; fewer words are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomgraph.llm import simhash
from loomgraph.llm.simhash import majority, shingle_hashes
from loomgraph.llm.texts import arrow_rows, slices
from loomgraph.operators.components import stars
from loomgraph.session import staged

SHINGLE, SEED, BANDS, ROWS = 5, 42, 32, 5
#: Texts of a band, or a part of one, that meet in a task, about; a visitor of a split band comes on top.
MOST_TEXTS = 2048
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size, SEED), np.uint64))


def band_values(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's MinHash values, for sets that aren't empty."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, bands * rows, np.uint64) << np.uint64(1) | np.uint64(1)
    mask = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    n = np.array([x.size for x in sets])
    hashes, starts = np.concatenate(sets), np.cumsum(n) - n
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        own = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            own = (own ^ np.minimum.reduceat((hashes ^ mask[k]) * factor[k], starts)) * np.uint64(0x9E3779B97F4A7C15)
            own ^= own >> np.uint64(29)
        out[:, band] = own
    return out


def sketches(df: DataFrame, size: int) -> DataFrame:
    """_id, _mark, none, node (a hash of the set), n, fp (its fingerprint) and bands of each row."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                sets = [shingle_set(t, size) for t in batch.column("_text").to_pylist()]
                some = [x for x in sets if x.size]
                values = iter(band_values(some).view(np.int64).tolist() if some else [])
                node = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                bands = pa.array([next(values) if x.size else [] for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(node), pa.array([x.size for x in sets], pa.int32()), pa.array(majority(sets).view(np.int64)), bands], [*keep, "node", "n", "fp", "bands"])

    keep = ["_id", "_mark", "none"]
    arrow_rows(df.sparkSession)
    return df.select(*keep, "_text").mapInArrow(run, "_id long, _mark long, none boolean, node long, n int, fp long, bands array<long>")


def shingles(df: DataFrame, size: int) -> DataFrame:
    """node and its shingles; df: node, _text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "_text", 2 << 20):
                sets = [shingle_set(t, size).view(np.int64) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    arrow_rows(df.sparkSession)
    return df.select("node", "_text").mapInArrow(run, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are near copies."""
    most, of = similarity
    own = lambda c, s: sets.select(F.col("node").alias(c), F.col("shingles").alias(s))
    shared = F.size(F.array_intersect("x", "y"))
    found = pairs.join(own("a", "x"), "a").join(own("b", "y"), "b").select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("n"))
    return found.where(of * F.col("s").cast("long") >= most * (F.col("n") - F.col("s")).cast("long")).select("a", "b")


def near_pairs(sets: list[np.ndarray], roots: np.ndarray, visits: np.ndarray, similarity: tuple[int, int], block: int = 256) -> list[tuple[int, int]]:
    """Links (i, j) of near copies that join the components of texts with different roots. Pairs of two visitors aren't looked at."""
    most, of = similarity
    n = np.array([x.size for x in sets])
    parent = {r: r for r in roots.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    width = 1 << max(8, int(4 * n.max()).bit_length())
    counts = lambda lo, hi: np.stack([np.bincount((x >> np.uint64(7)).astype(np.int64) & width - 1, minlength=width) for x in sets[lo:hi]]).astype(np.float32)
    out = []
    for a in range(0, len(sets), block):
        left = counts(a, a + block)
        for b in range(0, a + 1, block):
            right = left if b == a else counts(b, b + block)
            shared = left @ right.T  # at least as many as are shared
            both = n[a : a + block, None] + n[None, b : b + block]
            for i, j in zip(*np.nonzero(of * shared >= most * (both - shared)), strict=True):
                i, j = a + int(i), b + int(j)
                if j >= i or visits[i] and visits[j] or (x := find(int(roots[i]))) == (y := find(int(roots[j]))):
                    continue
                s = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if of * s >= most * (n[i] + n[j] - s):
                    parent[x] = y
                    out.append((i, j))
    return out


def apart(rooted: DataFrame, sets: DataFrame, similarity: tuple[int, int], most_texts: int = MOST_TEXTS) -> DataFrame:
    """(a, b): links between texts of one band that lie in different components. rooted: (band, node, n, root)."""
    open_ = rooted.groupBy("band").agg(F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band", F.ceil(F.col("texts") / most_texts).cast("int").alias("parts"))
    own = F.pmod(F.hash("node"), F.col("parts"))
    placed = rooted.join(open_, "band").select("band", "node", "root", "parts", own.alias("own"))
    spread = placed.select("band", "node", "root", "own", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("part")).withColumn("visits", F.col("part") != F.col("own"))
    rows = spread.join(sets, "node").select("band", "part", "visits", "node", "root", "shingles")

    def run(batches):
        last, held = None, []

        def links():
            found = near_pairs([h[3] for h in held], np.array([h[2] for h in held]), np.array([h[0] for h in held]), similarity) if len({h[2] for h in held}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i, _ in found], pa.int64()), pa.array([held[j][1] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            where = zip(batch.column("band").to_pylist(), batch.column("part").to_pylist(), strict=True)
            rest = zip(batch.column("visits").to_pylist(), batch.column("node").to_pylist(), batch.column("root").to_pylist(), batch.column("shingles"), strict=True)
            for at, (visits, node, root, own) in zip(where, rest, strict=True):
                if at != last:
                    if held:
                        yield links()
                    last, held = at, []
                held.append((visits, node, root, own.values.to_numpy().view(np.uint64)))
        if held:
            yield links()

    return rows.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(run, "a long, b long")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of df for each component of near copies: that with the smallest key, nulls last, and among equal keys by a hash of the text."""
    most, of = similarity
    own = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(F.col(key).isNull(), F.col(text)).alias("_mark"))
    texts = df.select(F.coalesce(F.col(key), F.lit(0)).alias("_id"), F.xxhash64(F.col(key).isNull(), F.col(text)).alias("_mark"), F.col(key).isNull().alias("none"), F.col(text).alias("_text"))
    rows = staged(sketches(texts, size), "sketches")
    nodes = staged(rows.groupBy("node").agg(F.min(F.struct("none", "_id", "_mark")).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-sets")
    sized = nodes.select(F.col("node").alias("least"), F.col("n").alias("n_least"))
    fits = lambda x, y: of * F.least(x, y).cast("long") >= most * F.greatest(x, y).cast("long")
    against = lambda x: x.where("node <> least").select("node", "n", "least").distinct().join(sized, "least").where(fits(F.col("n"), F.col("n_least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    # Operator 8's classes.
    classes = stars(simhash.links(staged(nodes.select("fp").distinct(), "set-fingerprints")))
    rooted = nodes.join(classes, F.col("fp") == F.col("a"), "left").select("node", "n", F.coalesce("b", "fp").alias("root"))
    fewest = rooted.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    near = staged(against(rooted.join(fewest, "root")), "fingerprint-candidates")
    bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    sizes = staged(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "shared-bands")
    met = staged(bands.join(sizes, "band"), "band-texts")
    central = met.groupBy("node").agg(F.sum("members").alias("met"))
    order = F.struct(-F.col("met"), F.col("node"))
    pivots = met.select("band", "node").join(central, "node").groupBy("band").agg(F.min_by("node", order).alias("least"))
    members = staged(met.select("band", "node", "n").join(pivots, "band"), "band-members")
    wanted = members.select("node").union(near.select("a")).union(near.select("b")).distinct().join(nodes, "node").select("node", "least._id", "least._mark")
    sets = staged(shingles(texts.join(wanted, ["_id", "_mark"]).select("node", "_text"), size).dropDuplicates(["node"]), "candidate-shingles")
    first = staged(against(members).union(near).distinct(), "candidates")
    edges = stars(similar(first, sets, similarity))
    rooted = staged(members.join(edges, F.col("node") == F.col("a"), "left").select("band", "node", "n", F.coalesce("b", "node").alias("root")), "rooted-members")
    edges = stars(edges.union(apart(rooted, sets, similarity)))
    named = nodes.join(edges, F.col("node") == F.col("a"), "left").groupBy(F.coalesce("b", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = staged(named.select("least._id", "least._mark").distinct(), "representatives")
    # Both sides are spread by the row's own key, so copies are not together; equal rows are made one where they meet.
    return own.join(kept, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"]).select("row.*")
