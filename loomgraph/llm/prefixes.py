"""Operator 12: a prefix trie of rebuilt conversations, in succinct shards.

Turns are numbered, and a conversation's prefixes named, by running sums over rows in order, dealt by range: a conversation that
holds much of the table is spread over tasks, and only a sum for each task is carried on. A prefix of d turns is
named by d and the sums of its turns' hashes times powers of four bases modulo a prime (124 bits; the turns' hashes are SHA-256, so a
chance meeting of two of n prefixes has a probability of about n squared / 2 ** 125).

Prefixes of the same members form a chain without a branch; a chain is one edge of the trie, so the trie grows with the number of different
conversations and not with their length. Chains are dealt to shards by the prefix that they hang below. A prefix with more than a
share of all chains below it is heavy: it goes to the upper levels and its children head shards of their own, until no shard is
heavy. A shard is a LOUDS bitvector (a one for each child, a zero after each node, in level order) with arrays of labels; its sums of
leaves and tokens run backwards over the levels, with add.at into parents. The upper levels are a trie of the same kind, whose nodes
begin with the sums of the shards below.

Defined results: rows with a null conversation number belong to none and are left out; turns go by (turn, null first; role; text), null role
and text being empty; the parent number c - c % 5 takes SQL's remainder, with the sign of c; repeated rows are turns of their own;
an empty table gives no node; other columns aren't carried.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.texts import batches_of
from loomgraph.session import staged, table

EVERY, MOST_SHARED = 5, 9
PRIME = (1 << 31) - 1
BASES = (1_402_946_153, 620_089_373, 1_855_123_901, 977_254_423)
#: A prefix with more than this part of all chains below it is heavy, but none with fewer than LEAST_HEAVY.
PARTS, LEAST_HEAVY = 256, 1024
SHARD_CHAINS = 1 << 16
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def powers(bases: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """bases ** exponents modulo PRIME, a row for each exponent."""
    out, square, left = np.ones((exponents.size, bases.size), np.uint64), np.broadcast_to(bases.astype(np.uint64), (exponents.size, bases.size)).copy(), exponents.astype(np.uint64)
    while left.any():
        out = np.where((left & np.uint64(1))[:, None] == 1, out * square % np.uint64(PRIME), out)
        square = square * square % np.uint64(PRIME)
        left = left >> np.uint64(1)
    return out


def named(sums: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sums), [None, pa.py_buffer(np.ascontiguousarray(sums.astype(">u4")))]).cast(pa.binary())


SCANNED = "part int, conv long, label binary, depth long, s0 long, s1 long, s2 long, s3 long, x0 long, x1 long, x2 long, x3 long, bytes long, total long"


def scan(rows: DataFrame, order: list, ties: list) -> DataFrame:
    """rows (conv, label, bytes, ...) in the order of conv, order and then ties, of which order alone deals them to tasks, with depth (from 1), key and parent (the names of the prefixes with and without the row), and total (bytes so far)."""
    bases = np.array(BASES, np.uint64)

    def local(batches):
        """Sums within a task, as if a conversation began in it."""
        part = TaskContext.get().partitionId()
        conv, depth, sums, total = None, 0, np.zeros(4, np.uint64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, n = batch.column("conv").to_numpy(), batch.column("bytes").to_numpy()
            x = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u4").reshape(-1, 4).astype(np.uint64) % np.uint64(PRIME)
            head = np.append(True, own[1:] != own[:-1])
            at = np.flatnonzero(head)
            group = np.cumsum(head) - 1
            go_on = own[0] == conv
            place = np.arange(own.size) - at[group] + 1 + np.where(group == 0, depth * go_on, 0)
            term = x * powers(bases, place) % np.uint64(PRIME)
            run, size = np.cumsum(term, axis=0), np.cumsum(n)
            run = run - np.where((at[group] > 0)[:, None], run[at[group] - 1], 0) + np.where((group == 0)[:, None] & go_on, sums, np.uint64(0))
            size = size - np.where(at[group] > 0, size[at[group] - 1], 0) + np.where((group == 0) & go_on, total, 0)
            run %= np.uint64(PRIME)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, part, np.int32)), pa.array(own), batch.column("label"), pa.array(place), *(pa.array(c.astype(np.int64)) for c in run.T), *(pa.array(c.astype(np.int64)) for c in term.T), pa.array(n), pa.array(size)], [x.split()[0] for x in SCANNED.split(", ")])
            conv, depth, sums, total = own[-1], int(place[-1]), run[-1], int(size[-1])

    made = staged(rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order, *ties).select("conv", "label", "bytes").mapInArrow(local, SCANNED), "scan")
    # A conversation goes on in a task if an earlier one ended with it: a row for each task.
    ends = made.groupBy("part").agg(F.min("conv").alias("first"), F.max_by(F.struct("conv", "depth", "s0", "s1", "s2", "s3", "total"), F.struct("conv", "depth")).alias("last")).collect()
    carry, held = {}, (None, 0, [0] * 4, 0)
    for r in sorted(ends, key=lambda r: r.part):
        conv, depth, sums, total = held
        if conv == r.first:
            carry[r.part] = held
        g = [pow(b, depth, PRIME) for b in BASES]
        last = (r.last.conv, r.last.depth, [r.last.s0, r.last.s1, r.last.s2, r.last.s3], r.last.total)
        held = (last[0], depth + last[1], [(a + m * b) % PRIME for a, m, b in zip(sums, g, last[2], strict=True)], total + last[3]) if conv == last[0] else last

    def whole(batches):
        for batch in batches:
            part, conv, depth, total = (batch.column(c).to_numpy().copy() for c in ("part", "conv", "depth", "total"))
            sums, term = (np.stack([batch.column(f"{c}{i}").to_numpy() for i in range(4)], axis=1).astype(np.uint64) for c in "sx")
            for p in np.unique(part).tolist():
                if p in carry:
                    c, d, s, t = carry[p]
                    own = (part == p) & (conv == c)
                    g = np.array([pow(b, d, PRIME) for b in BASES], np.uint64)
                    sums[own] = (sums[own] * g + np.array(s, np.uint64)) % np.uint64(PRIME)
                    term[own] = term[own] * g % np.uint64(PRIME)
                    depth[own] += d
                    total[own] += t
            before = (sums + np.uint64(PRIME) - term) % np.uint64(PRIME)
            first = depth == 1
            before[first] = 0
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("label"), pa.array(depth), named(sums), named(before), batch.column("bytes"), pa.array(total)], ["conv", "label", "depth", "key", "parent", "bytes", "total"])

    return made.mapInArrow(whole, "conv long, label binary, depth long, key binary, parent binary, bytes long, total long")


def shared_turns(conv) -> F.Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, label, bytes): label is the hash of role and text."""
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    label = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(" "), "role", "text").cast("binary"), 256)), 1, 16)
    return rows.where("conv IS NOT NULL").withColumns({"label": label, "bytes": F.octet_length("text").cast("long")})


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the conversations, their rebuilt turns (conv, source, place, label, bytes)): the first h turns of conversation c - c % 5, then its own turns after the first h."""
    own = staged(scan(rows, ["turn", "role", F.substring("text", 1, 64)], ["text"]).select("conv", (F.col("depth") - 1).alias("place"), "label", "bytes"), "places")
    convs = staged(own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", shared_turns(F.col("conv"))), "conversations")
    parent = F.col("conv") - F.col("conv") % EVERY
    kept = own.where((F.col("place") >= shared_turns(F.col("conv"))) | (F.col("conv") == parent))
    heads = own.where((F.col("conv") == parent) & (F.col("place") < MOST_SHARED - 1))  # at most eight for a conversation
    lent = convs.where(F.col("conv") != parent).select(F.col("conv").alias("to"), parent.alias("conv"), "h").join(heads, "conv").where("place < h")
    both = kept.select("conv", F.lit(1).alias("source"), "place", "label", "bytes").union(lent.select("to", F.lit(0), "place", "label", "bytes"))
    return convs.select("conv"), both


@dataclass
class Louds:
    """A forest in level order: for the virtual top and then each node a one for each child and a zero. Nodes are numbered from 1, the top is 0."""

    bits: bytes
    n: int

    @classmethod
    def of(cls, parent: np.ndarray) -> tuple[Louds, np.ndarray]:
        """parent: of each node the row of its parent, -1 for the top's children. Gives the tree and the rows in level order."""
        kids = np.argsort(parent, kind="stable")
        lo, hi = np.searchsorted(parent[kids], [np.arange(parent.size), np.arange(parent.size) + 1])
        level, order, degrees = kids[: np.searchsorted(parent[kids], 0)], [], [np.array([np.count_nonzero(parent < 0)])]
        while level.size:
            order.append(level)
            d = hi[level] - lo[level]
            degrees.append(d)
            starts = np.repeat(lo[level], d)
            level = kids[starts + np.arange(starts.size) - np.repeat(np.cumsum(d) - d, d)]
        all_d = np.concatenate(degrees)
        bits = np.ones(int(all_d.sum()) + all_d.size, np.uint8)
        bits[np.cumsum(all_d + 1) - 1] = 0
        return cls(np.packbits(bits, bitorder="little").tobytes(), parent.size), np.concatenate(order) if order else np.zeros(0, np.int64)

    def parents(self) -> np.ndarray:
        """Of each node, from 1, its parent: the zeros before its one."""
        bits = np.unpackbits(np.frombuffer(self.bits, np.uint8), bitorder="little")[: 2 * self.n + 1]
        return np.cumsum(bits == 0)[np.flatnonzero(bits)]

    def degrees(self) -> np.ndarray:
        """Of the top and of each node the number of children."""
        bits = np.unpackbits(np.frombuffer(self.bits, np.uint8), bitorder="little")[: 2 * self.n + 1]
        return np.diff(np.flatnonzero(bits == 0), prepend=-1) - 1

    def gathered(self, *values: np.ndarray) -> list[np.ndarray]:
        """Of the top and of each node the sums over its subtree, values being of nodes in level order: backwards over the levels."""
        parent, out = self.parents(), [np.append(0, v).astype(np.int64) for v in values]
        degrees, levels, lo = self.degrees(), [], 1
        hi = 1 + int(degrees[0])
        while lo < hi:
            levels.append((lo, hi))
            lo, hi = hi, hi + int(degrees[lo:hi].sum())
        for lo, hi in reversed(levels):
            for v in out:
                np.add.at(v, parent[lo - 1 : hi - 1], v[lo:hi])
        return out


ROLLED = "conv long, n long, children long, leaves long, below long"


def forest(rows: pa.Table) -> dict:
    """A shard of chains (id, up, conv, n, own, kids, leaves, below), whose ups lie in it or above it, as LOUDS bits and arrays in level order."""
    ids, ups = (np.array(rows.column(c).to_pylist(), object) for c in ("id", "up"))
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], ups), ids.size - 1)
    parent = np.where(ids[order][at] == ups, order[at], -1) if ids.size else np.zeros(0, np.int64)
    tree, level_order = Louds.of(parent)
    return {"tree": tree} | {c: rows.column(c).to_numpy()[level_order].astype(np.int64) for c in ("conv", "n", "own", "kids", "leaves", "below")}


def rolled(shard: dict) -> pa.Table:
    """For each chain its children, and the leaves and tokens of its subtree (tokens without the chain's own). kids, leaves and below are what hangs below in other shards."""
    tree: Louds = shard["tree"]
    children = tree.degrees()[1:] + shard["kids"]
    leaves, tokens = tree.gathered(shard["leaves"] + (children == 0), shard["own"] + shard["below"])
    return pa.table({"conv": shard["conv"], "n": shard["n"], "children": children, "leaves": leaves[1:], "below": tokens[1:] - shard["own"]})


def stored(key: int, shard: dict) -> dict:
    """A shard as a row of a table."""
    own = {c: shard[c].astype("<i8").tobytes() for c in ("conv", "n", "own", "kids", "leaves", "below")}
    return {"shard": key, "size": shard["tree"].n, "louds": shard["tree"].bits} | own


STORED = "shard int, size long, louds binary, conv binary, n binary, own binary, kids binary, leaves binary, below binary"
STORED_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in STORED.split(", "))])


def shards(chains: DataFrame) -> DataFrame:
    """The chains (shard, id, up, conv, n, own, kids, leaves, below) as a row of succinct arrays for each shard, staged."""

    def build(key, rows):
        return pa.Table.from_pylist([stored(key[0].as_py(), forest(rows))], STORED_SCHEMA)

    return staged(chains.groupBy("shard").applyInArrow(build, STORED), "shards")


def roll(built: DataFrame) -> DataFrame:
    """(conv, n, children, leaves, below) of each chain of the shards."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = {c: np.frombuffer(r[c], "<i8") for c in ("conv", "n", "own", "kids", "leaves", "below")}
                yield from rolled({"tree": Louds(r["louds"], r["size"])} | own).to_batches(1 << 16)

    with batches_of(built.sparkSession, 8):
        return staged(built.mapInArrow(run, ROLLED), "rolled")


def dealt(chains: DataFrame, prefixes: DataFrame, parts: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(the chains with the prefix that their shard hangs from as head, the heavy chains): level by level, the chains below a heavy prefix go to the prefixes below it."""
    limit = max(least, chains.count() // parts)
    left = staged(chains.join(prefixes.where("depth = 1").select("conv", F.col("key").alias("head")), "conv"), "heads")
    light, heavy = [], []
    while True:
        large = left.groupBy("head").count().where(F.col("count") > limit).select("head")
        found = [bytes(r.head) for r in large.collect()]  # fewer than parts
        if not found:
            light.append(left)
            break
        is_large = F.col("head").isin(found)
        light.append(left.where(~is_large))
        tops = left.where(is_large & (F.col("top") == F.col("head")))
        heavy.append(tops.drop("head"))
        below = left.where(is_large & (F.col("top") != F.col("head"))).join(F.broadcast(tops.select("head", (F.col("hi") + 1).alias("depth"))), "head").drop("head")
        left = staged(below.join(prefixes.select("conv", "depth", F.col("key").alias("head")), ["conv", "depth"]).select(*chains.columns, "head"), "heads")
    union = lambda x: x[0] if len(x) == 1 else x[0].union(union(x[1:]))
    return union(light), union(heavy) if heavy else chains.limit(0)


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: int = PARTS, least: int = LEAST_HEAVY, shard_chains: int = SHARD_CHAINS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node."""
    spark = conversations.sparkSession
    with batches_of(spark, 1 << 14):
        convs, rows = rebuilt(turns(conversations, conv, turn, role, text))
        prefixes = staged(scan(rows, ["source", "place"], []).drop("label"), "prefixes")
    everyone = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    nodes = staged(prefixes.groupBy("key", "depth", "parent", "bytes", "total").agg(F.count("*").alias("n"), F.min("conv").alias("conv")), "nodes")
    # Prefixes with the same members (the same smallest one, and as many) are a chain.
    chains = nodes.groupBy("conv", "n").agg(F.max("depth").alias("hi"), F.max("total").alias("total"), F.sum("bytes").alias("bytes"), F.max_by("key", "depth").alias("id"), F.min_by("key", "depth").alias("top"), F.min_by("parent", "depth").alias("up"))
    none = F.lit(0).cast("long")
    chains = staged(chains.withColumns({"own": (F.col("n") - 1) * F.col("bytes"), "kids": none, "leaves": none, "below": none}).drop("bytes"), "chains")
    light, heavy = dealt(chains, prefixes, parts, least)
    n_shards = max(1, 2 * spark.sparkContext.defaultParallelism, -(-chains.count() // shard_chains))
    built = shards(light.withColumn("shard", F.pmod(F.xxhash64("head"), F.lit(n_shards)).cast("int")))
    low = roll(built)
    # What the shards hang below their heavy prefixes, and these as a trie of their own.
    hung = light.where("top = head").select("conv", "n", "up", "own").join(low.drop("children"), ["conv", "n"]).groupBy("up").agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum(F.col("below") + F.col("own")).alias("below"))
    root = spark.createDataFrame([(everyone.conv, everyone.n, bytearray(ROOT), bytearray(b""))], "conv long, n long, id binary, up binary") if everyone.n else spark.createDataFrame([], "conv long, n long, id binary, up binary")
    tops = heavy.select("conv", "n", "id", "up", "own").union(root.select("conv", "n", "id", "up", none)).join(hung.withColumnRenamed("up", "id"), "id", "left")
    # The root has a chain's name where a first turn has all conversations: told apart by a count of its own.
    upper = tops.select(F.lit(0).alias("shard"), "id", "up", "conv", F.when(F.col("id") == F.lit(ROOT), -1).otherwise(F.col("n")).cast("long").alias("n"), "own", *(F.coalesce(c, none).alias(c) for c in ("kids", "leaves", "below")))
    sums = low.union(roll(shards(upper)))
    ends = prefixes.groupBy("conv").agg(F.max_by("key", "depth").alias("id"))
    ends = convs.join(ends, "conv", "left").select("conv", F.coalesce("id", F.lit(ROOT)).alias("id"))
    closed = digests(ends)
    above = chains.select(F.col("id").alias("up"), F.col("conv").alias("parent_conv_id")).union(root.select("id", "conv"))
    named_chains = staged(chains.select("conv", "n", "id", "up", "top", "hi", "total").join(sums, ["conv", "n"]).join(above, "up", "left").join(closed, "id", "left"), "sums")
    last = F.col("depth") == F.col("hi")
    out = nodes.select("conv", "n", "key", "depth", "bytes", F.col("total").alias("so_far")).join(named_chains, ["conv", "n"])
    out = out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("key") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("total") - F.col("so_far") + F.col("bytes"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    first = sums.where("n = -1").withColumn("all", F.lit(everyone.n))
    own = closed.where(F.col("id") == F.lit(ROOT)).select("ends_sha256")
    root_end = (own.first() or [NO_ENDS])[0]
    return out.union(first.select("conv", F.lit(0).cast("long"), F.lit(None).cast("long"), "all", "children", F.greatest("leaves", F.lit(1)), "below", F.lit(root_end)))


def digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): the hash of the members' numbers, ascending, for each id of ends (id, conv). A hash is one chain: ranges of sorted numbers are put into text in parallel, and a task reads that text piece by piece."""

    def spelt(batches):
        for batch in batches:
            if batch.num_rows:
                ids, conv = batch.column("id").to_pylist(), batch.column("conv").to_pylist()
                at = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
                rows = [(ids[a], conv[a], ",".join(map(str, conv[a:b]))) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["id", "first", "text"])

    def hashed(batches):
        own, h = None, None
        for batch in batches:
            out = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if i == own:
                    h.update(b"," + text.encode())
                    continue
                if h:
                    out.append((own, h.hexdigest()))
                own, h = i, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["id", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["id", "ends_sha256"])

    spark = ends.sparkSession
    with batches_of(spark, 1 << 12):
        text = staged(ends.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv").mapInArrow(spelt, "id binary, first long, text string"), "ends")
        return staged(text.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashed, "id binary, ends_sha256 string"), "hashes")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
