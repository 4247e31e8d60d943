"""Operator 6: byte-level BPE encoding and decoding by a tree reduction.

An encoding is an element of a monoid: a stretch of text with its ids. A text is halved until its parts have LEAF_BYTES at most; the parts
are encoded, and neighbours are joined up the tree. A join re-encodes a window around the seam. The
window grows, doubling on both sides, until each of its ends lies at a place where a piece begins whatever stands around it
(a blank after a character that is none: no match of the pattern holds a non-blank before a blank). Ids outside the window
belong to pieces that the seam cannot reach, so they stand. Without such a place the window ends at the end of the stretch.
Decoding concatenates the bytes of runs of LEAF_IDS ids up a tree.

All joins of one level of all texts of a batch are made together: every id carries the place of its first byte, so a level takes the
ids inside its windows out and puts the windows' own in.

Each text is independent, so this is one pass without a shuffle; memory is bounded by the batch and the longest text.
Defined results: null and empty texts have no ids; repeated rows are each encoded; other columns pass through, and an
existing column with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bpe
from loomgraph.llm.texts import arrow_rows, flat, slices
from loomgraph.session import table

#: Bytes of a leaf, ids of a leaf of decoding, bytes on either side of a seam at first.
LEAF_BYTES, LEAF_IDS, WINDOW = 128, 256, 16


def cuts(data: np.ndarray, lo: int, hi: int, leaf: int) -> list[int]:
    """Where the leaves of data[lo:hi] begin, by halving; never inside a character."""
    if hi - lo <= leaf:
        return [lo]
    mid = (lo + hi) // 2
    while mid > lo and data[mid] & 0xC0 == 0x80:
        mid -= 1
    return cuts(data, lo, mid, leaf) + cuts(data, mid, hi, leaf) if lo < mid else [lo]


def boundaries(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places s in (lo, hi) with an ASCII non-blank at s - 1 and a blank at s: pieces begin there in any surroundings."""
    x = data[lo:hi]
    blank = (x == 0x20) | (x == 0x0A)
    return lo + 1 + np.flatnonzero(blank[1:] & (x[:-1] > 0x20) & (x[:-1] < 0x7F))


class Tree:
    """Encodes and decodes with the ranks in a file."""

    def __init__(self, path: str, leaf: int = LEAF_BYTES, window: int = WINDOW):
        self.pieces, self.leaf, self.window = bpe.tiktoken_pieces(path), leaf, window
        ranks = bpe.ranks(path)
        words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            words[i] = word
        self.words = pa.array(words, pa.binary())
        self.width = np.array([len(w) for w in words], np.int64)
        self.decimals = pa.array([b"%d " % i for i in range(len(words))], pa.binary())

    def windows(self, safe: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of the window to be encoded again around each seam mid of a stretch from lo to hi. safe: where pieces begin in any surroundings, ascending."""
        begin, end = np.full(mid.size, -1), np.full(mid.size, -1)
        before, after = np.searchsorted(safe, mid) - 1, np.searchsorted(safe, mid)
        padded = np.concatenate([safe, [-1]])  # place -1 stands before and behind all
        left, right = padded[np.maximum(before, -1)], padded[np.minimum(after, safe.size)]
        w, open_ = self.window, np.arange(mid.size)
        while open_.size:
            a, b = np.maximum(lo[open_], mid[open_] - w), np.minimum(hi[open_], mid[open_] + w)
            met = (left[open_] > a) & (left[open_] >= 0)
            begin[open_] = np.where(met, left[open_], np.where(a == lo[open_], lo[open_], -1))
            met = (right[open_] < b) & (right[open_] >= 0)
            end[open_] = np.where(met, right[open_], np.where(b == hi[open_], hi[open_], -1))
            open_ = open_[(begin[open_] < 0) | (end[open_] < 0)]
            w *= 2
        return begin, end

    def stretches(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of each id's first byte) of the stretches that lie between edges, one after another."""
        ids, _ = self.pieces.texts(data, edges)
        width = self.width[ids]
        return ids, np.cumsum(width) - width

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        leaves = [cuts(data, lo, hi, self.leaf) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        text = np.repeat(np.arange(len(leaves)), [len(own) for own in leaves])
        edges = np.array([x for own in leaves for x in own] + [int(offsets[-1])], np.int64)
        ids, at = self.stretches(data, edges)
        safe = boundaries(data, 0, data.size)
        lo, hi = edges[:-1], edges[1:]
        while True:
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1])[: text.size])
            odd = (np.arange(text.size) - np.repeat(first, np.diff(np.append(first, text.size)))) % 2 == 1
            right = np.flatnonzero(odd)  # each is joined to its left neighbour
            if not right.size:
                break
            begin, end = self.windows(safe, lo[right - 1], lo[right], hi[right])
            which = np.minimum(np.searchsorted(end, at, "right"), end.size - 1)
            stays = (at < begin[which]) | (at >= end[which])
            sizes = end - begin
            ends = np.cumsum(sizes)
            source = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])
            new, place = self.stretches(data[source], np.append(0, ends))
            place = source[place]
            ids, at = np.concatenate([ids[stays], new]), np.concatenate([at[stays], place])
            order = np.argsort(at, kind="stable")
            ids, at = ids[order], at[order]
            hi = hi.copy()
            hi[right - 1] = hi[right]
            lo, hi, text = lo[~odd], hi[~odd], text[~odd]
        cut = np.searchsorted(at, offsets)
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        parts = [bytes(spread(self.words, ids[k : k + LEAF_IDS])) for k in range(0, ids.size, LEAF_IDS)]
        while len(parts) > 1:  # one level of the tree
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def decimal(self, ids: np.ndarray) -> memoryview:
        """The ids in decimal, joined by one space."""
        return spread(self.decimals, ids)[:-1]


def spread(values: pa.Array, ids: np.ndarray) -> memoryview:
    """The values of ids, one after another."""
    if not ids.size:
        return memoryview(b"")
    taken = values.take(pa.array(ids))
    _, at, raw = taken.buffers()
    ends = np.frombuffer(at, np.int32, len(taken) + 1)
    return memoryview(raw)[ends[0] : ends[-1]]


@functools.cache
def tree(path: str, leaf: int, window: int) -> Tree:
    return Tree(path, leaf, window)


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", leaf: int = LEAF_BYTES, window: int = WINDOW) -> DataFrame:
    """df with the ids of its texts as array<int>."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        own = tree(path, leaf, window)
        for whole in batches:
            for batch in slices(whole, text):
                parts = own.encode(*flat(batch.column(text)))
                at = np.append(0, np.cumsum([p.size for p in parts])).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, ids])

    keep = [c for c in df.columns if c != ids]
    arrow_rows(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text of its ids; null ids give an empty text. Ids that aren't valid UTF-8 together get replacement characters."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        own = tree(path, LEAF_BYTES, WINDOW)
        for batch in batches:
            column = batch.column(ids)
            texts = [own.decode(np.asarray(x.values if x.is_valid else [], np.int64)).decode(errors="replace") for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, text])

    keep = [c for c in df.columns if c != text]
    arrow_rows(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())]))


def digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", leaf: int = LEAF_BYTES, window: int = WINDOW) -> DataFrame:
    """key, n_tokens and the SHA-256 of the decimal ids and of the bytes that they decode to, without holding the ids as a column."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        own = tree(path, leaf, window)
        for whole in batches:
            for batch in slices(whole, "text"):
                parts = own.encode(*flat(batch.column("text")))
                sha = [[hashlib.sha256(f(p)).hexdigest() for p in parts] for f in (own.decimal, own.decode)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([p.size for p in parts], pa.int64()), *map(pa.array, sha)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    arrow_rows(df.sparkSession)
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
