"""Byte-level BPE of whole columns: vectorised splitting into pieces, each distinct piece encoded once.

The pieces are the matches of public_tokenizers.PATTERN. Which character begins a piece depends only on the classes of its
neighbours, so numpy finds all of them at once. A dictionary of pieces then needs the tokenizer library only for pieces that
this worker hasn't met.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa

from loomgraph.llm.texts import CHUNK_BYTES, flat

LETTER, NUMBER, OTHER, SPACE, EDGE = 0, 1, 2, 3, 9
#: Unicode's White_Space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
END_OF_TEXT = "<|endoftext|>"


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    if not data.size or data.max() < 0x80:
        return np.arange(data.size, dtype=np.int64), data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    for least, most, extra in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF7, 3)):
        which = np.flatnonzero((points >= least) & (points <= most) & (points < 0x100))
        if which.size:
            value = data[at[which]].astype(np.int32) & (0x3F >> extra)
            for k in range(1, extra + 1):
                value = value << 6 | data[at[which] + k] & 0x3F
            points[which] = -value  # below zero so that later rounds don't take it for a byte
    return at, np.abs(points)


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces begin. starts: ascending positions at which a text begins."""
    if not data.size:
        return np.zeros(0, np.int64)
    at, points = code_points(data)
    kind = classes()[points]
    first = np.zeros(at.size, bool)
    first[np.searchsorted(at, starts[starts < data.size])] = True
    first[0] = True
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[first] = EDGE
    after_blank = np.zeros(at.size, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank[first] = False
    space = kind == SPACE
    last = np.ones(at.size, bool)
    last[:-1] = first[1:]
    ends = np.zeros(at.size, bool)  # the last of a run of spaces that other characters follow
    ends[:-1] = space[:-1] & ~space[1:]
    ends &= ~last
    begins = np.where(space, (before != SPACE) | ends, (before != kind) & ~after_blank)
    for i in np.flatnonzero((points == 0x27) & begins).tolist():
        n = next((n for n in (1, 2) if i + n < at.size and not first[i + 1 : i + n + 1].any() and bytes(np.minimum(points[i + 1 : i + n + 1], 255).astype(np.uint8)) in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")), 0)
        if n:
            begins[i + 1] = False
            if i + n + 1 < at.size:
                begins[i + n + 1] = True
    return at[begins]


def safe_cut(data: np.ndarray, lo: int, hi: int) -> int:
    """The last place in (lo, hi] at which a piece begins whatever stands around: a blank after an ASCII character that is none; failing that the first one after hi, or the end."""

    def places(a: int, b: int) -> np.ndarray:
        x = data[a:b]
        blank = (x == 0x20) | (x == 0x0A)
        return a + 1 + np.flatnonzero(blank[1:] & (x[:-1] > 0x20) & (x[:-1] < 0x7F))

    if (p := places(lo, min(hi + 1, data.size))).size:
        return int(p[-1])
    step = max(hi - lo, 1)
    while hi < data.size:
        if (p := places(hi - 1, min(hi + step, data.size))).size:
            return int(p[0])
        hi += step - 1 if step > 1 else 1
    return data.size


def room(x: np.ndarray, n: int) -> np.ndarray:
    """x, longer if it has fewer than n places."""
    return x if n <= x.size else np.concatenate([x, np.zeros(max(n - x.size, x.size), x.dtype)])


class Pieces:
    """Encodes texts by a function from distinct pieces to ids; keeps what it has met, up to a number of pieces."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def add(self, pieces: list[bytes]) -> None:
        encoded = self.encode(pieces)
        k, lengths = len(self.known), np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
        self.ids = room(self.ids, self.n_ids + ids.size)
        self.ids[self.n_ids : self.n_ids + ids.size] = ids
        self.start, self.length = room(self.start, k + lengths.size), room(self.length, k + lengths.size)
        self.start[k : k + lengths.size] = self.n_ids + np.cumsum(lengths) - lengths
        self.length[k : k + lengths.size] = lengths
        self.n_ids += ids.size
        self.known.update(zip(pieces, range(k, k + lengths.size), strict=True))

    def chunk(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte position of each piece, ids before each piece and at the end)."""
        at = piece_starts(data, starts)
        if not at.size:
            return np.zeros(0, np.uint32), at, np.zeros(1, np.int64)
        offsets = np.append(at, data.size).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), at.size, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        _, places, raw = pieces.dictionary.buffers()
        places, raw = np.frombuffer(places, np.int32, len(pieces.dictionary) + 1).tolist(), raw.to_pybytes()
        distinct = [raw[a:b] for a, b in itertools.pairwise(places)]
        if len(self.known) > self.most:
            self.clear()
        found = np.array([*map(self.known.get, distinct, itertools.repeat(-1))], np.int64)
        if (new := np.flatnonzero(found < 0)).size:
            found[new] = len(self.known) + np.arange(new.size)
            self.add([distinct[i] for i in new.tolist()])
        which = found[pieces.indices.to_numpy(zero_copy_only=False)]
        length = self.length[which]
        ends = np.cumsum(length)
        place = np.repeat(self.start[which] - (ends - length), length) + np.arange(ends[-1])
        return self.ids[place], at, np.append(0, ends)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) for texts data[offsets[i]:offsets[i + 1]]. Long inputs go in chunks; a cut never falls inside a piece."""
        found, counts, total, cur = [], np.zeros(offsets.size, np.int64), 0, 0
        while cur < data.size:
            end = data.size
            if end - cur > CHUNK_BYTES:
                k = int(np.searchsorted(offsets, cur + CHUNK_BYTES, "right")) - 1
                end = int(offsets[k]) if offsets[k] > cur else 0
                if not end:
                    stop = int(offsets[np.searchsorted(offsets, cur, "right")])
                    end = safe_cut(data[:stop], cur, min(cur + CHUNK_BYTES, stop))
            a, b = np.searchsorted(offsets, [cur, end], "left")
            inside = offsets[a:b] - cur
            ids, at, before = self.chunk(data[cur:end], inside)
            counts[a:b] = total + before[np.searchsorted(at, inside)]
            found.append(ids)
            total, cur = total + ids.size, end
        counts[np.searchsorted(offsets, data.size, "left") :] = total
        return np.concatenate(found) if found else np.zeros(0, np.uint32), counts


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def tiktoken_pieces(path: str) -> Pieces:
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return Pieces(lambda pieces: [own.encode_ordinary(p.decode()) for p in pieces])


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def tokenizers_pieces(path: str) -> Pieces:
    own = tokenizer(path)
    return Pieces(lambda pieces: [x.ids for x in own.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)])


def encode_column(col: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts by the tokenizers library, without special tokens, with end_id after each if given.

    The library takes its end-of-text string in a text for that token; such texts go through it whole.
    """
    data, offsets = flat(col)
    ids, at = tokenizers_pieces(path).texts(data, offsets)
    odd: list[int] = []
    if data.size and END_OF_TEXT.encode() in data.tobytes():
        odd = [i for i in range(len(col)) if END_OF_TEXT.encode() in data[offsets[i] : offsets[i + 1]].tobytes()]
    if odd:
        parts = [ids[at[i] : at[i + 1]] for i in range(len(col))]
        for i in odd:
            parts[i] = np.array(tokenizer(path).encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
        ids, at = np.concatenate(parts), np.append(0, np.cumsum([p.size for p in parts]))
    if end_id is None:
        return ids, at
    n = len(col)
    out = np.empty(ids.size + n, np.uint32)
    ends = at[1:] + np.arange(n)
    rest = np.ones(out.size, bool)
    rest[ends] = False
    out[ends] = end_id
    out[rest] = ids
    return out, at + np.arange(n + 1)
