import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from loomgraph.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def spent(plan):
    out = Counter()
    for pattern, m in plan:
        for n in pattern:
            out[n] += m
    return +out


def fewest(items, capacity):
    """The least number of bins by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([7, 10, 20])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = [0] * (capacity + 1)
        for n in items:
            counts[n] += 1
        fixed = packing.reduce_dominated(counts, capacity)
        rest = [n for n in range(capacity + 1) for _ in range(counts[n])]
        assert sum(m for _, m in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity), items
        assert spent(fixed) + Counter(rest) == Counter(items)
        assert all(sum(p) <= capacity for p, _ in fixed)


def test_plan_holds_every_piece_and_is_tight():
    rng = np.random.default_rng(3)
    for capacity, draw in ((1024, rng.integers(1, 1025, 50_000)), (64, rng.integers(1, 65, 3000)), (100, np.full(999, 34)), (10, np.array([10, 10, 1]))):
        counts = Counter(draw.tolist())
        own = packing.plan(counts, capacity)
        assert spent(own) == counts
        assert all(sum(p) <= capacity for p, _ in own)
    own = packing.plan(Counter(rng.integers(1, 1025, 50_000).tolist()), 1024)
    total = sum(sum(p) * m for p, m in own)
    assert sum(m for _, m in own) <= total / 1024 * 1.01 + 1
    assert packing.plan({}, 1024) == []


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own[:-1])]
        assert sum(n for _, n in own) <= capacity


def test_documents(spark):
    rng = random.Random(1)
    words = ["the", "and", "été", "x1", "<|endoftext|>", "\n", "tion"]
    texts = [None, "", "word " * 900, "same", "same", *(" ".join(rng.choices(words, k=rng.randrange(120))) for _ in range(150))]
    df = spark.createDataFrame([(i if t != "same" else 3, t, "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int")
    capacity = 128
    rows = packing.pack_documents(df, capacity=capacity).collect()
    check_places(rows, capacity)
    want = Counter()
    for r in df.collect():
        ids = [*bpe.tokenizer(PATH).encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_a_length_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    df = spark.range(900).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 > 0, 40L, 1 + id % 90) length", "id ids_crc32")
    rows = packing.pack(df, capacity=100).collect()
    assert len(rows) == 900
    check_places(rows, 100)
