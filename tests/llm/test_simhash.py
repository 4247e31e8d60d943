import random
import re

import numpy as np
import pytest
import xxhash

from loomgraph.llm import simhash
from loomgraph.operators import components


def plain(text):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(ids_fps, distance=4):
    """Components over all pairs, by hand."""
    fps = sorted({f for _, f in ids_fps})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                parent[find(y)] = find(x)
    least = {}
    for i, f in ids_fps:
        r = find(f)
        least[r] = min(least.get(r, i), i)
    return sorted((i, least[find(f)]) for i, f in ids_fps)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    for distance, sections in ((4, 3), (4, 2), (2, 3), (3, 3)):
        x = rng.integers(0, 1 << 63, 300, np.uint64)
        y = x.copy()
        for _ in range(distance):
            y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        i, a, visits = simhash.anchors(x, distance, sections)
        k, b, _ = simhash.anchors(y, distance, sections)
        homes = {(int(p), int(q)) for p, q, v in zip(i, a, visits, strict=True) if not v}
        at = {(int(p), int(q)) for p, q in zip(k, b, strict=True)}
        assert all(any((n, h) in at for m, h in homes if m == n) for n in range(300))
        assert len(i) == len(set(zip(i.tolist(), a.tolist(), strict=True)))


@pytest.mark.parametrize(("most_homes", "most_broadcast"), [(2048, 100), (3, 100_000), (3, 0)])
def test_links_equal_all_pairs(spark, most_homes, most_broadcast):
    rng = random.Random(most_homes)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in [*fps][:6]:
        for _ in range(60):
            g = f
            for _ in range(rng.randrange(1, 8)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(rows, "fp long").repartition(5)
    found = components.stars(simhash.links(df, most_homes=most_homes, most_broadcast=most_broadcast)).collect()
    root = {r.a: r.b for r in found}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    got = {}
    for f in fps:
        got.setdefault(root.get(signed[f], signed[f]), set()).add(f)
    ids = {f: n for n, f in enumerate(sorted(fps))}
    want = {}
    for i, c in brute_classes([(ids[f], f) for f in fps]):
        want.setdefault(c, set()).add(i)
    assert sorted(sorted(ids[f] for f in g) for g in got.values()) == sorted(sorted(g) for g in want.values())


def test_documents(spark):
    rng = random.Random(4)
    words = ["the", "Of", "été", "and", "x", "ing", "tion", "É"]
    base = [" ".join(rng.choices(words, k=rng.randrange(30, 200))) for _ in range(12)]
    texts = [None, "", " \n", "one", "one two three", "ONE two three", "a b c d", *base]
    for b in base[:5]:
        for _ in range(12):
            own = b.split(" ")
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += [base[0]] * 5 + ["w " * 30_000]
    rows = [(i + 10, t, 1) for i, t in enumerate(texts)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(6)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(df).collect())
    fps = [(i, plain(t)) for i, t, _ in rows]
    named = dict(brute_classes(fps))
    assert got == sorted((i, f"{f:016x}", named[i]) for i, f in fps)
    assert simhash.classes(df.limit(0)).collect() == []
    only = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [tuple(r)[2] for r in simhash.classes(only).collect()] == [None, None]
    # One row of each class stays.
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(named.values()))
    both = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "x y z"), (5, "x y z"), (4, "X y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(str, simhash.representatives(both).collect())) == ["Row(doc_id=4, text='X y z')", "Row(doc_id=None, text='a b')"]
