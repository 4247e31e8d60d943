import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm import prefixes


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for own in convs.values():
        own.sort(key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        built = tuple(x[2:] for x in convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
        ends[built].append(c)
    kids, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, own in nodes.items():
        if p:
            kids[p[:-1]] += 1
    for p, own in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += kids[p] == 0
    return sorted(
        (min(own), len(p), min(nodes[p[:-1]]) if p else -1, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, own in nodes.items()
    )


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth long")


def result(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def some_rows(seed, n=120, length=9):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(3 * n), n):
        out += [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.3 else "user", rng.choice(["hi", "yes", "", None, "été", "漢"])) for t in range(rng.randrange(length))]
        out += [(c, None, "user", "hi")] * (rng.random() < 0.1)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("parts", "least", "shard_chains"), [(256, 1024, 1 << 16), (4, 3, 5), (1000, 0, 1)])
def test_against_brute_force(spark, parts, least, shard_chains):
    rows = [*some_rows(parts), (None, 1, "user", "no conversation"), (7, 3, None, None), (7, 3, None, None)]
    rows += [(c, t, "user", "copied") for c in range(1000, 1100) for t in range(4)]
    assert result(prefixes.trie(made(spark, rows), parts=parts, least=least, shard_chains=shard_chains)) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    """Spread over tasks; another has the same turns but for the last, and texts of a megabyte."""
    rng = random.Random(5)
    turns = [(t, "user", f"{rng.random()}") for t in range(3000)]
    rows = [(5, *t) for t in turns] + [(10, *t) for t in turns[:-1]] + [(10, 9999, "user", "x" * 1_500_000), (15, 0, "user", "x" * 1_500_000), (15, 1, "user", "x" * 1_499_999 + "y")] + some_rows(1, 20)
    got = result(prefixes.trie(made(spark, rows).repartition(6), least=3, parts=8))
    deep = [r for r in got if r[:2] >= (5, 1) and r[0] == 5 and r[3] >= 2]
    assert max(r[1] for r in got) == 3000 and {r[1] for r in deep} >= set(range(1, 3000))  # (5 is the smallest member of 10's prefixes)
    small = [(5, *t) for t in turns[:200]] + [(10, *t) for t in turns[:199]] + [(10, 9999, "user", "z")] + rows[-30:]
    assert result(prefixes.trie(made(spark, small).repartition(6))) == brute(small)


def test_all_share_a_first_turn_or_everything(spark):
    rows = [(5 * c, 0, "user", "same") for c in range(50)] + [(5 * c, 1, "user", str(c % 3)) for c in range(20)]
    assert result(prefixes.trie(made(spark, rows))) == brute(rows)
    rows = [(5 * c, t, "user", "same") for c in range(50) for t in range(3)]
    assert result(prefixes.trie(made(spark, rows))) == brute(rows)


def test_turnless(spark):
    """Conversations whose own turns all lie before the shared ones, whose first conversation is absent."""
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14)]
    want = brute(rows)
    assert any(r[1] == 0 and r[7] != prefixes.NO_ENDS for r in want)
    assert result(prefixes.trie(made(spark, rows))) == want
    turnless = [c for c in range(200) if c % 5 and zlib.crc32(str(c).encode()) % 9][:3]
    rows = [(c, 0, "user", "x") for c in turnless]
    assert result(prefixes.trie(made(spark, rows))) == brute(rows) and len(brute(rows)) == 1


def test_no_rows(spark):
    assert prefixes.trie(made(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    assert prefixes.trie(made(spark, [(None, 1, "a", "b")])).collect() == []


def test_louds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([rng.integers(-1, i) if i else -1 for i in range(n)], np.int64)
        shuffle = rng.permutation(n)
        moved = np.full(n, -1)
        moved[shuffle] = np.where(parent < 0, -1, shuffle[parent])
        tree, order = prefixes.Louds.of(moved)
        assert sorted(order.tolist()) == list(range(n))
        back = np.append(-1, order)[tree.parents()]
        assert (back == moved[order]).all()
        assert tree.degrees().sum() == n and 8 * len(tree.bits) <= 2 * n + 8
        value = rng.integers(0, 9, n)
        want = value.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert (tree.gathered(value[np.argsort(shuffle)][order])[0][1:] == want[np.argsort(shuffle)][order]).all()
