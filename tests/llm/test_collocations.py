import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, first, share=80):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[s : s + m] for p, a in cand.items() for m in range(2, len(p)) for s in range(len(p) - m + 1) if 100 * a >= share * own[p[s : s + m]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        best.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(best[:first], 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(None, t, g, "x", 1) for t, g in rows], "doc_id long, text string, lang string, word string, key int")


def random_rows(seed, n=300, langs=("en", None, "und", "fr", "x y")):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "new", "York", "été", "ÉTÉ", "漢字", "x\x00y", "of", "the", "-", "a-b", " ", " "]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", "? "]
    return [("".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randrange(60))), rng.choice(langs)) for _ in range(n)]


@pytest.mark.parametrize(("least", "first"), [(2, 50), (5, 2000), (30, 7)])
def test_against_brute_force(spark, least, first):
    rows = [*random_rows(least), (None, "en"), ("", None), ("New york is new YORK", "en")] + [("same old words, same old words", "fr")] * 40
    got = collocations.collocations(made(spark, rows), least=least, first=first).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, first)


@pytest.mark.parametrize("bits", [16, 32])
def test_keys_of_both_widths(spark, monkeypatch, bits):
    """Ids beyond sixteen bits; ranges of a few keys, tasks that sort a few at once."""
    monkeypatch.setattr(collocations, "PART_KEYS", 50)
    rows = random_rows(3)
    blocks = collocations.staged(collocations.blocks(made(spark, rows)), "t")
    big = (bits == 32) << 20
    ids = spark.createDataFrame([(big + i, g, w) for g in ("en", "und") for i, w in enumerate(["a", "b", "new", "of", "york"], 1 + 10 * (g == "und"))], "id long, lang string, word string")
    coded = collocations.encoded(blocks, ids, bits)
    got = {bytes(r.key): r.a for r in collocations.phrases(coded, bits, 3).collect()}
    want = Counter()
    names = {(r.lang, r.word): r.id for r in ids.collect()}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", text.translate(LOWER)):
            g = [names.get((lang or "und", w), 0) for w in re.findall(r"[^ \t]+", piece)]
            for k in (2, 3, 4):
                for i in range(len(g) - k + 1):
                    if all(g[i : i + k]):
                        want[b"".join(x.to_bytes(bits // 8, "big") for x in [*g[i : i + k], *[0] * (4 - k)])] += 1
    assert got == {k: v for k, v in want.items() if v >= 3} and len(got) > 30


def test_planes():
    rng = np.random.default_rng(1)
    for width in (1, 2):
        columns = [np.sort(rng.integers(0, 2**64, 99, np.uint64)), *[rng.integers(0, 2**64, 99, np.uint64)] * (width - 1)]
        back = collocations.unplaned(collocations.planes(columns), width)
        assert all((a == b).all() for a, b in zip(back, columns, strict=True)) and len(back) == width


def test_one_long_text(spark):
    """A megabyte and a half in one text, with one piece longer than a cut."""
    rng = random.Random(4)
    text = "".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.choice('     .')}" for _ in range(400_000)) + "one long piece " * 40_000
    parts = list(collocations.runs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 1 << 16))
    assert len(parts) > 8 and sum(d.size for d, _ in parts) == len(text) and max(d.size for d, _ in parts) > 500_000
    rows = [(text, "en"), ("short one", "en")]
    assert sorted(map(tuple, collocations.collocations(made(spark, rows)).collect())) == brute(rows, 30, 2000)


def test_long_texts_cut_at_pieces():
    texts = [b"a b. c d, e f", b"", b"gg hh ii jj kk ll", b".", b"x y"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for most in (1, 3, 7, 100):
        words = []
        for d, o in collocations.runs(data, offsets, most):
            w, p = collocations.pieces(d, o)
            words += [[x for x, y in zip(w.to_pylist(), p, strict=True) if y == q] for q in dict.fromkeys(p)]
        assert words == [["a", "b"], ["c", "d"], ["e", "f"], ["gg", "hh", "ii", "jj", "kk", "ll"], ["x", "y"]]


def test_weighted_counts():
    n, columns = np.array([3, 2**40], np.int64), [np.array([7, 5], np.uint64)]
    keys, counts = collocations.counted(columns, n)
    assert keys[0].tolist() == [5, 7] and counts.tolist() == [2**40, 3]


def test_no_rows(spark):
    assert collocations.collocations(made(spark, [(None, None)]).limit(0)).collect() == []
    assert collocations.collocations(made(spark, [(None, None), ("once only", "en")])).collect() == []


def test_order_of_rows_and_partitions_changes_nothing(spark):
    rows = random_rows(9)
    one = sorted(map(tuple, collocations.collocations(made(spark, rows).coalesce(1), least=4).collect()))
    assert one == sorted(map(tuple, collocations.collocations(made(spark, rows[::-1]).repartition(7), least=4).collect())) and one
