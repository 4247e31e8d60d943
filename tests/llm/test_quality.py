import math
import random
import re
from collections import Counter

import xxhash

from loomgraph.llm import quality

HISTOGRAM = [r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", r"[#*$%&|<>@~^_=+/\[\]{}\\]", r"[^\x00-\x7F]"]


def learned(rows):
    """rows: (text, lang)."""
    held = {}
    for t, lang in rows:
        if lang is not None:
            held.setdefault(lang, Counter()).update(set(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    return {w for own in held.values() for w, _ in sorted(((w, n) for w, n in own.items() if n > 1), key=lambda x: (-x[1], x[0].encode()))[: quality.TOP]}


def brute(text, known=frozenset()):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    again = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    classes = [len(re.findall(p, t)) for p in HISTOGRAM]
    bins = Counter(xxhash.xxh64(w.encode(), seed=42).intdigest() % quality.BINS for w in words if w in known)
    common = [bins[k] for k in range(quality.BINS)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed), classes + [len(t) - sum(classes)], common + [len(words) - sum(common)]


def js(own, q):
    n = sum(own)
    if not n:
        return 1.0
    out = 0.0
    for x, b in zip(own, q, strict=True):
        a = x / n
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(out / 2, 0))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    some = ["the", "of", "thon", "ing", "edsh", "and", "tion.", "Ouré", "été", "x1", "#", "a|b", "\n", "\t", "\x0b", "\x1c", "  ", " "]
    texts = [None, "", " \n ", "one", "a b c d e a b c d e", "w " * 3000, "x\nx\n \nx\n y\ny", "é# é" * 9, "a b c d e f g h i j k a b c d e", "THE!! " * 60, " ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w4 w5"]
    texts += [" ".join(rng.choices(some, k=rng.randrange(200))) for _ in range(120)]
    texts += ["%%% ### | " * 40 + " ".join(f"q{i}" for i in range(200)), " ".join(f"AB{i}" for i in range(90))]
    rows = [(i % 100, t, rng.choice(["en", "fr", None]), True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean").repartition(5)
    known = learned([(t, g) for _, t, g, _ in rows])
    assert known and known == set(quality.learned(df, "text", "lang"))
    made = [brute(t, known) for _, t, _, _ in rows]
    sums = {}
    for (_, _, lang, _), (base, a, b) in zip(rows, made, strict=True):
        if lang and not base[5] and base[0] >= quality.MIN_WORDS:
            own = sums.setdefault(lang, [[0] * len(a), [0] * len(b)])
            own[0] = [x + y for x, y in zip(own[0], a, strict=True)]
            own[1] = [x + y for x, y in zip(own[1], b, strict=True)]
    shares = [[[x / sum(h) for x in h] for h in own] for own in sums.values()]
    want, far = [], {}
    for (i, *_), (base, a, b) in zip(rows, made, strict=True):
        d = min(max(js(a, p) / 0.2, js(b, q) / 0.5 if base[0] >= 90 else 0) for p, q in shares) if base[0] >= quality.MIN_WORDS else None
        want.append((i, *base, not base[5] and (d is None or d <= 1), d and round(d, 6)))
    got = [(*tuple(r)[:8], r.divergence and round(r.divergence, 6)) for r in quality.judge(df, min_common=90, most_classes=0.2, most_common=0.5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[7] for r in got) and any(not r[6] and not r[7] for r in got)


def test_no_references(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k " * 2, None), (None, " ".join(f"w{i}" for i in range(99)), None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id is None, r.kept) for r in quality.judge(df).collect()) == [(False, False), (True, True)]
    assert quality.judge(df.limit(0)).collect() == []


def test_every_language_has_a_reference(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(80)), f"l{i % 20:02}") for i in range(80)]
    rows += [(100 + i, " ".join("".join(rng.choices("αβγδεζηθ", k=5)) for _ in range(80)), f"z{i}") for i in range(4)]  # fewest documents, own script
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(r.kept for r in got.values())
    references = {}
    for lang in {x for *_, x in rows}:
        a, b = zip(*[brute(t)[1:] for _, t, x in rows if x == lang], strict=True)
        references[lang] = [[sum(c) / sum(map(sum, h)) for c in zip(*h, strict=True)] for h in (a, b)]
    for i, t, _ in rows:
        want = min(js(brute(t)[1], a) / quality.MOST_CLASSES for a, _ in references.values())
        assert math.isclose(got[i].divergence, want, abs_tol=1e-6)
    again = quality.judged(df, carry=["doc_id"], most_literals=2, block_languages=5)
    assert again.columns == ["doc_id", "_quality", "_nearest", "_kept"]
    assert all(math.isclose(r._nearest.far, got[r.doc_id].divergence, abs_tol=1e-9) for r in again.collect())
