import random

from loomgraph.llm import similar, simhash


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, least=0.8):
    """The least key of each component over all pairs, by hand."""
    sets = [plain(t) for _, t in rows]
    parent = [*range(len(rows))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and sets[j] and len(x & sets[j]) >= least * len(x | sets[j]):
                parent[find(i)] = find(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out[find(i)] = min(out.get(find(i), k), k)
    return sorted(out.values())


def test_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "ONE two three", "one two three", "a b c d e f", "a b c d e g"]
    for _ in range(40):
        own = rng.choices(words, k=rng.randrange(60, 260))
        texts += [" ".join(own)] * 2
        for _ in range(6):  # some words changed: similarities around 0.8
            own = list(own)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in similar.representatives(df).collect())
    assert got == brute(rows)
    assert len(got) < simhash.representatives(df).count()
    assert similar.representatives(df.limit(0)).collect() == []
    both = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "x y z"), (4, "X y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(str, similar.representatives(both).collect())) == ["Row(doc_id=4, text='X y z')", "Row(doc_id=None, text='a b')"]


def test_texts_apart_in_parts(spark):
    """A text with many edited copies that are nearer to it than to each other, in bands split into small parts."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.sample(range(150), 4):
            own[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate([*texts, " ".join(base)], 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sorted(r.doc_id for r in similar.representatives(df).collect()) == want
    sets = [similar.shingle_set(t) for _, t in rows]
    nodes = spark.createDataFrame([(5, i, len(s), i) for i, s in enumerate(sets)], "band long, node long, n int, root long")
    kept = spark.createDataFrame([(i, s.view("int64").tolist()) for i, s in enumerate(sets)], "node long, shingles array<long>")
    parent = {i: i for i in range(len(sets))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for most in (7, 10_000):
        parent = {i: i for i in range(len(sets))}
        for r in similar.apart(nodes, kept, similar.SIMILARITY, most).collect():
            parent[find(r.a)] = find(r.b)
        assert len({find(i) for i in parent}) == len(want)
