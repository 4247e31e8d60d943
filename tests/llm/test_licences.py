import math
import random
import re

from loomgraph.llm import licences


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(words, phrase):
    own = phrase.split()
    return [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]


def brute(rows, templates, rare, least):
    """The method by trying every template in every bin."""
    docs = [words_of(t) for _, t in rows]
    spots = {x: [(w, i) for i, w in enumerate(t.split()) if w not in licences.COMMON] for x, (t, _) in templates.items()}
    known = {w for own in spots.values() for w, _ in own}
    held = [set(d) for d in docs]
    weight = {w: math.log((len(docs) + 1) / (sum(w in d for d in held) + 1)) + 1 for w in known}
    out = []
    for (key, _), words, own in zip(rows, docs, held, strict=True):
        base = [(i, x) for p, x in licences.BASE.items() for i in runs(words, p)]
        labels, best = set(), 0.0
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for x, (template, phrases) in templates.items():
            total, distinct = sum(weight[w] for w, _ in spots[x]), {w for w, _ in spots[x]}
            top = set(sorted(distinct & own, key=lambda w: (-weight[w], w))[:rare])
            drift = len(template.split()) // licences.DRIFT
            for half in range(1 + (drift > 0)):
                bins = {}
                for w, at in spots[x]:
                    for i in places.get(w, []):
                        bins.setdefault((i - at + half * drift) // max(1, 2 * drift), set()).add((w, at))
                for k, hit in bins.items():
                    inside = lambda p, k=k, half=half, drift=drift, template=template: any((i - runs(template.split(), p)[0] + half * drift) // max(1, 2 * drift) == k for i in runs(words, p))
                    share = sum(weight[w] for w, _ in hit) / total
                    if len({w for w, _ in hit} & top) >= min(licences.AGREEING, len(distinct)) and share >= least and all(map(inside, phrases)):
                        labels.add(x)
                        best = max(best, share)
        names = sorted({x for _, x in base})
        out.append((key, len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(names), ",".join(sorted(set(names) | labels)), round(1.0 if base else min(best, 1), 6)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    filler = ["tion", "the", "license", "license", "software", "été", "by", "cc", "permission", "public"]
    texts = [None, "", "CC-BY cc by;CC  by", "ALL Rights\nreserved all rights reserved.", "all rights reserved" * 3, "Keep \u212aey LICENSED under CC BY-NC 4.0.", "Released under the MİT License", "0cc by", "cc by\u0301", "general public licensé"]
    for t, _ in licences.TEMPLATES.values():
        texts += [t, t.title() + ".", " ".join(w for w in t.split() if rng.random() > 0.15), "x " * 5 + t + " y"]
    texts += [" ".join(rng.choices(filler, k=rng.randrange(60))) for _ in range(40)]
    texts += ["permission license software " * 4000 + "all rights reserved"]
    rows = [(i % 70, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, labels string, n_words int").repartition(5)
    got = [(*tuple(r)[:7], round(r.score, 6)) for r in licences.scan(df).collect()]
    assert sorted(got, key=str) == brute(rows, licences.TEMPLATES, licences.RARE, licences.LEAST)
    assert any("apache-2.0" in r[6] for r in got)
    assert licences.scan(df.limit(0)).collect() == []


def test_several_licences_in_one_text(spark):
    own = licences.TEMPLATES
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including'
    texts = [own["bsd"][0] + ". Released under the MIT License.", ". ".join(t for t, _ in own.values()), mit, "no licence here"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licences.scan(df).collect()}
    assert got[0] == {"bsd", "mit"}
    assert got[1] >= set(own)
    assert got[2] == {"mit-text"} and got[3] == {""}


def test_words_put_in_or_left_out(spark):
    """A word more or less in the middle, or a few, doesn't lose a whole licence; its words in another order do."""
    rng = random.Random(4)
    whole = licences.TEMPLATES["mit-whole"][0].split()
    texts = [whole[:60] + ["really"] + whole[60:], whole[:100] + whole[103:], whole[:30] + ["um"] * 4 + whole[30:], rng.sample(whole, len(whole)), whole[: len(whole) // 2]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(df).collect()}
    assert ["mit-whole" in got[i] for i in range(5)] == [True, True, True, False, False]


def test_rare_words_choose(spark):
    """A template is looked up by its rarest words alone; with all words looked up the result is the same where those stand in the copy."""
    texts = [licences.TEMPLATES["zlib"][0], "software " * 50, "this software " + licences.TEMPLATES["isc"][0]]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    few, many = (sorted(map(tuple, licences.scan(df, rare=k).collect()), key=str) for k in (2, 10_000))
    assert few == many and "zlib" in few[0][6]
