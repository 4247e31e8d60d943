import itertools
import os
import random
import sys
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, language, personal, quality

sys.path.insert(0, os.path.dirname(__file__))
import test_similar  # noqa: E402

WORDS = {"en": "the of and thon ing edsh tion ereat ly on".split(), "fr": "le la de et ouré elle euxoi ment que".split()}


def documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        text = " ".join("".join(rng.choices(WORDS[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(60, 200)))
        if i % 9 == 0:
            text += f" ab.{i}@mail.example.com and 10.1.2.{i}"
        rows.append((i, text, lang, "src", len(text)))
    rows += [(200 + i, rows[3][1], "en", "src", 1) for i in range(20)]
    rows += [(300 + i, rows[i][1].rsplit(" ", 1)[0] + " changed", rows[i][2], "src", 1) for i in range(10)]
    rows += [(400, None, "en", None, None), (401, "", None, "s", 0), (402, "too few words", "en", "s", 1), (403, "1 2 3 4 5 6 7 8 9 10 11 12", "en", "s", 1), (404, "spam " * 80, "en", "s", 1)]
    rows += rows[:2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages_and_run(spark, tmp_path):
    at = str(tmp_path)
    documents(spark).write.parquet(f"{at}/documents.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    start = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, at)
        if name != "best-fit packing":
            assert made.columns == start.columns
        made.write.parquet(f"{at}/{name}")
        seen[name] = before, docs = docs, spark.read.parquet(f"{at}/{name}")
        assert docs.count() or not before.count()
    ids = {name: ({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for name, (a, b) in seen.items()}
    verdict = {r.doc_id: r.kept for r in quality.judge(start).collect()}
    assert ids["quality rules"][1] == {i for i, k in verdict.items() if k}
    assert not ids["quality rules"][1] & {400, 401, 402, 404}
    before, after = seen["language ID"]
    learn = before.where(language.remainder(F.col("doc_id")) != 2)
    named = {r.doc_id: r for r in language.predict(before, language.train(learn)).collect()}
    assert ids["language ID"][1] == {i for i, r in named.items() if r.lang_pred != "und" and r.score >= 0.5}
    before, after = seen["SimHash near-dedup"]
    kept = sorted(r.doc_id for r in after.collect())
    assert kept == test_similar.brute(sorted({(r.doc_id, r.text) for r in before.collect()})) and not {*range(200, 220)} & {*kept} and 0 in kept
    before, after = seen["PII"]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not personal.base_spans(r.text) and r.n_chars == len(r.text)
        assert personal.base_spans(old[r.doc_id]) or r.text == old[r.doc_id]
    path = public_tokenizers.path("byte_bpe_50k.json")
    need = {r.doc_id: len(bpe.tokenizer(path).encode(r.text, add_special_tokens=False).ids) + 1 for r in after.collect()}
    rows = corpus_pipeline.run(spark, at).collect()
    by, got = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
    assert dict(got) == need
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own[:-1])] and sum(n for _, n in own) <= 1024


def test_empty_table(spark, tmp_path):
    documents(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, tmp_path):
    """Columns named like the stages' own come through with their values."""
    names = ["_quality", "_kept", "_nearest", "_text", "_id", "_mark", "_row", "row", "masked", "lang_pred", "score", "bits_per_byte", "none", "fp"]
    docs = documents(spark).limit(60)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, docs.doc_id * 100 + i)
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all(r[n] == r.doc_id * 100 + i for r in rows for i, n in enumerate(names))
