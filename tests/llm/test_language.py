import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language
from loomgraph.llm.texts import flat

SYLLABLES = {"aa": ["ka", "lo", "mi", "ré"], "bb": ["sch", "ein", "öt", "un"], "cc": ["ción", "el", "ña", "que"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def brute(counts_by, s):
    """Code lengths byte by byte from plain dictionaries."""
    out = {}
    for lang, counts in counts_by.items():
        bits, padded = 0.0, bytes(4) + s
        for i in range(4, len(padded)):
            for k in (4, 3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                    break
                own = counts.get(padded[i - k : i]) if k else counts.get(b"")
                if own:
                    total, n = sum(own.values()), own[padded[i]]
                    if n:
                        bits -= math.log2(n / (total + len(own)))
                        break
                    bits -= math.log2(len(own) / (total + len(own)))
        out[lang] = bits
    return out


def counted(texts):
    own = defaultdict(Counter)
    for s in texts:
        padded = bytes(4) + s
        for i in range(4, len(padded)):
            for k in range(5):
                own[padded[i - k : i]][padded[i]] += 1
    return own


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(1, 80)), lang, i) for i, lang in enumerate(rng.choices(sorted(SYLLABLES), k=240))]
    rows += [(1000, None, "aa", 0), (1001, "", "aa", 0), (1002, "12 !", None, 0), (1003, "ka lo", None, 0), (1003, "ka lo", None, 0), (None, "ein sch", "bb", 0), (1005, "ein un " * 20_000, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")


def test_code_lengths_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(language, "STEP", 111)
    monkeypatch.setattr(language, "MEMO", 3000)
    model = next(language.train(docs).models())
    assert model.languages == ["aa", "bb", "cc"]
    by = {x: counted(r.text.encode() for r in docs.where(F.col("lang") == x).collect() if r.text is not None) for x in model.languages}
    texts = [text(random.Random(9), "bb", 9), "", "zz ka", "ein\x00中", "a", "ka lo mi"]
    got = model.code_lengths(*flat(pa.array(texts)))
    want = [[brute(by, s.encode())[x] for x in model.languages] for s in texts]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_blocks_of_languages_change_nothing(docs):
    one = sorted(map(str, language.predict(docs, language.train(docs)).collect()))
    many = language.train(docs, block_languages=2)
    assert many.blocks == 2
    two = language.predict(docs, many).collect()
    whole = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert len(two) == len(one)
    for r in two:
        assert r.lang_pred == whole[r.doc_id].lang_pred and abs(r.score - whole[r.doc_id].score) < 1e-9


def test_more_languages_change_no_code_length(docs, spark):
    """Other languages, 300 of them, leave the lengths in a language as they are."""
    rng = random.Random(4)
    more = [(5000 + i, " ".join("".join(rng.choices("bcdfg" + chr(0x400 + i % 200) + chr(0x500 + i), k=5)) for _ in range(30)), f"x{i:03d}", 0) for i in range(300)]
    grown = docs.where("lang IS NOT NULL").union(spark.createDataFrame(more, docs.schema))
    few, many = language.train(docs), language.train(grown)
    assert (few.blocks, many.blocks) == (1, 10)
    texts = flat(pa.array([text(random.Random(3), "cc", 20)]))
    a = next(few.models())
    b = next(m for m in many.models() if "cc" in m.languages)
    assert a.code_lengths(*texts)[0, a.languages.index("cc")] == b.code_lengths(*texts)[0, b.languages.index("cc")]
    found = language.predict(spark.createDataFrame(more, docs.schema), many).collect()
    assert sum(r.lang_pred == r.lang for r in found) > 290


def test_predictions(docs, spark):
    learn = docs.where(language.remainder(F.col("doc_id")) != 2)
    rows = language.predict(docs, language.train(learn)).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    assert [r.lang_pred for r in rows if r.doc_id == 1003] == ["aa", "aa"]
    assert next(r.lang_pred for r in rows if r.doc_id == 1005) == "bb"
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) > 0
    none = language.predict(docs.limit(3), language.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.predict(docs.limit(0), language.train(learn)).collect() == []


def test_sample_is_bounded(docs):
    n = language.sample_counts(docs.where("doc_id < 240"), "doc_id", "text", "lang", 3000, 100).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert len(n) == 3 and all(r.n < 12_000 for r in n)


def test_few_long_texts_are_sampled(spark):
    rows = [(7, text(random.Random(i), "aa", 100_000), "aa") for i in range(2)] + [(7, text(random.Random(5), "bb", 100_000), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = {r.lang: r.n for r in language.sample_counts(df, "doc_id", "text", "lang", 100_000).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert {*n} == {"aa", "bb"} and all(20_000 < x < 300_000 for x in n.values())


def test_clashing_columns(spark, docs):
    rows = docs.limit(5).select("doc_id", "text", "lang", F.lit(1).alias("_text"), F.lit(2).alias("_bits"), F.lit(3).alias("_row"), F.lit(4).alias("Score"))
    got = language.predict(rows, language.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "_text", "_bits", "_row", "lang_pred", "score", "bits_per_byte"]
    assert {(r._text, r._bits, r._row) for r in got.collect()} == {(1, 2, 3)}


def test_partitions_change_nothing(spark, docs):
    """The sample is drawn by what rows hold; equal rows count once."""
    counts = [sorted(map(tuple, language.train(d, sample_bytes=3000).counts.collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.union(docs).repartition(3))]
    assert counts[0] == counts[1] == counts[2] and counts[0]
