import random
import zlib

import numpy as np
import pytest
import public_tokenizers

from loomgraph.llm import bpe, token_shards
from loomgraph.llm.token_shards import EliasFano
from loomgraph.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 9, 1000, 1000, 2**40], sorted(random.Random(2).choices(range(10**6), k=700))])
def test_elias_fano(values):
    own = EliasFano.of(np.array(values, np.uint64))
    assert own.all().tolist() == values
    assert [own.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        own.select(len(values))
    if len(values) > 100:
        assert 8 * (len(own.low) + len(own.high) + len(own.at)) <= len(values) * (3 + max(0, np.log2((values[-1] + 1) / len(values))) + 32 / token_shards.SAMPLE) + 64


@pytest.mark.parametrize("shard_ids", [1, 40, 1 << 16])
def test_round_trip(spark, shard_ids):
    rng = random.Random(7)
    texts = [None, "", "word " * 500, "same", "same", "<|endoftext|>", *(" ".join(rng.choices(["a", "the", "été", "\n"], k=rng.randrange(60))) for _ in range(80))]
    ids = [None, None, -5, 9, 9, 2**40, *rng.sample(range(10**6), 80)]
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * 86, strict=True)), "doc_id long, text string, start string")
    path = fresh_path(spark, "t")
    token_shards.write(df, path, shard_ids=shard_ids)
    rows = sorted(token_shards.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    by = {}
    for i, t in zip(ids, texts, strict=True):
        own = [*bpe.tokenizer(PATH).encode(t or "", add_special_tokens=False).ids, 2]
        by.setdefault(i, []).append(own)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        assert r.ids in by[r.doc_id]
        assert (r.n_tokens, r.ids_crc32) == (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
    assert len(rows) == 86
    wanted = spark.createDataFrame([(i,) for i in [*ids[6:30], 9, 9, -5, -4, 2**41, None]], "doc_id long")
    some = sorted(map(tuple, token_shards.lookup(spark, path, wanted).collect()))
    assert some == sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in rows if r.doc_id in {*ids[6:30], 9, -5})


def test_no_rows(spark):
    path = fresh_path(spark, "t")
    token_shards.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_shards.read(spark, path).collect() == []
    assert token_shards.lookup(spark, path, spark.range(3).toDF('doc_id')).collect() == []
