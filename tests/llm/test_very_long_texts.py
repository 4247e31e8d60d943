"""One text of five megabytes, longer than what a step handles at once, for the operators on tokens; one of a megabyte for the base rules."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomgraph.llm import bpe, bpe_tree, packing, quality, token_shards
from loomgraph.llm.texts import CHUNK_BYTES
from loomgraph.session import fresh_path

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def text():
    rng = random.Random(11)
    words = ["the", "tion", "été", "漢字", "x1", "\n", "don't", "and,", "𝒳", "  "]
    made = "".join(f"{rng.choice(words)}{rng.choice([' ', ' ', '', '.'])}" for _ in range(1_150_000))
    assert len(made.encode()) > CHUNK_BYTES
    return made


@pytest.fixture(scope="module")
def docs(spark, text):
    return spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")


def test_encoding(docs, text):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = own.encode_ordinary(text)
    got = {r.doc_id: tuple(r)[1:] for r in bpe_tree.digests(docs).collect()}
    assert got[1] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_packing_and_shards(spark, docs, text):
    ids = [*bpe.tokenizer(JSON).encode(text, add_special_tokens=False).ids, 2]
    raw = np.array(ids, "<u4")
    edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
    want = [(k, a, b - a, zlib.crc32(raw[a:b])) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    rows = packing.pack_documents(docs).where("doc_id = 1").collect()
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    path = fresh_path(spark, "t")
    token_shards.write(docs, path)
    assert {(r.doc_id, r.start, r.n_tokens): r.ids_crc32 for r in token_shards.read(spark, path).collect()}[1, 0, len(ids)] == zlib.crc32(raw)


def test_base_rules(spark):
    rng = random.Random(12)
    words = [rng.choice(["the", "of", "a", "x#", "é"]) if rng.random() < 0.3 else f"w{rng.randrange(60_000)}" for _ in range(230_000)]
    long = " ".join(words) + "\nsame line\nsame line"
    assert len(long) > 1_000_000
    (r,) = quality.judge(spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string")).collect()
    again, seen = set(), {}
    own = long.split()
    for i in range(len(own) - 4):
        seen.setdefault(tuple(own[i : i + 5]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            again |= {j for i in starts for j in range(i, i + 5)}
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(own), sum(map(len, own)), 1, len(again))
