import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from loomgraph.llm import bpe, bpe_tree
from loomgraph.llm.texts import flat

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", " '", "é", "ñ", "1", "²", "中", "　", "!", "...", "😀", "don't", "’", "\x1c", "\x85", "the ", "tion", " and"]


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def some_texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize(("leaf", "window"), [(3, 1), (8, 2), (64, 64)])
def test_joins_equal_the_whole(own, leaf, window):
    texts = some_texts(1500, 40) + ["", "a" * 500, "é" * 301, " " * 200, "aé" * 99 + " x"]
    tree = bpe_tree.Tree(PATH, leaf, window)
    parts = tree.encode(*flat(pa.array(texts)))
    for text, ids in zip(texts, parts, strict=True):
        assert ids.tolist() == own.encode_ordinary(text), text
        assert tree.decode(ids) == text.encode()
        assert bytes(tree.decimal(ids)) == " ".join(map(str, ids.tolist())).encode()


def test_chunks_cut_safely(own, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 50)
    texts = [*some_texts(800, 60, 2), "x" * 400]
    data, offsets = flat(pa.array(texts))
    ids, at = bpe.tiktoken_pieces(PATH).texts(data, offsets)
    assert all(ids[at[i] : at[i + 1]].tolist() == own.encode_ordinary(t) for i, t in enumerate(texts))


def test_digests_and_round_trip(spark, own):
    texts = [*some_texts(60, 3000, 3), None, "", "<|endoftext|> x", "same", "same"]
    df = spark.createDataFrame([(i if t != "same" else 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in bpe_tree.digests(df, leaf=256).collect())
    want = []
    for r in df.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe_tree.decode(bpe_tree.encode(df).drop("text")).select("doc_id", "text").collect()
    assert sorted(map(tuple, back)) == sorted((r.doc_id, r.text or "") for r in df.collect())
    assert bpe_tree.digests(df.limit(0)).collect() == []


def test_end_of_text_by_the_tokenizers_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*some_texts(300, 50, 4), "a <|endoftext|> b", "<|endoftext|>", None, ""]
    ids, at = bpe.encode_column(pa.array(texts), path, 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*bpe.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 2]
