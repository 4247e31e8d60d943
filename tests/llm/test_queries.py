"""The numbered queries over the smallest test tables, held against plain versions of their contracts."""

import hashlib
import itertools
import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))
import test_licences
import test_personal
import test_prefixes
import test_quality
import test_simhash
import test_urls
import test_warc

from loomgraph.llm import bpe, registry
from loomgraph.llm.personal import KINDS

DATA = os.environ.get("LOOMGRAPH_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, n):
    name = next(k for k in registry.QUERIES if k.startswith(f"op{n}_"))
    return registry.QUERIES[name](spark, DATA).collect()


def test_op1(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = run(spark, 1)
    assert len(rows) == len(pages)
    for r in rows:
        host, path = test_urls.parse(pages[r.page_id])
        rule = test_urls.fixed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.verdict == (rule[0] if rule else r.verdict) and r.verdict in ("allow", "block")


def test_op2(spark, docs):
    from loomgraph.llm import licences

    rows = run(spark, 2)
    want = test_licences.brute([(i, d.text) for i, d in docs.items()], licences.TEMPLATES, licences.RARE, licences.LEAST)
    assert sorted(((*tuple(r)[:7], round(r.score, 6)) for r in rows), key=str) == want


def test_op3(spark, docs):
    rows = run(spark, 3)
    assert len(rows) == len(docs)
    for r in rows:
        base = test_personal.brute(docs[r.doc_id].text)
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_op4(spark, docs):
    rows = run(spark, 4)
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in run(spark, 5)) == sorted(con.execute(registry.ORACLE_SQL["op5_voronoi_knn"]).fetchall())


def test_op6(spark, docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = run(spark, 6)
    assert len(rows) == len(docs)
    for r in rows:
        ids = own.encode_ordinary(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest())


def test_op7(spark, docs):
    rows = run(spark, 7)
    assert len(rows) == len(docs)
    for r in rows:
        base = test_quality.brute(docs[r.doc_id].text)[0]
        assert tuple(r)[1:7] == base
        assert not (base[5] and r.kept)


def test_op8(spark, docs):
    fps = [(i, test_simhash.plain(d.text)) for i, d in docs.items()]
    named = dict(test_simhash.brute_classes(fps))
    assert sorted(tuple(r)[:3] for r in run(spark, 8)) == sorted((i, f"{f:016x}", named[i]) for i, f in fps)


def ids_of(text):
    return [*bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_op9(spark, docs):
    want, got, by = Counter(), Counter(), defaultdict(list)
    for i, d in docs.items():
        ids = ids_of(d.text)
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = run(spark, 9)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [0, *itertools.accumulate(n for _, n in own[:-1])] and sum(n for _, n in own) <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_op10(spark, docs):
    at, want = 0, []
    for i in sorted(docs):
        ids = ids_of(docs[i].text)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r)[:4] for r in run(spark, 10)) == want


def test_op11(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(map(tuple, run(spark, 11))) == sorted(con.execute(registry.ORACLE_SQL["op11_collocations"]).fetchall())


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if x is None else x for x in r) for r in run(spark, 12)) == test_prefixes.brute(rows)


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, run(spark, 13)), key=str) == test_warc.brute(rows)
