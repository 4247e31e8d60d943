import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from loomgraph.llm import warc
from loomgraph.session import fresh_path


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    """rows: (page_id, url, html). Keys of one payload should be distinct but for equal rows."""
    groups = defaultdict(list)
    for k, _, html in rows:
        groups[html or ""].append(k)
    out = []
    for html, keys in groups.items():
        n = len(html.encode())
        if n < least:
            out += [(k, n, digest(html), "response", None) for k in keys]
            continue
        keys.sort(key=lambda k: (k is not None, k or 0))
        out += [(keys[-1], n, digest(html), "response", None), *((k, n, digest(html), "revisit", keys[-1]) for k in keys[:-1])]
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, record long")


def some_rows(seed):
    rng = random.Random(seed)
    bodies = [None, "", "<p>", "été\r\n\r\nWARC/1.1\r\n", "漢字\x00", *("".join(rng.choices("ab \n", k=rng.randrange(200))) for _ in range(30))]
    urls = [None, "", "http://a.example/x?y=1#z", "http://b.example/a b\r\nWARC-Type: x", "100%41", "http://été.example/"]
    rows = [(i, rng.choice(urls), rng.choice(bodies)) for i in rng.sample(range(-1000, 10**12), 300)]
    return [*rows, (None, "u", "one"), (None, "v", "one"), (7, "w", "one"), (7, "w", "one"), (None, None, "alone"), (5, "t", "x" * 1_500_000), (6, "t", "x" * 1_500_000)]


@pytest.mark.parametrize(("least", "most"), [(0, 1 << 26), (50, 2000), (10**9, 9000)])
def test_against_brute_force(spark, least, most):
    rows = some_rows(least)
    listed = warc.write(made(spark, rows), fresh_path(spark, "warc"), least_bytes=least, archive_bytes=most)
    got = warc.read(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, warc.restored(listed).collect()), key=key) == sorted(((k, u, h or "") for k, u, h in rows), key=key)


def test_archives_hold_to_the_format(spark):
    rows = some_rows(1)
    folder = fresh_path(spark, "warc")
    files = warc.write(made(spark, rows), folder, archive_bytes=5000).collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(rows)
    ids, refers, types = set(), set(), defaultdict(int)
    for f in files:
        data = open(warc.opened(f.file)[1], "rb").read()
        assert len(data) == f.bytes
        whole, at, n = gzip.decompress(data), 0, 0
        while at < len(whole):
            head = whole.index(b"\r\n\r\n", at)
            version, *lines = whole[at:head].decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            end = head + 4 + int(fields["Content-Length"])
            assert version == "WARC/1.1" and whole[end : end + 4] == b"\r\n\r\n" and len(fields) == len(lines)
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(whole[head + 4 : end]).digest()).decode()
            ids.add(fields["WARC-Record-ID"])
            types[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.PROFILE and b"\r\n\r\n" == whole[end - 4 : end]
                refers.add(fields["WARC-Refers-To"])
            at, n = end + 4, n + 1
        assert n == f.records
        places = list(warc.members(f.file))
        for (a, own), b in zip(places, [p for p, _ in places[1:]] + [f.bytes], strict=True):
            assert warc.fetch(f.file, a, b - a) == warc.parsed(own)
    assert len(ids) == len(rows) and refers <= ids and types["response"] + types["revisit"] == len(rows) and types["revisit"] > 100


def test_damage_raises(spark, tmp_path):
    out = warc.Archives(str(tmp_path), 6, 1 << 20)
    out.add(warc.response("urn:x", 1, None, b"own", warc.digest_of(b"other"), warc.DATE))
    out.close()
    listed = spark.createDataFrame([tuple(x.values()) for x in out.done], warc.LISTED)
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read(listed).collect()
    path = warc.opened(out.done[0]["file"])[1]
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-9])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(path))


def test_what_a_lost_task_left_is_not_read(spark):
    folder = fresh_path(spark, "warc")
    listed = warc.write(made(spark, some_rows(2)), folder)
    left = warc.Archives(f"{folder}/archives", 6, 1 << 20)
    left.add(warc.response("urn:x", 99, None, b"left", warc.digest_of(b"left"), warc.DATE))
    left.close()
    assert warc.read(listed).where("page_id = 99").collect() == []


def test_no_rows(spark):
    listed = warc.write(made(spark, [(1, None, None)]).limit(0), fresh_path(spark, "warc"))
    assert listed.collect() == [] and warc.read(listed).collect() == [] and warc.restored(listed).collect() == []
