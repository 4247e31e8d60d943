import hashlib
import os
import struct
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_sources import bundle, put

from loomgraph.sources import digests, readers, worlds


def test_files_are_bound(spark, tmp_path):
    root, table = tmp_path / "files", str(tmp_path / "bound")
    (root / "sub").mkdir(parents=True)
    (root / "a.bin").write_bytes(b"\x00\x01")
    (root / "sub" / "b").write_bytes(b"")
    digests.bind(spark, str(root), table)
    assert {(r.name, r.bytes, r.sha256) for r in spark.read.parquet(table).collect()} == {(n, len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a.bin", b"\x00\x01"), ("sub/b", b""))}
    digests.verify_files(spark, f"file://{root}", table)
    (root / "a.bin").write_bytes(b"\x00\x02")
    (root / "new").write_bytes(b"x")
    (root / "sub" / "b").unlink()
    assert sorted(map(tuple, digests.file_faults(spark, str(root), table).collect())) == [("a.bin", "changed"), ("new", "not listed"), ("sub/b", "missing")]
    with pytest.raises(ValueError, match="differ from their manifest"):
        digests.verify_files(spark, str(root), table)


def test_array_digests(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "k int, x array<double>")
    want = {1: hashlib.sha256(struct.pack("<2d", 1.5, -2.0)).hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: None}
    assert {r.k: r.d for r in df.select("k", digests.array_digest("x").alias("d")).collect()} == want


def test_ledger(spark, tmp_path):
    ledger = digests.Ledger(spark, str(tmp_path / "ledger"), ["read", "fit"])
    df = spark.range(5)
    with pytest.raises(ValueError, match="comes after"):
        ledger.begin("r", "fit")
    with pytest.raises(ValueError, match="hasn't begun"):
        ledger.end("r", "read", df)
    ledger.begin("r", "read")
    ledger.end("r", "read", df)
    assert ledger.done("r") == ["read"] and ledger.done("other") == []
    with pytest.raises(ValueError, match="can't begin"):
        ledger.begin("r", "read")
    ledger.begin("r", "fit")
    ledger.verify("r", "read", df.repartition(3))
    with pytest.raises(ValueError, match="other rows"):
        ledger.verify("r", "read", spark.range(6))


def test_places_of_written_lines(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = [f'{{"k": {i}}}' + " " * (i % 7) for i in range(60)]
        path = put(tmp_path, "x.jsonl", *[x for i, r in enumerate(rows) for x in ([r, "", "  "] if i % 3 == 0 else [r])])
        df = readers.placed_json(spark, path, "k int")
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert sorted((r.place, r.k) for r in df.collect()) == [(i, i) for i in range(60)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def observation(**fields):
    import json

    return json.dumps({"selected_event_mask": [1, 1, 0], "central_node_mask": [1, 1, 0], "cycle_length": 2, "world_event_time_steps": [0.0, 0.5, 1.0], "world_event_log1p_amounts": [1.0, 2.0, 0.5]} | fields)


def test_world_vectors_and_coordinates(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "at int, node string")
    events = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "at int, event long")
    second = observation(selected_event_mask=[1, 0, 1])
    broken = {
        "forbidden": ({"candidate_observations": [observation(sar=1), second]}, nodes, events),
        "aren't valid": ({"candidate_observations": [observation(world_event_time_steps=[0.0, 0.5, 1.5]), second]}, nodes, events),
        "aren't valid|share": ({"candidate_observations": [observation(world_event_log1p_amounts=[1.0, 2.0]), second]}, nodes, events),
        "share": ({"candidate_observations": [observation(world_event_log1p_amounts=[1.0, 2.0, 0.25]), second]}, nodes, events),
        "cover the order": ({}, nodes, events.union(spark.createDataFrame([(3, 13)], "at int, event long"))),
        "comes twice": ({}, nodes.union(spark.createDataFrame([(3, "a")], "at int, node string")), events),
        "outside the order": ({}, nodes.where("node <> 'b'"), events),
    }
    for i, (message, (change, n, e)) in enumerate(broken.items()):
        (tmp_path / str(i)).mkdir()
        with pytest.raises(ValueError, match=message):
            worlds.bundle(spark, bundle(tmp_path / str(i), **change), n, e)


def test_labelled_census(spark, tmp_path):
    candidates = spark.createDataFrame([("c0",), ("c1",)], "candidate_id string")
    index = spark.createDataFrame([("w1", "train", "complete", 0, False), ("w2", "test", "complete", 0, False)], "world string, role string, status string, exit_code int, replay boolean")
    put(tmp_path, "candidate_labels.jsonl", '{"candidate_id": "c1", "label": 1}', '{"candidate_id": "c0", "label": 0, "instance_id": "x"}')
    got = worlds.labelled_census(spark, str(tmp_path), candidates, index, "w1", "train", 2)
    assert sorted((r.candidate_id, r.label) for r in got.collect()) == [("c0", 0), ("c1", 1)]
    with pytest.raises(ValueError, match="frame"):
        worlds.labelled_census(spark, str(tmp_path), candidates, index, "w1", "train", 78)
    with pytest.raises(ValueError, match="cover"):
        worlds.labelled_census(spark, str(tmp_path), candidates, index, "w1", "test", 2)
    for bad, message in (("1.0", "0 or 1"), ("true", "0 or 1"), ('"1"', "0 or 1"), ("2", "0 or 1")):
        put(tmp_path, "candidate_labels.jsonl", f'{{"candidate_id": "c1", "label": {bad}}}', '{"candidate_id": "c0", "label": 0}')
        with pytest.raises(ValueError, match=message):
            worlds.labelled_census(spark, str(tmp_path), candidates, index, "w1", "train", 2)
    put(tmp_path, "candidate_labels.jsonl", '{"candidate_id": "c1", "label": 1}', '{"candidate_id": "c9", "label": 0}')
    with pytest.raises(ValueError, match="join"):
        worlds.labelled_census(spark, str(tmp_path), candidates, index, "w1", "train", 2)
    assert candidates.where(F.col("candidate_id") == "c0").count() == 1
