import json

import pytest

from loomgraph.operators import persistence
from loomgraph.sources import readers, records, sinks, worlds

ROW = "2020/01/01 00:00,B1,A1,B2,A2,$10.50,USD,\"1\",USD,Wire,1".replace('"1"', "1")


def put(tmp_path, name, *rows):
    p = tmp_path / name
    p.write_text("\n".join(rows) + "\n")
    return str(p)


def test_transfers(spark, tmp_path):
    rows = readers.transfers(spark, put(tmp_path, "a.csv", readers.TRANSFER_HEADER, ROW, ROW.replace("A1", "007"))).orderBy("tx_id").collect()
    assert [(r.tx_id, r.sender, r.receiver, r.amount_received, r.amount_paid, r.is_laundering) for r in rows] == [("tx_00000000", "B1_A1", "B2_A2", 10.5, 1.0, 1), ("tx_00000001", "B1_007", "B2_A2", 10.5, 1.0, 1)]
    for i, bad in enumerate([ROW + ",x", ROW.replace(",1", ",2", 2).replace("Wire,1", "Wire,2"), ROW.replace("$10.50", "nan"), ROW.replace("A1", " "), ROW.replace("$10.50", "-1")]):
        with pytest.raises(Exception, match="isn't valid"):
            readers.transfers(spark, put(tmp_path, f"bad{i}.csv", readers.TRANSFER_HEADER, ROW, bad)).collect()
    with pytest.raises(Exception, match="header"):
        readers.transfers(spark, put(tmp_path, "h.csv", "a,b", ROW)).collect()


def test_patterns(spark, tmp_path):
    row = ROW.replace("$", "")
    path = put(tmp_path, "p.txt", "BEGIN LAUNDERING ATTEMPT - Fan-Out: Max 3", row, row, "END LAUNDERING ATTEMPT - Fan-Out", "stray", "BEGIN LAUNDERING ATTEMPT - CYCLE", row, ROW + ",x", "END LAUNDERING ATTEMPT - SMURF", "END LAUNDERING ATTEMPT - X", "BEGIN LAUNDERING ATTEMPT - Z")
    blocks, bad = readers.patterns(spark, path)
    assert sorted((r.pattern_id, len(r.transfers)) for r in blocks.collect()) == [("AML_PATTERN_00001_fan_out_max_3", 2), ("AML_PATTERN_00002_cycle", 1), ("AML_PATTERN_00003_z", 0)]
    assert sorted((r.place, r.reason) for r in bad.collect()) == [(4, "line outside a block"), (7, "invalid transfer"), (8, "END of another family"), (9, "END without a block"), (10, "block without END")]


def test_wallets(spark, tmp_path):
    path = put(tmp_path, "e.csv", "input_address,output_address", "a,b", "a,b", "b,c")
    assert sorted((r.src, r.dst, r.edge_key) for r in readers.wallet_edges(spark, path).collect()) == [("a", "b", "source_row_0"), ("a", "b", "source_row_1"), ("b", "c", "source_row_2")]
    assert readers.wallet_edges(spark, path, 2).count() == 2
    assert readers.wallet_classes(spark, put(tmp_path, "c.csv", "address,class", "a,1", "b,3")).count() == 2
    with pytest.raises(Exception, match="isn't 1, 2 or 3"):
        readers.wallet_classes(spark, put(tmp_path, "c2.csv", "address,class", "a,4")).collect()
    with pytest.raises(Exception, match="comes twice"):
        readers.wallet_classes(spark, put(tmp_path, "c3.csv", "address,class", "a,1", "a,1")).collect()
    assert readers.wallet_features(spark, put(tmp_path, "f.csv", "address,x,y.z", "a,1,2.5")).first().f == [1.0, 2.5]
    with pytest.raises(Exception, match="isn't finite"):
        readers.wallet_features(spark, put(tmp_path, "f2.csv", "address,x,y", "a,1,nan")).collect()


def test_strict_json(spark, tmp_path):
    good = put(tmp_path, "g.jsonl", '{"a": 1, "s": "NaN 1e999"}', "", '{"a": -2.5e3, "s": null}')
    assert sorted((r.a, r.s) for r in readers.json_lines(spark, good, "a double, s string").collect()) == [(-2500.0, None), (1.0, "NaN 1e999")]
    for i, bad in enumerate(['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "{"]):
        with pytest.raises(Exception, match="not strict JSON"):
            readers.json_lines(spark, put(tmp_path, f"b{i}.jsonl", bad), "a double").collect()


def test_manifest(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 3 AS fold", "CAST(NULL AS STRING) AS x")
    sinks.write_parts(df, str(tmp_path / "w"), "fold")
    assert sinks.read_parts(spark, str(tmp_path / "w"), "fold").count() == 50
    spark.range(1).selectExpr("id", "CAST(NULL AS STRING) AS x").write.mode("append").parquet(str(tmp_path / "w/data/fold=1"))
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_parts(spark, str(tmp_path / "w"), "fold")
    assert sinks.run_id({"b": 1, "a": 2}) == sinks.run_id({"a": 2, "b": 1})


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.lines(spark, str(tmp_path / "many.txt"))
        got = rows.collect()
        assert rows.rdd.getNumPartitions() >= 1 and len(got) == 20_000
        assert all(int(r.value.split(" ")[0]) == r.place for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_quoted_fields(spark, tmp_path):
    row = '2020/01/01 00:00,B1,"A,1",B2,"A ""2""","$1,010.50",USD,1,USD,Wire,1'
    r = readers.transfers(spark, put(tmp_path, "q.csv", readers.TRANSFER_HEADER, row)).first()
    assert (r.sender, r.receiver, r.amount_received) == ("B1_A,1", 'B2_A "2"', 1010.5)
    for i, bad in enumerate(['"a', 'a,b,c', 'a,"b', ""]):
        with pytest.raises(Exception, match="isn't valid"):
            readers.wallet_edges(spark, put(tmp_path, f"w{i}.csv", "input_address,output_address", bad)).collect()


def test_empty_and_broken_blocks(spark, tmp_path):
    path = put(tmp_path, "b.txt", "begin  laundering attempt - Stack", "END LAUNDERING ATTEMPT - STACK", "BEGIN LAUNDERING ATTEMPT - A: x", ROW.replace("$", ""), "BEGIN LAUNDERING ATTEMPT - B")
    blocks, bad = readers.patterns(spark, path)
    assert sorted((r.pattern_id, len(r.transfers)) for r in blocks.collect()) == [("AML_PATTERN_00001_stack", 0), ("AML_PATTERN_00002_a_x", 1), ("AML_PATTERN_00003_b", 0)]
    assert sorted(r.reason for r in bad.collect()) == ["BEGIN inside a block"]


def bundle(tmp_path, **changes):
    files = {
        "candidate_observations": ['{"selected_event_mask": [1, 1, 0], "central_node_mask": [1, 1, 0], "cycle_length": 2}', '{"selected_event_mask": [1, 0, 1], "central_node_mask": [1, 1, 0], "cycle_length": 2}'],
        "candidate_identity": ['{"candidate_id": "c0", "event_ids": [10, 11], "cycle_accounts": ["a", "b"]}', '{"candidate_id": "c1", "event_ids": [10, 12], "cycle_accounts": ["a", "b"]}'],
        "cellular_polygonal_boundaries": ['{"candidate_id": "c0", "boundary": [{"event_id": 10}, {"event_id": 11}]}', '{"candidate_id": "c1", "boundary": [{"event_id": 12}, {"event_id": 10}]}'],
        "simplicial_subdivision": ['{"candidate_id": "c0"}', '{"candidate_id": "c1"}'],
        "hasse_incidence": ['{"candidate_id": "c0"}', '{"candidate_id": "c1"}'],
        "world_directed_multigraph_identity": [f'{{"physical_event_id": {e}, "source_account": "{a}", "target_account": "{b}"}}' for e, a, b in ((10, "a", "b"), (11, "b", "a"), (12, "b", "a"))],
    } | changes
    vectors = ', "world_event_time_steps": [0.0, 0.5, 1.0], "world_event_log1p_amounts": [1.0, 2.0, 0.5]}'
    files["candidate_observations"] = [r if "world_event" in r else r[:-1] + vectors for r in files["candidate_observations"]]
    for name, rows in files.items():
        put(tmp_path, f"{name}.jsonl", *rows)
    return str(tmp_path)


def test_world_bundles(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z")], "at int, node string")
    events = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "at int, event long")
    (tmp_path / "good").mkdir()
    got = worlds.bundle(spark, bundle(tmp_path / "good"), nodes, events)
    assert sorted((r.candidate_id, r.event_ids) for r in got.collect()) == [("c0", [10, 11]), ("c1", [10, 12])]
    broken = {
        "boundary isn": {"cellular_polygonal_boundaries": ['{"candidate_id": "c0", "boundary": [{"event_id": 10}, {"event_id": 10}]}', '{"candidate_id": "c1", "boundary": [{"event_id": 12}, {"event_id": 10}]}']},
        "align": {"hasse_incidence": ['{"candidate_id": "c0"}']},
        "ids differ": {"simplicial_subdivision": ['{"candidate_id": "c1"}', '{"candidate_id": "c1"}']},
        "other accounts": {"candidate_observations": ['{"selected_event_mask": [1, 1, 0], "central_node_mask": [1, 0, 1], "cycle_length": 2}', '{"selected_event_mask": [1, 0, 1], "central_node_mask": [1, 1, 0], "cycle_length": 2}']},
        "binary": {"candidate_observations": ['{"selected_event_mask": [2, 1, 0], "central_node_mask": [1, 1, 0], "cycle_length": 2}', '{"selected_event_mask": [1, 0, 1], "central_node_mask": [1, 1, 0], "cycle_length": 2}']},
    }
    for i, (message, change) in enumerate(broken.items()):
        (tmp_path / str(i)).mkdir()
        with pytest.raises(ValueError, match=message):
            worlds.bundle(spark, bundle(tmp_path / str(i), **change), nodes, events)


def test_indexes_panels_and_paths(spark, tmp_path, monkeypatch):
    index = spark.createDataFrame([("w1", "train", "complete", 0, False), ("w1", "train", "complete", 0, True), ("w2", "train", "complete", 0, False), ("w3", "test", "failed", 1, False)], "world string, role string, status string, exit_code int, replay boolean")
    assert worlds.index_entries(index, ["w1", "w2"], "train").count() == 2
    for wanted, role in ((["w1"], "train"), (["w1", "w2", "w4"], "train"), (["w3"], "test")):
        with pytest.raises(ValueError, match="cover"):
            worlds.index_entries(index, wanted, role)
    rows = spark.createDataFrame([("a", "w", 0.5, ""), ("a", "x", None, "one class")], "arm string, world string, ap double, why string")
    valid = worlds.undefined_or("ap", "why")
    assert worlds.panel(rows, {"arm": ["a"], "world": ["w", "x"]}, valid).count() == 2
    with pytest.raises(ValueError, match="complete"):
        worlds.panel(rows, {"arm": ["a", "b"], "world": ["w", "x"]}, valid)
    with pytest.raises(ValueError, match="valid"):
        worlds.panel(rows.fillna("", ["why"]).selectExpr("arm", "world", "ap", "'' why"), {"arm": ["a"], "world": ["w", "x"]}, valid)
    monkeypatch.setenv("LOOM_X", "/env")
    assert [worlds.resolve("g", "LOOM_X", "d"), worlds.resolve(None, "LOOM_X", "d"), worlds.resolve(None, "LOOM_Y", "d")] == ["g", "/env", "d"]
    (tmp_path / "real").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert worlds.inside(str(tmp_path), "real", {"real"}).endswith("/real")
    for name in ("link", "../real", "other"):
        with pytest.raises(ValueError, match="allowed"):
            worlds.inside(str(tmp_path), name, {"link", "../real", "real"})
    v = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, float("nan")], 1)], "k int, v array<double>, y int")
    assert worlds.cached_vectors(v.where("k = 1"), "k", "v", "y", 2).count() == 1
    with pytest.raises(ValueError, match="valid"):
        worlds.cached_vectors(v, "k", "v", "y", 2)
    with pytest.raises(ValueError, match="twice"):
        worlds.cached_vectors(v.where("k = 1").union(v.where("k = 1")), "k", "v", "y", 2)
    csv = put(tmp_path, "n.csv", "step,amount", "1,2.5")
    assert readers.native_csv(spark, csv, "step int, amount double").first().amount == 2.5
    with pytest.raises(Exception, match="(?i)header|malformed|convert"):
        readers.native_csv(spark, csv, "amount double, step int").collect()


def test_typed_sinks(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([(0, 1, "a", 0.1), (0, 0, "b", 1 / 3), (1, 1, "c", 2.0)], "fold int, y int, c string, s double")
    sinks.write_folds(df, f"{at}/folds", "fold", "y", df.selectExpr("fold", "IF(c = 'c', 'a', c) AS token"))
    assert sorted((r.fold, r.n, r.positives, r.leaks) for r in spark.read.parquet(f"{at}/folds/audit").collect()) == [(0, 2, 1, True), (1, 1, 1, True)]
    assert sinks.read_parts(spark, f"{at}/folds", "fold").count() == 3
    sinks.write_blocks(df, f"{at}/blocks", ["fold"])
    assert sorted(r.s for r in sinks.read_blocks(spark, f"{at}/blocks", "y int, c string, s double, fold int").collect()) == [0.1, 1 / 3, 2.0]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_blocks(df, f"{at}/blocks", ["fold"])
    sinks.write_relations({"a": df, "b": df.select("fold", "c")}, f"{at}/rel", "fold")
    assert sinks.read_parts(spark, f"{at}/rel/b", "fold").count() == 3
    with pytest.raises(ValueError, match="without"):
        sinks.write_relations({"a": df.drop("fold")}, f"{at}/rel2", "fold")
    m = df.selectExpr("fold AS trial_id", "0 AS epoch", "s")
    sinks.write_scores(m, m, f"{at}/scores")
    sinks.write_scores(m.selectExpr("trial_id", "1 AS epoch", "s"), m.selectExpr("trial_id", "1 AS epoch", "s"), f"{at}/scores")
    with pytest.raises(ValueError, match="already"):
        sinks.write_scores(m, m, f"{at}/scores")
    sinks.write_json(f"{at}/x.json", {"b": 1, "a": [2]})
    assert json.load(open(f"{at}/x.json")) == {"a": [2], "b": 1}
    with pytest.raises(ValueError):
        sinks.write_json(f"{at}/x.json", float("nan"))
    spark.createDataFrame([], records.BLOCK), spark.createDataFrame([], records.CANDIDATE)
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "fold int, v array<float>")
    persistence.cache_vectors(v, f"{at}/vec", "fold")
    assert sinks.read_parts(spark, f"{at}/vec", "fold").count() == 2
    with pytest.raises(ValueError, match="length"):
        persistence.cache_vectors(v.union(spark.createDataFrame([(1, [1.0, 2.0])], v.schema)), f"{at}/vec2", "fold")
