"""Catalog, adapters, labels, people and scripts on small fixtures; named queries against DuckDB."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from footage_lake.operators import labels, people, scripts
from footage_lake.plans import registry
from footage_lake.sources import adapters, catalog, tables

SF = "/root/testdata/sf0.001"


def test_media_catalog(spark, tmp_path):
    for n in ("a.MP4", "b.mov", "c.txt", "d.jpg"):
        (tmp_path / n).write_bytes(b"x")
    names = lambda f: sorted(r["path"].rsplit("/", 1)[1] for r in f.collect())
    assert names(catalog.media_catalog(spark, str(tmp_path))) == ["a.MP4", "b.mov"]
    assert names(catalog.media_catalog(spark, str(tmp_path), catalog.IMAGE)) == ["d.jpg"]


def test_probe_records(spark):
    good = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30000/1001"}],"format":{"duration":"10.0","bit_rate":"5000"}}'
    rows = spark.createDataFrame([("/a", good), ("/b", '{"streams":[]}'), ("/c", "nope")], "path string, json string")
    assets, errors = catalog.assets_from_probe(rows)
    a = assets.first()
    assert (a["duration_us"], a["resolution"]["w"], round(a["fps"], 2), a["aspect_ratio"]) == (10_000_000, 1920, 29.97, "1920:1080")
    assert {r["path"] for r in errors.collect()} == {"/b", "/c"}


def test_score_log(spark):
    lines = ["x pts_time:1.5 y", "lavfi.scene_score=0.3", "lavfi.scene_score=0.9", "pts_time:2.0", "lavfi.scene_score=0.1"]
    rows = catalog.frame_scores_from_log(spark.createDataFrame([("a", k, v) for k, v in enumerate(lines)], "asset_id string, line_no int, line string"))
    assert [(r["t_us"], r["cut_score"]) for r in rows.orderBy("t_us").collect()] == [(1_500_000, 0.3), (2_000_000, 0.1)]


def test_state_rules_and_dispatch(spark):
    rules = spark.createDataFrame(
        [(1, 0, "regex", "^final", "PROCESSED"), (2, 0, "regex", "_v2", "ANALYZED"), (3, 0, "dir", "/m/raw", "RAW"), (3, 1, "dir", "/m/raw/done", "PROCESSED")],
        "tier int, rule_seq int, kind string, pattern string, state string",
    )
    media = spark.createDataFrame([("/m/raw2/x.mp4",), ("/m/raw/done/x.mp4",), ("/m/raw/final_v2.mp4",), ("/m/raw/a_v2.mp4",), ("/m/raw/b.mp4",)], "path string")
    out = catalog.resolve_state(media, rules)
    assert [r["state"] for r in out.orderBy("path").collect()] == ["ANALYZED", "RAW", "PROCESSED", "PROCESSED", "RAW"]
    parts = catalog.dispatch(out, {"RAW": lambda d: d.withColumn("kind", F.lit("cut")), "PROCESSED": lambda d: d})
    assert parts.count() == 4 and parts.where("kind = 'cut'").count() == 2


def test_sidecars(spark):
    media = spark.createDataFrame([("/m/a.mp4",), ("/m/b.mp4",)], "path string")
    files = spark.createDataFrame([("/m/a.json",), ("/m/a_config.json",), ("/m/a.csv",)], "path string")
    assert {r["path"]: r["sidecar"] for r in catalog.attach_sidecar(media, files).collect()} == {"/m/a.mp4": "/m/a_config.json", "/m/b.mp4": None}
    assert catalog.attach_sidecar(media, files, ".csv").where("path = '/m/a.mp4'").first()["sidecar"] == "/m/a.csv"


def test_adapters(spark):
    rows = [
        ("n.json", '{"shot_id":"S1","clip_path":"c.mp4","content_summary":"runs","shot_type":"wide","tags":["t"],"fps":"25"}'),
        ("c.json", '{"filename":"f.mp4","description":"talks","location":"x","tags":["p","q"]}'),
        ("m.csv", "filename,location"),
        ("g.json", '{"景别":"中景","地点":"咖啡馆","人物":"男主, 女主","长镜头":"是","连贯性":0.5}'),
        ("bad.json", "nope"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    assert {r["path"]: r["format"] for r in adapters.detect_format(files).collect()} == {"n.json": "native", "c.json": "custom_v1", "m.csv": "csv", "g.json": "generic_json", "bad.json": None}
    n = adapters.adapt_native(files.where("path = 'n.json'")).first()
    assert (n["action"], n["shot_size"], n["tags"], n["fps"], n["missing"]) == ("runs", "wide", ["t"], 25.0, ["emotion", "location", "characters"])
    c = adapters.adapt_custom(files.where("path = 'c.json'")).first()
    assert (c["action"], c["characters"], c["missing"]) == ("talks", ["p", "q"], ["emotion"])
    g = adapters.adapt_generic(files.where("path = 'g.json'")).first()
    assert (g["shot_size"], g["location"], g["characters"], g["is_long_take"], g["coherence_score"], g["missing"]) == ("中景", "咖啡馆", ["男主", "女主"], True, 0.5, ["action", "emotion"])
    csv = spark.createDataFrame([("m", 1, "f", "a, b", ""), ("m", 2, "g", "", "x")], "path string, row_no int, filename string, characters string, location string")
    v = adapters.adapt_csv(csv).collect()
    assert len(v) == 1 and v[0]["characters"] == ["a", "b"] and v[0]["missing"] == ["location"]


def test_shot_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"project_id":"p","shots":[{"shot_id":"S1","location":null,"vlm_description":{"location":"L","shot_size":"wide"}}]}')
    fields = ",".join(f"{c}:{t}" for c, t in adapters.DESCRIPTION.items())
    shots = tables.read_shots(spark, str(tmp_path / "s.json"), f"struct<shot_id:string,{fields},vlm_description:struct<{fields}>>")
    flat = adapters.unpack_description(shots)
    row = flat.first()
    assert (row["location"], row["shot_size"], row["action"], row["characters"], row["focus"], row["continuity_score"]) == ("L", "wide", "", [], None, 0.0)
    packed = adapters.pack_description(flat).first()["vlm_description"]
    assert len(adapters.DESCRIPTION) == len(packed) == 27 and packed["location"] == "L"
    config = adapters.config_fields(flat.withColumn("meta", F.expr("named_struct('description', 'said', 'emotion', 'calm', 'shot_size', '未知')"))).first()["shot_config"]
    assert len(config) == 40 and (config["content_summary"], config["emotion"], config["location"], config["tags"]) == ("said", "calm", "L", ["calm"])
    record = json.loads(adapters.shot_config(flat.withColumn("project_id", F.lit("p"))).first()["config"])
    assert record["clip_path"] == "S1.mp4" and record["split_clip_path"] == "" and record["source_file"] is None
    tables.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "out"))
    head = next((tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8").split("\n")[0]
    assert head == "﻿x,y"


def test_responses(spark):
    base = spark.createDataFrame([("p", "a", 10_000_000, '```json\n{"segments":[{"start":0,"end":4,"emotion":"x"},{"start":4,"end":10}],"suggested_cut_points":[4.0]}\n```'), ("p", "b", 5_000_000, "sorry")], "project_id string, asset_id string, duration_us bigint, response string")
    rows = labels.segments_from_response(base).orderBy("asset_id", "seg_seq").collect()
    assert [(r["asset_id"], r["start_us"], r["end_us"]) for r in rows] == [("a", 0, 4_000_000), ("a", 4_000_000, 10_000_000), ("b", 0, 5_000_000)]
    assert [r["t_us"] for r in labels.suggested_cuts(base).collect()] == [4_000_000]
    votes = spark.createDataFrame([("p", "a", '{"results":[{"timestamp":1.5,"is_cut":true},{"timestamp":-1}]}')], "project_id string, asset_id string, response string")
    assert [(r["t_us"], r["is_cut"]) for r in labels.cut_votes_from_response(votes).collect()] == [(1_500_000, True)]
    frames = spark.createDataFrame([(1, '{"shot_size":"近景","other":1}'), (2, "景别: 全景\n情绪：平静"), (3, "")], "f int, response string")
    got = labels.parse_frame_labels(frames).orderBy("f").collect()
    assert [(r["shot_size"], r["emotion"]) for r in got] == [("近景", "无法判断"), ("全景", "平静"), ("无法判断", "无法判断")]
    said = spark.createDataFrame([("p", "a", [(1234, 2000, "hi"), (None, None, " "), (2100, 2500, "you")])], "project_id string, asset_id string, sentence_info array<struct<start:int,end:int,text:string>>")
    t = labels.transcripts(said)
    assert [(r["start_sec"], r["text"]) for r in t.orderBy("seq").collect()] == [(1.23, "hi"), (2.1, "you")]
    assert labels.dialogue(t).first()["asr_text"] == "hi you"


def test_votes(spark):
    f = spark.createDataFrame([("c", 1, "b", ["x"]), ("c", 2, "a", ["y", "x"]), ("c", 3, "a", []), ("c", 4, "b", []), ("c", 5, "无法判断", [])], "clip string, n int, v string, l array<string>")
    assert labels.vote(f, ["clip"], "n", "v").first()["v"] == "b"
    assert labels.merged_lists(f, ["clip"], "n", "l").first()["l"] == ["x", "y"]
    clips = spark.createDataFrame([("k", ["a", "unknown1", "a"], ["走"], "hi", None)], "clip string, persons array<string>, actions array<string>, speech string, emotion string")
    row = labels.clip_summary(clips).first()
    assert (row["persons"], row["actions"], row["emotion"]) == (["a"], ["走", "说话"], "无法判断")


def test_people(spark):
    det = spark.createDataFrame([("p", "a", f, n, 0.5) for n, fs in (("x", [0, 3, 6, 20]), ("unknown1", [1]), ("unknown2", [2])) for f in fs], "project_id string, asset_id string, frame_idx bigint, identity string, conf double")
    runs = people.appearances(det, fps=1.0)
    assert sorted((r["identity"], r["start_sec"], r["end_sec"], r["frame_count"]) for r in runs.collect()) == [("unknown", 1.0, 2.0, 2), ("x", 0.0, 6.0, 3), ("x", 20.0, 20.0, 1)]
    s = spark.createDataFrame([("p", "a", "S1", 5.0, 7.0), ("p", "a", "S2", 8.0, 9.0)], "project_id string, asset_id string, shot_id string, start_sec double, end_sec double")
    assert {r["shot_id"]: r["people"] for r in people.people_in(s, runs).collect()} == {"S1": ["x"], "S2": []}
    g = spark.createDataFrame([("x", [2.0, 0.0]), ("x", [1.0, 0.0]), ("y", [0.0, 3.0])], "person string, embedding array<double>")
    faces = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.0])], "face_id int, embedding array<double>")
    assert {r["face_id"]: r["person"] for r in people.nearest_person(faces, people.centroids(g)).collect()} == {1: "x", 2: "unknown"}


def test_scripts(spark):
    one = lambda t: [r["scene_text"] for r in scripts.split_scripts(spark.createDataFrame([(1, t)], "script_id int, text string")).orderBy("scene_no").collect()]
    assert one("序\n第一场：开始\n他来了\n第二场 结束\n她走了") == ["序", "第一场：\n开始\n他来了", "第二场\n结束\n她走了"]
    long = "\n".join(["x" * 1500] * 5 + ["y" * 5000] + ["z"])
    assert [len(t.replace("\n", "")) for t in one(long)] == [3000, 3000, 1500, 5000, 1]
    outline = "# 片名\n## 第一幕：起\n### 场1-A\n- 地点：咖啡馆\n- 关键动作：看表，走、停\n- 关键台词：\"你好\"\n- time: 夜\n\n### 场2\n# x\n- 地点：不算\n"
    rows = scripts.parse_outline(spark.createDataFrame([(1, outline)], "script_id int, text string")).orderBy("beat_seq").collect()
    assert [(r["act"], r["scene"], r["beat_id"], r["location"], r["time"], r["key_actions"], r["key_dialogue"]) for r in rows] == [
        ("第一幕：起", "场1", "场1-A", "咖啡馆", "夜", ["看表", "走", "停"], "你好"),
        ("第一幕：起", "场2", "场2", "", "", [], ""),
    ]
    good = spark.createDataFrame([(outline,), ("plain",)], "t string").select(scripts.is_structured(F.col("t"))).collect()
    assert [r[0] for r in good] == [True, False]
    payloads = ['{"act":"A","beats":[{"beat_id":"1"},{"beat_id":"2"}]}', '{"beat_id":"3"}', '[{"beat_id":"4"}]', "bad"]
    resp = spark.createDataFrame([(k, 0, p) for k, p in enumerate(payloads)], "script_id int, scene_no int, payload string")
    beats = scripts.beats_from_responses(resp)
    assert sorted((r["script_id"], r["beat_id"], r["act"]) for r in beats.collect()) == [(0, "1", "A"), (0, "2", "A"), (1, "3", ""), (2, "4", "")]
    assert [r["script_id"] for r in scripts.failed_scripts(resp, beats).collect()] == [3]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_named_query(spark, duck, name):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in registry.ORACLE:
        assert got
        return
    result = duck.execute(registry.ORACLE[name])
    said = [d[0] for d in result.description]
    assert sorted(said) == columns
    assert got == sorted((tuple(plain(r[said.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_entry_point(spark):
    assert entry_point.entry(spark).columns == ["project_id", "asset_id", "t_us", "cut_score"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
