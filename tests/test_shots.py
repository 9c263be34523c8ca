"""Relations, boundaries, duplicates, selection, edit and timeline on small fixtures."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from footage_lake.functions import timecode as tc
from footage_lake.operators import anchors, dedup, edit, quality, relations, segments, selection, timeline

SHOT = (
    "project_id string, shot_id string, idx bigint, state string, source_file string, source_path string, tc_in string, tc_out string, duration_sec double, fps double,"
    " visual_quality double, stability double, confidence double, asr_text string, dialogue string, characters array<string>, direction string, location string, action string, emotion string,"
    " shot_size string, camera_position string, camera_movement string, tags array<string>, status string, dedup_reason string, quality_score double, beat string, act string, md5 string, phash string"
)
NAMES = [c.strip().split()[0] for c in SHOT.split(",") if c.strip()]
LINK = "struct<shot_id:string,relationship_type:string,coherence_score:double>"


def shots(spark, *rows):
    base = dict.fromkeys(NAMES) | {"project_id": "p", "state": "RAW", "fps": 24.0, "duration_sec": 5.0, "tc_in": "00:00:00:00", "tc_out": "00:00:05:00", "status": "候选", "dedup_reason": "", "beat": "b1", "quality_score": 5.0}
    made = [tuple((base | {"idx": k, "shot_id": f"S{k:03d}", "source_file": f"f{k}", "source_path": f"/m/f{k}"} | r)[n] for n in NAMES) for k, r in enumerate(rows)]
    out = spark.createDataFrame(made, SHOT)
    return out.withColumn("prev", F.lit(None).cast(LINK)).withColumn("next", F.lit(None).cast(LINK))


def statuses(frame):
    return {r["shot_id"]: r["status"] for r in frame.collect()}


def test_speed_and_time_codes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(tc.parse_speed(F.lit(s))) for s in ("50%", "200%", "1x", "2.5x", "删除", "", "bad")] == [0.5, 2.0, 1.0, 2.5, None, 1.0, 1.0]
    assert one(tc.parse_speed(F.lit(None).cast("string"))) == 1.0 and one(tc.export_speed(F.lit("删除"))) == 1.0
    assert [one(tc.format_speed(F.lit(x))) for x in (0.5, 1.0, 2.0, 2.5)] == ["50%", "1x", "2x", "2.5x"]
    assert [one(tc.parse_duration(F.lit(s))) for s in ("300", "5s", "5m", "1小时", "0:05:00", "x", "1.5")] == [300, 5, 300, 3600, 300, 0, 1.5]
    assert one(tc.sec_to_tc(F.lit(3661.5))) == "01:01:01:12" and one(tc.tc_to_sec(F.lit("00:01:01:12"))) == 61.5 and one(tc.tc_to_sec(F.lit("x"))) is None
    assert [one(tc.direction_sign(F.lit(s))) for s in ("从左向右", "right-to-left", "up")] == [1, -1, 0]
    assert one(tc.reel_name(F.lit("my_clip-01.final.mov"))) == "MYCLIP01"
    assert one(tc.hex_hamming(F.lit("00ff"), F.lit("01fe"))) == 2 and one(tc.hex_hamming(F.lit("0"), F.lit("00"))) == 999
    assert one(tc.bit_hamming(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert [one(tc.act_number(F.lit(s))) for s in ("第2幕", "第十二幕：x", "尾声")] == [2, 12, 99]


def test_relations(spark):
    a = {"camera_position": "A", "location": "L", "emotion": "x", "characters": ["m"]}
    rows = relations.relations(shots(spark, a, a | {"camera_position": "B"}, a | {"camera_position": "B"})).orderBy("src_shot").collect()
    assert [(r["relationship_type"], r["coherence_score"]) for r in rows] == [("机位跳切", 0.5), ("情绪延续", 0.8)]


SEG = "project_id string, asset_id string, seg_seq bigint, start_us bigint, end_us bigint, camera_position string, characters array<string>, emotion string, action string, location string, dialogue string, coherence_score double, is_long_take boolean"


@pytest.mark.parametrize(
    ("left", "right", "score", "grade"),
    [
        ({"camera_position": "A"}, {"camera_position": "B"}, 0.35, "low"),
        ({"camera_position": "A", "characters": ["x"]}, {"camera_position": "B", "characters": ["y"]}, 0.6, "high"),
        ({"emotion": "e", "characters": ["x"]}, {"emotion": "f", "characters": ["y"]}, 0.4, "medium"),
        ({"camera_position": "A"}, {"camera_position": "A"}, 0.0, "low"),
    ],
)
def test_boundary_scores(spark, left, right, score, grade):
    base = {"camera_position": "", "characters": [], "emotion": "", "action": "", "location": "", "dialogue": "", "coherence_score": 0.0, "is_long_take": False}
    segs = spark.createDataFrame([("p", "a", 0, 0, 5_000_000, *(base | left).values()), ("p", "a", 1, 5_000_000, 10_000_000, *(base | right).values())], SEG)
    cand = spark.createDataFrame([("p", "a", 5_000_000)], "project_id string, asset_id string, t_us bigint")
    assets = spark.createDataFrame([("p", "a", 10_000_000)], "project_id string, asset_id string, duration_us bigint")
    row = segments.score_boundaries(cand, segs, assets).first()
    assert (row["score"], row["confidence"]) == (score, grade)
    far = spark.createDataFrame([("p", "a", 50_000_000)], "project_id string, asset_id string, duration_us bigint")
    kept = segments.protect_long_takes(segments.score_boundaries(cand, segs, far), segs, far).first()
    assert kept["protected"] and kept["score"] == pytest.approx(score - 0.15)


def test_segment_lookup_by_brute_force(spark):
    """Overlapping, very long, empty and gapped segments; repeated points, points before, between and after them."""
    spans = [("a", 0, 1_000_000, 4_000_000), ("a", 1, 2_000_000, 95_000_000), ("a", 2, 9_999_999, 10_000_001), ("a", 3, 120_000_000, 130_000_000), ("a", 4, 50, 50), ("b", 7, 0, 20_000_000), ("b", 9, -(2**50), 2**60), ("b", 8, 130_000_000, 9_000_000_000)]
    fields = [None, None, None, None, None, None, 0.5, False]
    segs = spark.createDataFrame([("p", a, n, x, y, *fields) for a, n, x, y in spans], SEG)
    times = [0, 900_000, 1_900_000, 1_900_000, 9_899_999, 9_900_000, 94_899_999, 94_900_000, 119_900_000, 125_000_000, 200_000_000, None]
    points = spark.createDataFrame([("p", a, t, "x") for a in "abc" for t in times], "project_id string, asset_id string, t_us bigint, _seg string")
    rows = segments.segment_at(points, segs, 100_000, "here").collect()

    def first(asset, t):
        own = [s for s in spans if s[0] == asset]
        inside = [n for _, n, x, y in own if t is not None and x <= t + 100_000 < y]
        return min(inside) if inside else max(n for _, n, _, _ in own)

    assert len(rows) == 2 * len(times)
    assert all(r["here"]["seg_seq"] == first(r["asset_id"], r["t_us"]) for r in rows)


def test_take_selection(spark):
    s = selection.initial_status(shots(spark, {"quality_score": 3.0}, {"quality_score": 5.0}, {"state": "PROCESSED", "beat": "b2", "quality_score": 2.0}, {"beat": "b2", "quality_score": 5.0}, {"state": "ANALYZED", "beat": "b3"}, {"beat": None}, {"beat": "ERROR"}))
    assert statuses(s)["S005"] == statuses(s)["S006"] == "未匹配"
    got = statuses(selection.select_takes(s))
    assert got == {"S000": "备选", "S001": "核心", "S002": "强制保留", "S003": "核心", "S004": "核心"}
    beats = spark.createDataFrame([("p", "b1", "", ""), ("p", "b9", "", "")], "project_id string, beat_id string, act string, scene string")
    assert [r["beat_id"] for r in selection.missing_beats(beats, selection.select_takes(s)).collect()] == ["b9"]
    assert len(selection.beat_report(selection.select_takes(s)).collect()) == 3


def test_exact_duplicates(spark):
    s = dedup.dedup_exact(shots(spark, {"md5": "x" * 32, "quality_score": 3.0}, {"md5": "x" * 32, "quality_score": 5.0}, {"md5": None}, {"md5": None}))
    rows = {r["shot_id"]: r for r in s.collect()}
    assert rows["S000"]["status"] == "废弃" and rows["S000"]["dedup_reason"].startswith("L1文件级重复") and rows["S002"]["status"] == rows["S003"]["status"] == "候选"


def test_axis_warning(spark):
    s = shots(spark, {"characters": ["x", "y"], "direction": "left to right"}, {"characters": ["y"], "direction": "right to left"}, {"characters": ["z"], "direction": "right to left"})
    rows = selection.axis_warnings(s).collect()
    assert [(r["shot_a"], r["shot_b"], r["characters"]) for r in rows] == [("S000", "S001", "y")]


@pytest.mark.parametrize(
    ("quality_of", "edges", "kept"), [([9, 5, 7], [(0, 2), (1, 2)], {0, 1}), ([5, 3, 7], [(0, 1), (0, 2)], {2})]
)
def test_greedy_order(spark, quality_of, edges, kept):
    rows = [Row(project_id="p", beat="b", i=i, j=j, shot_a=str(i), shot_b=str(j), q_a=float(quality_of[i]), q_b=float(quality_of[j])) for i, j in edges]
    lost = {int(r["shot_id"]) for r in dedup.resolve_greedy(spark.createDataFrame(rows)).collect()}
    assert set(range(3)) - lost == kept


def test_close_hashes_and_links(spark):
    rows = [{"phash": "0" * 16}, {"phash": "0" * 15 + "1", "quality_score": 4.0}, {"phash": "f" * 16}]
    assert statuses(dedup.dedup_group(shots(spark, *rows))) == {"S000": "候选", "S001": "废弃", "S002": "候选"}
    link = F.struct(F.lit("S000").alias("shot_id"), F.lit("情绪延续").alias("relationship_type"), F.lit(0.9).alias("coherence_score"))
    later = shots(spark, *rows).withColumn("prev", F.when(F.col("shot_id") == "S001", link))
    assert statuses(dedup.dedup_group(later))["S001"] == "废弃"  # only the earlier row's links count
    earlier = shots(spark, *rows).withColumn("next", F.when(F.col("shot_id") == "S000", F.struct(F.lit("S001").alias("shot_id"), F.lit("x").alias("relationship_type"), F.lit(0.9).alias("coherence_score"))))
    assert statuses(dedup.dedup_group(earlier))["S001"] == "候选"


def test_quality_weights(spark):
    s = shots(spark, {"visual_quality": 5.0, "confidence": 0.1}, {"visual_quality": 1.0, "confidence": 0.95})
    q = lambda w: [r[0] for r in s.orderBy("idx").select(quality.quality_score(w)).collect()]
    assert q({"script_confidence": 0.6})[1] > q({"script_confidence": 0.6})[0]
    assert q(None)[0] == round(10 * (0.2 + 0.035 + 0.075 + 0.1), 2)


def decide(spark, *rows):
    base = {"project_id": "p", "speed": "1x", "technique": "连续剪辑", "transition": "硬切", "audio": "保留原声", "purpose": "", "notes": "", "source_file": "f", "tc_in": "00:00:00:00", "tc_out": "00:00:05:00"}
    return spark.createDataFrame([Row(**(base | {"seq": k + 1, "shot_id": f"S{k:03d}"} | r)) for k, r in enumerate(rows)])


def test_protection_and_guard(spark):
    s = shots(spark, {"status": "核心"}, {"status": "强制保留"}, {"status": "待复核"}, {"status": "核心", "fps": 30.0}, {"status": "核心", "fps": 30.0, "state": "PROCESSED"})
    d = decide(spark, *[{"speed": "删除"}] * 3, {"speed": "50%"}, {"speed": "50%"})
    out = edit.guard_speed(edit.protect(d, s), s)
    assert {r["shot_id"]: r["speed"] for r in out.collect()} == {"S001": "1x", "S002": "1x", "S003": "1x", "S004": "50%"}
    assert edit.edit_pools(s)[0].count() == 5


def test_compress(spark):
    s = shots(spark, *[{"status": "核心", "quality_score": q} for q in (0.9, 0.5, 0.2, 0.1)])
    budget = edit.targets(spark.createDataFrame([("p", "3s")], "project_id string, target string"))
    out = edit.fit_duration(decide(spark, {}, {}, {}, {}), s, s.where("false"), budget)
    total = edit.projected_duration(out, s).first()["total_sec"]
    assert total <= 3.15 and "S003" not in {r["shot_id"] for r in out.collect()}


def test_extend(spark):
    s = shots(spark, {"status": "核心", "fps": 60.0}, {"status": "备选", "duration_sec": 10.0}, {"status": "备选", "duration_sec": 10.0})
    budget = edit.targets(spark.createDataFrame([("p", "30s")], "project_id string, target string"))
    out = edit.fit_duration(decide(spark, {}), s, s.where("status = '备选'"), budget)
    total = edit.projected_duration(out, s).first()["total_sec"]
    rows = edit.final_order(out).orderBy("sequence").collect()
    assert 28.5 <= total <= 31.5 and rows[-1]["technique"] == "补充插入" and rows[0]["shot_id"] == "S000"


def test_decisions_keep_their_place_and_stay_without_a_shot(spark):
    s = shots(spark, {"status": "核心", "fps": 60.0, "quality_score": 0.9}, {"status": "核心", "quality_score": 0.2}, {"status": "强制保留", "quality_score": 0.1})
    d = decide(spark, {}, {"shot_id": "S000"}, {"shot_id": "X"}, {"shot_id": "S001", "speed": "2x"}, {"shot_id": "S002"})
    least = spark.createDataFrame([("p", 47.0)], "project_id string, target_min double")
    # 22.5 seconds before; S000 may play four times as long, twice; S001 and S002 have 24 frames
    rows = edit.extend_slow(d, s, least).orderBy("seq").collect()
    assert [(r["shot_id"], r["speed"]) for r in rows] == [("S000", "25%"), ("S000", "34%"), ("X", "1x"), ("S001", "2x"), ("S002", "1x")]
    assert len(rows) == 5 and rows[2]["notes"] == "" and edit.projected_duration(d, s).first()["total_sec"] == 22.5
    fast = {r["seq"]: r["speed"] for r in edit.compress_speed(d, s).collect()}
    assert fast == {1: "200%", 2: "200%", 3: "1x", 4: "2x", 5: "1x"}
    kept = edit.compress_drop(d, s, F.lit(12.0)).collect()  # X (quality 0) and S001 go, then both of S000
    assert sorted(r["seq"] for r in kept) == [5]
    assert {r["seq"] for r in edit.compress_drop(d, s, F.lit(15.0)).collect()} == {1, 2, 5}
    assert {r["seq"] for r in edit.protect(d, s).collect()} == {1, 2, 4, 5} and edit.guard_speed(d, s).count() == 5


def test_timeline_and_exports(spark):
    s = shots(spark, {"tc_out": "00:00:10:00"}, {})
    d = decide(spark, {"speed": "2x", "tc_out": "00:00:10:00"}, {"transition": "叠化", "notes": "n"}).withColumn("sequence", F.col("seq"))
    files = spark.createDataFrame([("/m/f0",), ("/m/f1",)], "path string")
    rows = timeline.matched(d, s, files)
    laid = timeline.layout(rows).orderBy("entry").collect()
    assert [(r["rec_in"], r["rec_out"]) for r in laid] == [("00:00:00:00", "00:00:05:00"), ("00:00:05:00", "00:00:10:00")]
    text = timeline.edl_text(rows).first()["value"]
    assert "001  F0        V     C        00:00:00:00 00:00:10:00 00:00:00:00 00:00:05:00" in text and "* SPEED: 200.0%" in text and "* TRANSITION: 叠化" in text and "* NOTES: n" in text
    assert timeline.matched(d, s, files.limit(1)).count() == 1
    xml = timeline.xml_text(rows).first()["value"]
    assert xml.count("<asset-clip") == 2 and "Cross Dissolve" in xml and xml.index('id="r2"') < xml.index('id="r3"')
    assert len(timeline.final_rows(rows).columns) == 13


def test_anchors(spark):
    members = spark.createDataFrame([("p", 0, "S1"), ("p", 0, "S2"), ("p", 1, "S3"), ("p", 2, "S4")], "project_id string, batch int, shot_id string")
    responses = spark.createDataFrame([("p", 0, '[{"shot_id":"S1","matched_beat":"b","confidence":0.9}]'), ("p", 1, "oops")], "project_id string, batch int, response string")
    got = {r["shot_id"]: (r["beat"], r["confidence"]) for r in anchors.anchors_from_responses(members, responses).collect()}
    assert got == {"S1": ("b", 0.9), "S2": ("UNMATCHED", 0.0), "S3": ("ERROR", 0.0), "S4": ("ERROR", 0.0)}
    s = shots(spark, {"location": "咖啡馆", "action": "walk home"}, {"location": "x"})
    beats = spark.createDataFrame([("p", "b1", "咖啡馆", "walk", "", ""), ("p", "b2", "街", "run", "", "")], "project_id string, beat_id string, location string, action string, emotion string, dialogue string")
    assert {r["shot_id"]: r["beat"] for r in anchors.anchor_lexical(s, beats).collect()} == {"S000": "b1", "S001": "UNMATCHED"}
