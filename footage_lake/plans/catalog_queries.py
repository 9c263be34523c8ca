"""Named queries over the driver's tables, with DuckDB text for each that SQL can say."""

from __future__ import annotations

from pyspark.sql import functions as F

from footage_lake.functions import timecode as tc
from footage_lake.functions.staged import staged
from footage_lake.operators import anchors, cuts, dedup, edit, labels, people, quality, relations, segments, selection, timeline
from footage_lake.plans import bindings as b
from footage_lake.plans.registry import query
from footage_lake.sources import adapters, catalog

# ---------------------------------------------------------------- cuts

BASE = f"""{b.FS},
base AS (SELECT project_id, asset_id, cut_score + 0.05 AS baseline FROM
  (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY cut_score, t_us) AS rn, count(*) OVER (PARTITION BY asset_id) AS n FROM fs)
  WHERE rn - 1 = floor(n * 0.25))"""
REGIONS = f"""{BASE},
high AS (SELECT fs.*, t_us - lag(t_us) OVER (PARTITION BY asset_id ORDER BY t_us) AS step FROM fs JOIN base USING (project_id, asset_id) WHERE cut_score >= baseline),
regions AS (SELECT project_id, asset_id, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n_points, max(cut_score) AS peak FROM
  (SELECT *, sum(CASE WHEN step > 150000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY t_us) AS island FROM high)
  GROUP BY project_id, asset_id, island HAVING max(t_us) - min(t_us) >= 600000)"""


def peaks_sql(source: str, keys: str, out: str, fallback: bool = True) -> str:
    near = "CASE WHEN nn > 0 THEN ns / nn ELSE 0 END" if fallback else "NULL"
    w = f"OVER (PARTITION BY {keys} ORDER BY t_us RANGE BETWEEN"
    return f"""{out} AS (SELECT *, coalesce(before < cut_score, true) AND coalesce(after <= cut_score, true) AND n_near >= 3 AS is_max,
  cut_score - CASE WHEN cn >= 3 THEN cs / cn ELSE {near} END AS prominence FROM (SELECT *,
  max(cut_score) {w} 100000 PRECEDING AND 1 PRECEDING) AS before, max(cut_score) {w} 1 FOLLOWING AND 100000 FOLLOWING) AS after,
  count(*) {w} 100000 PRECEDING AND 100000 FOLLOWING) AS n_near,
  count(*) {w} 500000 PRECEDING AND 100001 PRECEDING) + count(*) {w} 100001 FOLLOWING AND 500000 FOLLOWING) AS cn,
  coalesce(sum(cut_score) {w} 500000 PRECEDING AND 100001 PRECEDING), 0) + coalesce(sum(cut_score) {w} 100001 FOLLOWING AND 500000 FOLLOWING), 0) AS cs,
  count(*) {w} 100000 PRECEDING AND 1 PRECEDING) + count(*) {w} 1 FOLLOWING AND 100000 FOLLOWING) AS nn,
  coalesce(sum(cut_score) {w} 100000 PRECEDING AND 1 PRECEDING), 0) + coalesce(sum(cut_score) {w} 1 FOLLOWING AND 100000 FOLLOWING), 0) AS ns
  FROM {source}))"""


PEAKS = f"{REGIONS},\n{peaks_sql('fs', 'asset_id', 'peaks')}"
OUTSIDE = "NOT EXISTS (SELECT 1 FROM regions r WHERE r.asset_id = {p}.asset_id AND {p}.t_us >= r.start_us + 50000 AND {p}.t_us <= r.end_us - 50000)"


def merged_sql(source: str, out: str, score: str = "cut_score") -> str:
    return f"""{out} AS (SELECT project_id, asset_id, arg_max(t_us, ({score}, -t_us)) AS t_us, max({score}) AS cut_score FROM
  (SELECT *, sum(CASE WHEN step > 300000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY t_us) AS island FROM
    (SELECT *, t_us - lag(t_us) OVER (PARTITION BY asset_id ORDER BY t_us) AS step FROM {source})) GROUP BY project_id, asset_id, island)"""


HARD = f"""{PEAKS},
cand AS (SELECT * FROM peaks p WHERE is_max AND prominence >= 0.25 AND {OUTSIDE.format(p='p')}),
{merged_sql('cand', 'hard')}"""
REFINED = f"""{HARD},
spans AS (SELECT project_id, asset_id, t AS start_us, lead(t) OVER (PARTITION BY asset_id ORDER BY t) AS end_us FROM
  (SELECT project_id, asset_id, t_us AS t FROM hard UNION SELECT project_id, asset_id, 0 FROM assets WHERE asset_id IN (SELECT asset_id FROM hard)
   UNION SELECT project_id, asset_id, duration_us FROM assets WHERE asset_id IN (SELECT asset_id FROM hard))),
inside AS (SELECT fs.*, s.start_us AS span FROM fs JOIN spans s ON fs.asset_id = s.asset_id AND s.end_us - s.start_us > 3500000
  AND fs.t_us BETWEEN s.start_us - 50000 AND s.end_us + 50000),
{peaks_sql('inside', 'asset_id, span', 'weak', False)},
extra AS (SELECT project_id, asset_id, span, arg_max(t_us, (prominence, -t_us)) AS t_us FROM weak p WHERE is_max AND prominence >= 0.10 AND {OUTSIDE.format(p='p')}
  AND NOT EXISTS (SELECT 1 FROM hard h WHERE h.asset_id = p.asset_id AND abs(h.t_us - p.t_us) <= 300000) GROUP BY ALL),
every AS (SELECT project_id, asset_id, t_us, 0.0 AS zero FROM hard UNION SELECT project_id, asset_id, t_us, 0.0 FROM extra),
{merged_sql('every', 'refined', 'zero')}"""
TIMES = f"""{REFINED},
listed AS (SELECT a.project_id, a.asset_id, a.duration_us, list_sort(list_distinct(list_concat([0::BIGINT, a.duration_us], coalesce(r.ts, [])))) AS l
  FROM assets a LEFT JOIN (SELECT asset_id, list(t_us) AS ts FROM refined GROUP BY asset_id) r USING (asset_id)),
kept AS (SELECT *, list_reduce(list_transform(l[2:len(l) - 1], lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 1000000 THEN list_concat(acc, x) ELSE acc END, [0::BIGINT]) AS k FROM listed),
times AS (SELECT project_id, asset_id, duration_us, list_append(CASE WHEN len(k) > 1 AND duration_us - k[len(k)] < 1000000 THEN k[1:len(k) - 1] ELSE k END, duration_us) AS t FROM kept),
shots AS (SELECT project_id, asset_id, i AS seq, t[i + 1] AS start_us, t[i + 2] AS end_us FROM (SELECT *, unnest(range(len(t) - 1)) AS i FROM times))"""


def _scores(spark, d):
    fs = b.frame_scores(spark, d)
    return fs, b.assets(fs)


def _refined(spark, d):
    fs = staged(b.frame_scores(spark, d))
    assets = staged(b.assets(fs))
    return *cuts.refined_cuts(fs, assets), assets


def _cut_shots(spark, d):
    refined, regions, assets = _refined(spark, d)
    return cuts.shots_from_cuts(staged(cuts.kept_cuts(refined, assets))), regions, assets


@query(f"WITH {BASE} SELECT project_id, asset_id, round(baseline, 6) AS baseline FROM base")
def cut_baseline(spark, d):
    return cuts.baseline(b.frame_scores(spark, d)).withColumn("baseline", F.round("baseline", 6))


@query(f"WITH {REGIONS} SELECT project_id, asset_id, start_us, end_us, n_points, round(peak, 6) AS peak FROM regions")
def cut_activity_regions(spark, d):
    return cuts.activity_regions(b.frame_scores(spark, d)).withColumn("peak", F.round("peak", 6))


@query(f"WITH {REGIONS} SELECT project_id, asset_id, t_us FROM fs WHERE {OUTSIDE.format(p='fs')}")
def cut_outside_regions(spark, d):
    fs = b.frame_scores(spark, d)
    return cuts.outside_regions(fs, cuts.activity_regions(fs)).select(*cuts.KEYS, "t_us")


@query(f"WITH {PEAKS} SELECT project_id, asset_id, t_us FROM peaks WHERE is_max")
def cut_local_maxima(spark, d):
    return cuts.local_maxima(b.frame_scores(spark, d)).where("is_max").select(*cuts.KEYS, "t_us")


@query(f"WITH {PEAKS} SELECT project_id, asset_id, t_us, round(prominence + 1e-9, 6) AS prominence FROM peaks")
def cut_prominence(spark, d):
    return cuts.prominence(b.frame_scores(spark, d)).select(*cuts.KEYS, "t_us", F.round(F.col("prominence") + 1e-9, 6).alias("prominence"))


@query(f"WITH {HARD} SELECT project_id, asset_id, t_us, round(cut_score, 6) AS cut_score FROM hard")
def cut_candidates_merged(spark, d):
    return cuts.hard_cuts(b.frame_scores(spark, d)).select(*cuts.KEYS, "t_us", F.round("cut_score", 6).alias("cut_score"))


@query(f"WITH {REFINED} SELECT project_id, asset_id, t_us FROM refined")
def cut_refined(spark, d):
    return _refined(spark, d)[0]


@query(f"WITH {TIMES} SELECT project_id, asset_id, array_to_string(t, ',') AS times FROM times")
def cut_times_min_shot(spark, d):
    refined, _, assets = _refined(spark, d)
    return cuts.cut_times(refined, assets).select(*cuts.KEYS, F.array_join(F.col("times").cast("array<string>"), ",").alias("times"))


@query(f"""WITH {TIMES} SELECT project_id, asset_id, seq, 'S' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS shot_id, start_us, end_us, round((end_us - start_us) / 1e6, 3) AS duration_sec
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY asset_id, start_us) AS n FROM shots)""")
def shots_from_cuts(spark, d):
    return _cut_shots(spark, d)[0].drop("tc_in", "tc_out").withColumn("seq", F.col("seq").cast("bigint"))


@query(f"""WITH {TIMES} SELECT s.project_id, s.asset_id, s.start_us, count(r.start_us) AS n_transitions, min(r.start_us) AS first_us FROM shots s LEFT JOIN regions r
ON r.asset_id = s.asset_id AND r.start_us >= s.start_us - 50000 AND r.end_us <= s.end_us + 50000 GROUP BY ALL""")
def shot_soft_transitions(spark, d):
    shots, regions, _ = _cut_shots(spark, d)
    rows = cuts.attach_transitions(shots, regions)
    return rows.select(*cuts.KEYS, "start_us", F.size("soft_transitions").cast("bigint").alias("n_transitions"), F.get("soft_transitions", F.lit(0))["start_us"].alias("first_us"))


@query(f"""WITH {TIMES} SELECT project_id, asset_id, count(*) AS n_shots, round(sum(round((end_us - start_us) / 1e6, 3)), 3) AS total_sec FROM shots GROUP BY ALL""")
def asset_summary(spark, d):
    return cuts.asset_summary(_cut_shots(spark, d)[0]).select(*cuts.KEYS, "n_shots", "total_sec")


@query(f"""WITH {b.FS} SELECT project_id, asset_id, sum(CASE WHEN calm THEN 1 ELSE 0 END)::BIGINT AS n_hard, sum(CASE WHEN calm THEN 0 ELSE 1 END)::BIGINT AS n_ambiguous FROM (SELECT *,
coalesce(max(cut_score) OVER (PARTITION BY asset_id ORDER BY t_us RANGE BETWEEN 200000 PRECEDING AND 1 PRECEDING), 0) < 0.15 AND
coalesce(max(cut_score) OVER (PARTITION BY asset_id ORDER BY t_us RANGE BETWEEN 1 FOLLOWING AND 200000 FOLLOWING), 0) < 0.15 AS calm FROM fs) GROUP BY ALL""")
def cut_classify(spark, d):
    rows = cuts.classify_cuts(b.frame_scores(spark, d))
    n = lambda k: F.count_if(F.col("cut_class") == k)
    return rows.groupBy(*cuts.KEYS).agg(n("hard_cut").alias("n_hard"), n("ambiguous").alias("n_ambiguous"))


@query(f"WITH {b.FS}, high AS (SELECT * FROM fs WHERE cut_score >= 0.1), {merged_sql('high', 'top')} SELECT project_id, asset_id, t_us, round(cut_score, 6) AS cut_score FROM top")
def scene_peaks(spark, d):
    return cuts.scene_peaks(b.frame_scores(spark, d)).withColumn("cut_score", F.round("cut_score", 6))


HIST = """h AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS v FROM embeddings),
pairs AS (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM h),
flat AS (SELECT label, vec_id, unnest(v) AS x, unnest(p) AS y FROM pairs WHERE p IS NOT NULL)"""


@query(f"WITH {HIST} SELECT CAST(label AS VARCHAR) AS asset_id, vec_id AS t_us, round(greatest(0, 1 - corr(x, y)), 5) AS hist_score FROM flat GROUP BY label, vec_id")
def hist_change(spark, d):
    frames = b.read(spark, d, "embeddings").select(F.lit("p").alias("project_id"), F.col("label").cast("string").alias("asset_id"), F.col("vec_id").alias("t_us"), F.col("embedding").alias("hist"))
    return cuts.hist_change(frames).where("hist_score IS NOT NULL").select("asset_id", "t_us", F.round("hist_score", 5).alias("hist_score"))


@query(f"WITH {b.SHOTS} SELECT project_id, shot_id, unnest([0, 1, 2])::BIGINT AS frame_seq, unnest([round(duration_sec * 0.1, 3), round(duration_sec * 0.5, 3), round(duration_sec * 0.9, 3)]) AS at_sec FROM shots")
def keyframe_plan(spark, d):
    rows = b.shots(spark, d).withColumn("asset_id", F.col("source_file"))
    return cuts.keyframe_plan(rows).select("project_id", "shot_id", F.col("frame_seq").cast("bigint").alias("frame_seq"), "at_sec")


@query(f"""WITH {b.FS} SELECT project_id, asset_id, unnest(range(n)) AS frame_seq, unnest(range(n))::DOUBLE AS at_sec FROM (SELECT *, CAST(floor(duration_us / 1e6) AS BIGINT) AS n FROM assets)""")
def frame_plan(spark, d):
    _, assets = _scores(spark, d)
    return cuts.frame_plan(assets).select(*cuts.KEYS, F.col("frame_seq").cast("bigint").alias("frame_seq"), "at_sec")


# ---------------------------------------------------------------- segments

LOOK = """(SELECT max(s.seg_seq) FILTER (WHERE s.start_us <= {t} AND {t} < s.end_us) FROM segs s WHERE s.asset_id = c.asset_id)"""
SIDES = f"""{HARD}, {b.SEGMENTS},
last AS (SELECT asset_id, max(seg_seq) AS z FROM segs GROUP BY ALL),
sides AS (SELECT c.project_id, c.asset_id, c.t_us, a.duration_us, coalesce({LOOK.format(t='(c.t_us - 100000)')}, z) AS ls, coalesce({LOOK.format(t='(c.t_us + 100000)')}, z) AS rs
  FROM hard c JOIN assets a USING (asset_id) JOIN last USING (asset_id) WHERE c.t_us > 0 AND c.t_us < a.duration_us)"""


@query(f"WITH {SIDES} SELECT project_id, asset_id, t_us, ls AS left_seg, rs AS right_seg FROM sides")
def segment_lookup(spark, d):
    fs, assets = _scores(spark, d)
    points = cuts.hard_cuts(fs).join(assets, cuts.KEYS).where("t_us > 0 AND t_us < duration_us")
    segs = b.segments(fs)
    rows = segments.segment_at(segments.segment_at(points, segs, -100_000, "l"), segs, 100_000, "r")
    return rows.select(*cuts.KEYS, "t_us", F.col("l.seg_seq").alias("left_seg"), F.col("r.seg_seq").alias("right_seg"))


SCORED = f"""{SIDES},
scored AS (SELECT s.*, round(greatest(0, CASE WHEN l.cam <> r.cam THEN 0.35 ELSE 0 END + CASE WHEN l.who <> r.who THEN 0.25 ELSE 0 END + CASE WHEN l.mood <> r.mood THEN 0.15 ELSE 0 END
  + CASE WHEN l.action <> r.action THEN CASE WHEN l.action = 'sits' THEN 0.10 ELSE 0.10 END * CASE WHEN (CASE WHEN l.action = 'sits' THEN 2.0 / 4 ELSE 1.0 / 10 END) < 0.3 THEN 1 ELSE 0 END ELSE 0 END
  + CASE WHEN l.loc <> r.loc THEN 0.10 ELSE 0 END - CASE WHEN l.coherence_score > 0.7 AND r.coherence_score > 0.7 THEN 0.25 ELSE 0 END), 3)::DOUBLE AS score
  FROM sides s JOIN segs l ON l.asset_id = s.asset_id AND l.seg_seq = s.ls JOIN segs r ON r.asset_id = s.asset_id AND r.seg_seq = s.rs WHERE ls <> rs)"""
GRADE = "CASE WHEN {s} >= 0.55 THEN 'high' WHEN {s} >= 0.40 THEN 'medium' ELSE 'low' END"


def _boundaries(spark, d):
    fs, assets = _scores(spark, d)
    segs = b.segments(fs)
    return segments.score_boundaries(cuts.hard_cuts(fs).select(*cuts.KEYS, "t_us"), segs, assets), segs, assets


@query(f"WITH {SCORED} SELECT project_id, asset_id, t_us, score, {GRADE.format(s='score')} AS confidence FROM scored")
def boundary_scores(spark, d):
    return _boundaries(spark, d)[0].select(*cuts.KEYS, "t_us", F.col("score").cast("double").alias("score"), "confidence")


@query(f"""WITH {SCORED},
around AS (SELECT c.*, coalesce(lag(t_us) OVER w, 0) AS before, coalesce(lead(t_us) OVER w, duration_us) AS after, coalesce({LOOK.format(t='(c.t_us + 10000)')}, z) AS h
  FROM scored c JOIN last USING (asset_id) WINDOW w AS (PARTITION BY c.asset_id ORDER BY t_us)),
held AS (SELECT a.*, after - before >= 30000000 OR s.is_long_take OR s.coherence_score >= 0.85 AS long FROM around a JOIN segs s ON s.asset_id = a.asset_id AND s.seg_seq = a.h)
SELECT project_id, asset_id, t_us, CASE WHEN long THEN round(score - 0.15, 3) ELSE score END AS score, {GRADE.format(s='(CASE WHEN long THEN round(score - 0.15, 3) ELSE score END)')} AS confidence, long AS protected FROM held""")
def long_take_protection(spark, d):
    rows, segs, assets = _boundaries(spark, d)
    return segments.protect_long_takes(rows, segs, assets).select(*cuts.KEYS, "t_us", F.col("score").cast("double").alias("score"), "confidence", "protected")


# ---------------------------------------------------------------- shots


@query(f"WITH {b.SHOTS} SELECT project_id, shot_id, lag(shot_id) OVER w AS prev_shot, lead(shot_id) OVER w AS next_shot FROM shots WINDOW w AS (PARTITION BY project_id, source_file ORDER BY tc_in, shot_id)")
def shot_links(spark, d):
    rows = relations.source_links(b.shots(spark, d))
    return rows.select("project_id", "shot_id", F.col("prev.shot_id").alias("prev_shot"), F.col("next.shot_id").alias("next_shot"))


RELATED = f"""{b.SHOTS}, lagged AS (SELECT project_id, shot_id AS dst_shot, lag(shot_id) OVER w AS src_shot, camera_position <> lag(camera_position) OVER w AS cam, location <> lag(location) OVER w AS place,
emotion <> lag(emotion) OVER w AS mood, list_sort(list_distinct(characters)) <> list_sort(list_distinct(lag(characters) OVER w)) AS who, asr_text = 'hello' AND lag(asr_text) OVER w = 'hello' AS said
FROM shots WINDOW w AS (PARTITION BY project_id ORDER BY source_file, tc_in, shot_id)),
rel AS (SELECT *, greatest(0, least(1, round(0.8 - CASE WHEN cam THEN 0.3 ELSE 0 END - CASE WHEN place THEN 0.35 ELSE 0 END - CASE WHEN mood THEN 0.2 ELSE 0 END - CASE WHEN who THEN 0.15 ELSE 0 END + CASE WHEN said THEN 0.1 ELSE 0 END, 6))) AS sc FROM lagged WHERE src_shot IS NOT NULL)"""


@query(f"""WITH {RELATED} SELECT project_id, src_shot, dst_shot, CASE WHEN sc >= 0.75 AND NOT (cam OR place OR mood OR who OR said) THEN '情绪延续' WHEN sc >= 0.75 THEN '自然过渡' WHEN place THEN '场景切换' WHEN cam THEN '机位跳切' WHEN who THEN '动作衔接' WHEN mood THEN '情绪转折' ELSE '时间跳跃' END AS relationship_type, round(sc, 2)::DOUBLE AS coherence_score FROM rel""")
def shot_relations(spark, d):
    return relations.relations(b.shots(spark, d))


STATUS = f"""{b.SHOTS}, st AS (SELECT *, CASE WHEN beat = 'UNMATCHED' THEN '未匹配' WHEN state = 'PROCESSED' THEN '强制保留' WHEN state = 'ANALYZED' THEN '待复核' ELSE '候选' END AS status FROM shots)"""


def _marked(spark, d):
    return selection.initial_status(b.shots(spark, d))


@query(f"WITH {STATUS} SELECT project_id, shot_id, status, beat <> 'UNMATCHED' AND state = 'ANALYZED' AS needs_review FROM st")
def initial_status(spark, d):
    return _marked(spark, d).select("project_id", "shot_id", "status", "needs_review")


@query(f"""WITH {b.SHOTS} SELECT project_id, shot_id, round(10 * (0.35 * confidence + 0.20 * (visual_quality / 5) + 0.15 * (stability / 5) + 0.10 * CASE WHEN asr_text <> '' THEN 0.5 ELSE 0 END
+ 0.10 * 1.0 + 0.10 * ((CASE WHEN camera_movement <> '未知' THEN 1 ELSE 0 END + CASE WHEN action <> '' THEN 1 ELSE 0 END + 5) / 7.0)), 2)::DOUBLE AS quality FROM shots""")
def quality_score(spark, d):
    return b.shots(spark, d).select("project_id", "shot_id", quality.quality_score().alias("quality"))


@query("""SELECT doc_id, first_value(doc_id) OVER w AS kept_id, row_number() OVER w > 1 AS discarded FROM documents WINDOW w AS (PARTITION BY lang, md5(text) ORDER BY CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END DESC, n_chars DESC, doc_id)""")
def dedup_exact(spark, d):
    docs = b.read(spark, d, "documents").select(
        F.col("lang").alias("project_id"), F.col("doc_id").alias("shot_id"), F.col("doc_id").alias("idx"), F.md5("text").alias("md5"), F.lit("").alias("dedup_reason"), F.lit("候选").alias("status"),
        F.when(F.col("lang") == "en", "PROCESSED").when(F.col("lang") == "de", "ANALYZED").otherwise("RAW").alias("state"), F.col("n_chars").cast("double").alias("quality_score"),
    )
    rows = dedup.dedup_exact(docs)
    kept = F.coalesce(F.regexp_extract("dedup_reason", r"保留 (\d+)$", 1).try_cast("bigint"), F.col("shot_id"))
    return rows.select(F.col("shot_id").alias("doc_id"), kept.alias("kept_id"), (F.col("status") == dedup.DISCARDED).alias("discarded"))


def _vector_shots(spark, d):
    e = b.read(spark, d, "embeddings")
    none = F.lit(None).cast("struct<shot_id:string,relationship_type:string,coherence_score:double>")
    return e.select(
        F.lit("p").alias("project_id"), F.col("label").cast("string").alias("beat"), F.col("vec_id").alias("idx"), F.col("vec_id").cast("string").alias("shot_id"), (F.col("vec_id") % 10).cast("double").alias("quality_score"),
        F.col("vec_id").cast("string").alias("source_file"), F.lit("").alias("source_path"), F.array().cast("array<string>").alias("characters"), F.lit("").alias("direction"), none.alias("prev"), none.alias("next"), F.col("embedding").alias("vector"),
    )


@query("""WITH u AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)
SELECT CAST(a.label AS VARCHAR) AS beat, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v), 5) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.30""")
def dedup_vector_pairs(spark, d):
    return dedup.vector_pairs(_vector_shots(spark, d), 0.30, related=False, shots=False).select("beat", "i", "j", F.round("similarity", 5).alias("similarity"))


@query("""WITH h AS (SELECT lang, source, doc_id, left(md5(text), 16) AS p FROM documents)
SELECT a.lang, a.source, a.doc_id AS i, b.doc_id AS j, bit_count(xor(('0x' || left(a.p, 8))::UBIGINT, ('0x' || left(b.p, 8))::UBIGINT)) + bit_count(xor(('0x' || right(a.p, 8))::UBIGINT, ('0x' || right(b.p, 8))::UBIGINT)) AS distance
FROM h a JOIN h b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id
WHERE bit_count(xor(('0x' || left(a.p, 8))::UBIGINT, ('0x' || left(b.p, 8))::UBIGINT)) + bit_count(xor(('0x' || right(a.p, 8))::UBIGINT, ('0x' || right(b.p, 8))::UBIGINT)) <= 20""".replace("bit_count(", "CAST(bit_count(").replace("::UBIGINT))", "::UBIGINT)) AS BIGINT)"))
def phash_bit_pairs(spark, d):
    none = F.lit(None).cast("struct<shot_id:string,relationship_type:string,coherence_score:double>")
    docs = b.read(spark, d, "documents").select(
        F.col("lang").alias("project_id"), F.col("source").alias("beat"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("shot_id"), F.lit(0.0).alias("quality_score"), F.col("doc_id").cast("string").alias("source_file"),
        F.lit("").alias("source_path"), F.array().cast("array<string>").alias("characters"), F.lit("").alias("direction"), none.alias("prev"), none.alias("next"), F.substring(F.md5("text"), 1, 16).alias("phash"),
    )
    return dedup.hash_pairs(docs, 20, "bits", related=False, shots=False).select(F.col("project_id").alias("lang"), F.col("beat").alias("source"), "i", "j", F.col("distance").cast("bigint").alias("distance"))


TAKES = f"""{STATUS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, beat ORDER BY quality_score DESC, CASE WHEN status IN ('强制保留', '待复核') THEN 1 ELSE 0 END DESC, idx) AS rk FROM st WHERE status <> '未匹配'),
sel AS (SELECT *, CASE WHEN rk = 1 THEN '核心' WHEN status IN ('强制保留', '待复核') THEN status ELSE '备选' END AS final FROM ranked)"""


def _selected(spark, d):
    return selection.select_takes(_marked(spark, d))


@query(f"WITH {TAKES} SELECT project_id, beat, shot_id, final AS status FROM sel")
def take_selection(spark, d):
    return _selected(spark, d).select("project_id", "beat", "shot_id", "status")


@query(f"""WITH {TAKES} SELECT g.project_id, g.beat_id, '高' AS severity FROM (SELECT project_id, priority || '-' || CAST(unnest(range(250)) AS VARCHAR) AS beat_id FROM (SELECT DISTINCT 'p' || CAST(o_custkey % 16 AS VARCHAR) AS project_id, o_orderpriority AS priority FROM orders)) g
WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.project_id = g.project_id AND sel.beat = g.beat_id AND final = '核心')""")
def missing_beats(spark, d):
    project = F.concat(F.lit("p"), (F.col("o_custkey") % 16).cast("string")).alias("project_id")
    grid = b.read(spark, d, "orders").select(project, "o_orderpriority").distinct()
    beats = grid.select("project_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(249)), lambda n: F.concat("o_orderpriority", F.lit("-"), n.cast("string")))).alias("beat_id"), F.lit("").alias("act"), F.lit("").alias("scene"))
    return selection.missing_beats(beats, _selected(spark, d)).select("project_id", "beat_id", "severity")


@query(f"""WITH {STATUS} SELECT a.project_id, a.beat, a.shot_id AS shot_a, b.shot_id AS shot_b, array_to_string(list_sort(list_distinct(list_intersect(a.characters, b.characters))), ',') AS characters FROM st a JOIN st b
ON a.project_id = b.project_id AND a.beat = b.beat AND a.idx < b.idx AND a.sign * b.sign = -1 AND len(list_intersect(a.characters, b.characters)) > 0 WHERE a.status <> '未匹配'""")
def axis_pairs(spark, d):
    return selection.axis_warnings(_marked(spark, d))


@query(f"""WITH {TAKES}, every AS (SELECT project_id, final AS status FROM sel UNION ALL SELECT project_id, status FROM st WHERE status = '未匹配')
SELECT project_id, count(*) AS total_shots, count(*) FILTER (WHERE status IN ('核心', '备选', '强制保留', '待复核')) AS selected_shots, count(*) FILTER (WHERE status = '核心') AS core_shots, count(*) FILTER (WHERE status = '备选') AS alternate_shots,
count(*) FILTER (WHERE status = '强制保留') AS protected_shots, count(*) FILTER (WHERE status = '待复核') AS needs_review_shots, count(*) FILTER (WHERE status = '废弃') AS discarded_shots, count(*) FILTER (WHERE status = '未匹配') AS unmatched_shots FROM every GROUP BY project_id""")
def selection_report(spark, d):
    marked = _marked(spark, d)
    rest = marked.where(F.col("status") == dedup.UNMATCHED)
    return selection.selection_counts(selection.select_takes(marked).select("project_id", "status").unionByName(rest.select("project_id", "status")))


# ---------------------------------------------------------------- people and labels


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u) GROUP BY ALL)
SELECT CAST(label AS VARCHAR) AS person, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""")
def person_centroid(spark, d):
    g = b.read(spark, d, "embeddings").select(F.col("label").cast("string").alias("person"), "embedding")
    return people.centroids(g).select("person", F.posexplode("centroid").alias("pos", "v")).select("person", F.col("pos").cast("bigint").alias("pos"), F.round("v", 5).alias("x"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM u) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY pos) AS w FROM (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m) GROUP BY label),
s AS (SELECT u.vec_id, CAST(c.label AS VARCHAR) AS p, list_dot_product(u.v, c.w) AS sim FROM u CROSS JOIN c)
SELECT vec_id AS face_id, CASE WHEN max(sim) >= 0.2 THEN arg_max(p, sim) ELSE 'unknown' END AS person, round(max(sim), 5) AS similarity FROM s GROUP BY vec_id""")
def person_match(spark, d):
    e = b.read(spark, d, "embeddings")
    gallery = people.centroids(e.select(F.col("label").cast("string").alias("person"), "embedding"))
    return people.nearest_person(e.select(F.col("vec_id").alias("face_id"), "embedding"), gallery, 0.2).withColumn("similarity", F.round("similarity", 5))


RUNS = f"""{b.FS}, det AS (SELECT project_id, asset_id, t_us // 100000 AS f, cut_score AS conf, CASE WHEN i = 0 THEN 'unknown' ELSE 'person' || CAST(i AS VARCHAR) END AS identity FROM (SELECT *, CAST(floor(cut_score * 1000) AS BIGINT) % 4 AS i FROM fs)),
runs AS (SELECT project_id, asset_id, identity, run, min(f) AS a, max(f) AS z, count(*) AS frame_count, avg(conf) AS c FROM (SELECT *, sum(CASE WHEN step > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, identity ORDER BY f) AS run FROM
(SELECT *, f - lag(f) OVER (PARTITION BY asset_id, identity ORDER BY f) AS step FROM det)) GROUP BY ALL)"""


@query(f"WITH {RUNS} SELECT project_id, asset_id, identity, round(a / 10.0, 3)::DOUBLE AS start_sec, round(z / 10.0, 3)::DOUBLE AS end_sec, frame_count, round(c + 1e-9, 4) AS confidence FROM runs")
def appearances(spark, d):
    i = F.floor(F.col("cut_score") * 1000) % 4
    det = b.frame_scores(spark, d).select(*cuts.KEYS, F.expr("t_us div 100000").alias("frame_idx"), F.col("cut_score").alias("conf"), F.when(i == 0, "unknown7").otherwise(F.concat(F.lit("person"), i.cast("string"))).alias("identity"))
    return people.appearances(det, fps=10.0).drop("run")


@query(f"""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type <> '' GROUP BY ALL)
SELECT user_id, arg_max(event_type, (n, -first)) AS event_type, max(n) AS votes FROM v GROUP BY user_id""")
def vote_aggregate(spark, d):
    return labels.vote(b.read(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def dialogue_text(spark, d):
    rows = b.read(spark, d, "conversations").where("trim(text) <> ''").select(F.lit("p").alias("project_id"), F.col("conv_id").alias("asset_id"), F.col("turn").alias("start_sec"), F.col("turn").alias("seq"), "text")
    return labels.dialogue(rows).select(F.col("asset_id").alias("conv_id"), F.col("asr_text").alias("said"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def response_parse(spark, d):
    rows = b.read(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("response"))
    return labels.parse_responses(rows, "struct<k:bigint>").select("event_id", F.col("payload.k").alias("k"))


@query("""SELECT event_id, 'loc' || CAST(user_id % 5 AS VARCHAR) AS location, 'act' || event_type AS action, event_type AS emotion, 1 AS n_missing FROM events""")
def adapter_generic(spark, d):
    said = F.to_json(F.create_map(F.lit("地点"), F.concat(F.lit("loc"), (F.col("user_id") % 5).cast("string")), F.lit("内容"), F.concat(F.lit("act"), "event_type"), F.lit("mood"), F.col("event_type")))
    files = b.read(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), said.alias("content"))
    return adapters.adapt_generic(files).select(F.col("path").cast("bigint").alias("event_id"), "location", "action", "emotion", F.size("missing").alias("n_missing"))


@query("""SELECT page_id, CASE WHEN regexp_matches(list_last(string_split(url, '/')), '^[0-9]+$') THEN 'PROCESSED' WHEN starts_with(url, 'https://') THEN 'ANALYZED' ELSE 'RAW' END AS state FROM pages""".replace("list_last(string_split(url, '/'))", "string_split(url, '/')[-1]"))
def state_rules(spark, d):
    rules = spark.createDataFrame([(1, 0, "regex", "^[0-9]+$", "PROCESSED"), (3, 0, "dir", "https:/", "ANALYZED")], "tier int, rule_seq int, kind string, pattern string, state string")
    media = b.read(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return catalog.resolve_state(media, rules).select("page_id", "state")


# ---------------------------------------------------------------- edit and timeline


@query(f"WITH {b.SHOTS} SELECT project_id, shot_id, row_number() OVER (PARTITION BY project_id ORDER BY act, beat, tc_in, shot_id) AS narrative_no FROM shots")
def narrative_order(spark, d):
    return edit.narrative_order(b.shots(spark, d)).select("project_id", "shot_id", F.col("narrative_no").cast("bigint").alias("narrative_no"))


@query(f"WITH {b.SHOTS} SELECT project_id, shot_id, CASE WHEN speed_x < 1 AND fps < 60 AND state <> 'PROCESSED' THEN '1x' ELSE speed END AS speed FROM shots")
def speed_guard(spark, d):
    shots = b.shots(spark, d)
    return edit.guard_speed(b.decisions(shots), shots).select("project_id", "shot_id", "speed")


@query(f"WITH {b.SHOTS} SELECT project_id, round(sum(duration_sec / speed_x), 4) AS total_sec FROM shots GROUP BY project_id")
def projected_duration(spark, d):
    shots = b.shots(spark, d)
    return edit.projected_duration(b.decisions(shots), shots).withColumn("total_sec", F.round("total_sec", 4))


COMPRESS = f"""{STATUS}, fast AS (SELECT *, status IN ('强制保留', '待复核') AS held, duration_sec / CASE WHEN status NOT IN ('强制保留', '待复核') AND speed_x < 2 THEN 2.0 ELSE speed_x END AS len FROM st),
run AS (SELECT *, sum(len) OVER (PARTITION BY project_id) - coalesce(sum(CASE WHEN held THEN 0 ELSE len END) OVER (PARTITION BY project_id ORDER BY quality_score, idx, shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_sec,
  0.7 * sum(len) OVER (PARTITION BY project_id) AS cap FROM fast)"""


@query(f"WITH {COMPRESS} SELECT project_id, count(*) AS n_kept, round(sum(len), 3) AS total_sec FROM run WHERE held OR NOT round(left_sec, 9) > 3000 GROUP BY project_id")
def compress_to_target(spark, d):
    shots = selection.initial_status(b.shots(spark, d))
    faster = edit.compress_speed(b.decisions(shots), shots)
    kept = edit.compress_drop(faster, shots, F.lit(3000.0))
    n = kept.groupBy("project_id").agg(F.count("*").alias("n_kept"))
    return n.join(edit.projected_duration(kept, shots), "project_id").withColumn("total_sec", F.round("total_sec", 3))


LAYOUT = f"""{b.SHOTS}, tl AS (SELECT *, CAST(round(duration_sec / speed_x * 1e6) AS BIGINT) AS len_us, row_number() OVER (PARTITION BY project_id ORDER BY idx, shot_id) AS entry FROM shots),
laid AS (SELECT *, CAST(sum(len_us) OVER (PARTITION BY project_id ORDER BY entry) - len_us AS BIGINT) AS start_us FROM tl)"""


def _laid(spark, d):
    shots = b.shots(spark, d)
    return timeline.matched(b.decisions(shots).withColumn("sequence", F.col("seq")), shots)


@query(f"WITH {LAYOUT} SELECT project_id, entry, shot_id, start_us, start_us + len_us AS end_us FROM laid")
def timeline_layout(spark, d):
    return timeline.layout(_laid(spark, d)).select("project_id", F.col("entry").cast("bigint").alias("entry"), "shot_id", "start_us", "end_us")


@query(f"WITH {LAYOUT} SELECT project_id, 'r' || CAST(row_number() OVER (PARTITION BY project_id ORDER BY min(entry), source_file) + 1 AS VARCHAR) AS asset_ref, source_file FROM laid GROUP BY project_id, source_file")
def timeline_assets(spark, d):
    return timeline.xml_assets(_laid(spark, d)).drop("source_path")


@query("""SELECT o_orderkey, code, CAST(substr(code, 1, 2) AS INT) * 3600 + CAST(substr(code, 4, 2) AS INT) * 60 + CAST(substr(code, 7, 2) AS INT) + CAST(substr(code, 10) AS INT) / 24.0::DOUBLE AS seconds FROM
(SELECT o_orderkey, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((t - s) * 24) AS INT) AS VARCHAR), 2, '0') AS code
FROM (SELECT o_orderkey, o_totalprice / 7 AS t, CAST(floor(o_totalprice / 7) AS BIGINT) AS s FROM orders))""")
def timecode_roundtrip(spark, d):
    rows = b.read(spark, d, "orders").select("o_orderkey", tc.sec_to_tc(F.col("o_totalprice") / 7).alias("code"))
    return rows.withColumn("seconds", tc.tc_to_sec(F.col("code")))


@query(f"WITH {b.SHOTS} SELECT project_id, shot_id, (row_number() OVER (PARTITION BY project_id ORDER BY idx) - 1) // 20 AS batch FROM shots")
def request_batches(spark, d):
    return edit.request_batches(b.shots(spark, d), 20, "idx").select("project_id", "shot_id", F.col("batch").cast("bigint").alias("batch"))


# ---------------------------------------------------------------- scripts


@query("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), bt AS (SELECT item_id, len(t) AS n_beat, unnest(t) AS tok FROM b),
dt AS (SELECT DISTINCT doc_id, tok FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents)),
sc AS (SELECT doc_id, item_id, round(count(*) * 1.0 / any_value(n_beat), 6) AS conf FROM dt JOIN bt USING (tok) GROUP BY doc_id, item_id),
best AS (SELECT doc_id, max(conf) AS conf, arg_min(lpad(CAST(item_id AS VARCHAR), 6, '0'), (-conf, item_id)) AS beat FROM sc GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(conf, 0) >= 0.05 THEN beat ELSE 'UNMATCHED' END AS beat, CASE WHEN coalesce(conf, 0) >= 0.05 THEN conf ELSE 0 END::DOUBLE AS confidence FROM documents d LEFT JOIN best USING (doc_id)""")
def anchor_lexical(spark, d):
    docs = b.read(spark, d, "documents").select(F.lit("p").alias("project_id"), F.col("doc_id").alias("shot_id"), F.col("text").alias("action"))
    items = b.read(spark, d, "benchmark").select(F.lit("p").alias("project_id"), F.lpad(F.col("item_id").cast("string"), 6, "0").alias("beat_id"), F.col("text").alias("action"))
    return anchors.anchor_lexical(docs, items, {"action": 1.0}).select(F.col("shot_id").alias("doc_id"), "beat", "confidence")
