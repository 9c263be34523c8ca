"""Named queries of readers, digests, close vectors and hooks, with their DuckDB text.

Readers get files that Spark has written from the tables first.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from footage_lake.functions.staged import shared_folder
from footage_lake.operators import anchors, cuts, dedup, labels
from footage_lake.plans import bindings as b
from footage_lake.plans.catalog_queries import _scores, _vector_shots
from footage_lake.plans.edit_queries import _hashed
from footage_lake.plans.registry import query
from footage_lake.plans.source_queries import PROBED, _probed, _text, built_requests
from footage_lake.sources import catalog, tables


@query("""SELECT '/m/' || CAST(page_id AS VARCHAR) || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' ELSE '.png' END AS path FROM pages WHERE page_id % 4 <> 3""")
def image_paths(spark, d):
    """Still images among other files, each also under a name that differs in case only."""
    k = F.col("page_id")
    paths = b.read(spark, d, "pages").select(F.concat(_text("/m/", k), F.when(k % 4 == 0, ".JPG").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".png").otherwise(".mov")).alias("path"))
    again = paths.select(F.replace("path", F.lit(".JPG"), F.lit(".jpg")).alias("path"))
    return catalog.keep_media(paths.unionByName(again), catalog.IMAGE)


def _text_files(spark, d) -> str:
    """Documents as text files, a folder per language and the last digits of the id, in order of the id."""
    folder = shared_folder(spark)
    project = F.concat("lang", F.lit("-"), (F.col("doc_id") % 20).cast("string")).alias("project_id")
    rows = b.read(spark, d, "documents").select(project, "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    dealt = rows.repartition("project_id").sortWithinPartitions("project_id", "doc_id")
    dealt.select("project_id", "value").write.partitionBy("project_id").text(folder)
    return folder


FILES = "SELECT lang || '-' || CAST(doc_id % 20 AS VARCHAR) AS project_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY ALL"


@query(f"SELECT project_id, length(body) AS n_chars, md5(body) AS md5 FROM ({FILES})")
def script_files(spark, d):
    """Whole text files with their names."""
    rows = tables.read_scripts(spark, f"{_text_files(spark, d)}/*/*.txt")
    return rows.select(F.regexp_extract(F.url_decode("script_id"), "project_id=([^/]+)", 1).alias("project_id"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


@query(f"SELECT project_id, md5(body) AS md5 FROM ({FILES})")
def file_digests(spark, d):
    """Digests of files read as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_text_files(spark, d))
    return dedup.content_md5(files.where("path LIKE '%.txt'")).select(F.regexp_extract("path", "project_id=([^/]+)", 1).alias("project_id"), "md5")


#: Projects that a file of decisions holds, about.
BLOCK = 10_000


@query("""SELECT 'p' || CAST(o_custkey AS VARCHAR) AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, 'S' || CAST(o_orderkey AS VARCHAR) AS shot_id,
CASE WHEN o_orderkey % 2 = 0 THEN '1x' END AS speed FROM orders""")
def decision_files(spark, d):
    """Documents of decisions, written as JSON and read back in order."""
    k = F.col("o_orderkey")
    item = F.struct(k.alias("key"), _text("S", k).alias("shot_id"), F.when(k % 2 == 0, "1x").alias("speed"))
    rows = b.read(spark, d, "orders").groupBy(_text("p", F.col("o_custkey")).alias("project_id")).agg(F.sort_array(F.collect_list(item)).alias("timeline"))
    folder = shared_folder(spark)
    rows.write.json(folder)
    documents = spark.read.schema("project_id string, timeline array<struct<shot_id:string,speed:string>>").json(folder)
    one_a_file = shared_folder(spark)
    # a document per line is written again as a file per block of projects, each an array, which a reader of whole documents takes;
    # a folder per block, as a reader takes the first array of a file alone
    number = max(16, -(-documents.count() // BLOCK))
    blocks = documents.groupBy(F.pmod(F.crc32("project_id"), F.lit(number)).alias("block")).agg(F.to_json(F.collect_list(F.struct("project_id", "timeline"))).alias("value"))
    blocks.write.partitionBy("block").text(one_a_file)
    read = tables.read_decisions(spark, one_a_file, "struct<shot_id:string,speed:string>")
    return read.select("project_id", F.col("seq").cast("bigint").alias("seq"), "shot_id", "speed")


@query(f"""WITH a AS (SELECT *, page_id * 1000000 + 250000 AS us FROM pages WHERE {PROBED}) SELECT 'p' || CAST(page_id % 4 AS VARCHAR) AS project_id, printf('S%03d', row_number() OVER (PARTITION BY page_id % 4 ORDER BY '/m/' || CAST(page_id AS VARCHAR))) AS shot_id,
'PROCESSED' AS state, '/m/' || CAST(page_id AS VARCHAR) AS source_path, page_id + 0.25::DOUBLE AS duration_sec, 0::BIGINT AS n_tags, false AS needs_review FROM a""")
def processed_shots(spark, d):
    """One shot over each asset."""
    assets = catalog.assets_from_probe(_probed(spark, d))[0].withColumn("project_id", _text("p", F.substring("path", 4, 9).cast("int") % 4))
    rows = catalog.whole_shots(assets)
    return rows.select("project_id", "shot_id", "state", "source_path", "duration_sec", F.size("tags").cast("bigint").alias("n_tags"), "needs_review")


@query("""SELECT 'p' || CAST(user_id % 8 AS VARCHAR) AS project_id, CAST(user_id AS VARCHAR) AS asset_id, event_type AS action, 'e' || CAST(event_id % 3 AS VARCHAR) AS emotion, 0::BIGINT AS n_characters, '' AS dialogue, count(*) AS n FROM events GROUP BY ALL""")
def label_fields(spark, d):
    """Frame labels under the names of shot fields."""
    named = b.read(spark, d, "events").select(
        _text("p", F.col("user_id") % 8).alias("project_id"), F.col("user_id").cast("string").alias("asset_id"), F.lit("").alias("shot_size"), F.lit("").alias("camera_movement"), F.lit("").alias("location"), F.lit("").alias("time_of_day"),
        _text("e", F.col("event_id") % 3).alias("emotion"), F.col("event_type").alias("action"),
    )
    rows = labels.labels_to_shot(named)
    return rows.groupBy("project_id", "asset_id", "action", "emotion", F.size("characters").cast("bigint").alias("n_characters"), "dialogue").agg(F.count("*").alias("n"))


@query("""WITH docs AS (SELECT lang AS project_id, source AS beat, doc_id AS idx, left(md5(left(text, 3)), 14) || printf('%02x', doc_id % 256) AS h FROM documents),
p AS (SELECT a.project_id, a.beat, a.idx AS i, b.idx AS j, CAST(list_sum(list_transform(range(1, 17), lambda k: CASE WHEN a.h[k] <> b.h[k] THEN 1 ELSE 0 END)) AS BIGINT) AS distance FROM docs a JOIN docs b ON a.project_id = b.project_id AND a.beat = b.beat AND a.idx < b.idx)
SELECT * FROM p WHERE distance <= 10""")
def phash_digit_pairs(spark, d):
    """D5 and F10 in digits."""
    rows = dedup.hash_pairs(_hashed(spark, d), 10, "hex", related=False, shots=False)
    return rows.select("project_id", "beat", "i", "j", F.col("distance").cast("bigint").alias("distance"))


CLOSE = """u AS (SELECT label, vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:4], lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
near AS (SELECT CAST(a.label AS VARCHAR) AS beat, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_dot_product(a.v, b.v) >= 0.92 AND NOT (a.vec_id % 6 = 0 AND b.vec_id = a.vec_id + 10) AND a.vec_id // 7 <> b.vec_id // 7)"""


def _close_shots(spark, d):
    """Shots by the first four dimensions; of one file or strongly linked ones are related."""
    k = F.col("idx")
    after = F.struct((k + 10).cast("string").alias("shot_id"), F.lit("情绪延续").alias("relationship_type"), F.lit(0.1).alias("coherence_score"))
    rows = _vector_shots(spark, d).withColumn("vector", F.slice("vector", 1, 4)).withColumn("source_file", F.expr("cast(idx div 7 as string)"))
    return rows.withColumn("next", F.when(k % 6 == 0, after)).withColumns({"status": F.when(k % 11 == 0, dedup.CORE).otherwise(dedup.CANDIDATE), "dedup_reason": F.lit("")})


@query(f"WITH {CLOSE} SELECT beat, i, j, round(similarity, 5) AS similarity FROM near")
def dedup_vector_related(spark, d):
    """D6 at its own threshold, with related pairs left out."""
    return dedup.vector_pairs(_close_shots(spark, d)).select("beat", "i", "j", F.round("similarity", 5).alias("similarity"))


@query(f"""WITH RECURSIVE {CLOSE},
p AS (SELECT beat, i, j, CAST(i % 10 AS DOUBLE) >= CAST(j % 10 AS DOUBLE) AS first_wins, row_number() OVER (PARTITION BY beat ORDER BY i, j) AS k FROM near WHERE i % 11 <> 0 AND j % 11 <> 0),
walk AS (SELECT DISTINCT beat, 0::BIGINT AS k, []::BIGINT[] AS gone, NULL::BIGINT AS lost, NULL::BIGINT AS kept FROM p
  UNION ALL SELECT beat, k, CASE WHEN live THEN list_append(gone, CASE WHEN first_wins THEN j ELSE i END) ELSE gone END, CASE WHEN live THEN CASE WHEN first_wins THEN j ELSE i END END, CASE WHEN live THEN CASE WHEN first_wins THEN i ELSE j END END
  FROM (SELECT p.*, w.gone, NOT list_contains(w.gone, p.i) AND NOT list_contains(w.gone, p.j) AS live FROM walk w JOIN p ON p.beat = w.beat AND p.k = w.k + 1))
SELECT CAST(vec_id AS VARCHAR) AS shot_id, CASE WHEN lost IS NOT NULL THEN '废弃' WHEN vec_id % 11 = 0 THEN '核心' ELSE '候选' END AS status, CASE WHEN lost IS NULL THEN '' ELSE 'L3语义重复: 与 ' || CAST(kept AS VARCHAR) END AS dedup_reason
FROM embeddings LEFT JOIN (SELECT * FROM walk WHERE lost IS NOT NULL) ON lost = vec_id""")
def dedup_group_vectors(spark, d):
    """D8 with the vector step alone."""
    return dedup.dedup_group(_close_shots(spark, d), hashes=False, vectors=True).select("shot_id", "status", "dedup_reason")


@query("""SELECT project_id, batch, md5(request) AS response FROM (SELECT project_id, batch, 'Rows:' || chr(10) || string_agg(text, chr(10) ORDER BY pos) AS request FROM
(SELECT lang AS project_id, doc_id // 10 AS batch, doc_id AS pos, left(md5(text), 6) AS text FROM documents) GROUP BY ALL)""")
def model_responses(spark, d):
    """A user's function over request texts."""
    return anchors.apply_user_model(built_requests(spark, d), lambda text: hashlib.md5(text.encode()).hexdigest())


@query(f"""WITH {b.FS}, t AS (SELECT project_id, asset_id, duration_us / 1e6 AS d FROM assets), p AS (SELECT DISTINCT project_id, asset_id, at_sec FROM (SELECT *, unnest(CASE WHEN floor(d * 2) <= 11 THEN list_transform(range(CAST(floor(d * 2) AS BIGINT)), lambda k: round(k / 2.0::DOUBLE, 3))
ELSE list_transform(range(11), lambda k: round(k * d / 11, 3)) END) AS at_sec FROM t) WHERE at_sec < d)
SELECT project_id, asset_id, row_number() OVER (PARTITION BY project_id, asset_id ORDER BY at_sec) - 1 AS frame_seq, at_sec FROM p""")
def frame_plan_spaced(spark, d):
    """Evenly spaced where a rate would take more."""
    _, assets = _scores(spark, d)
    return cuts.frame_plan(assets, 2.0, 11).select(*cuts.KEYS, F.col("frame_seq").cast("bigint").alias("frame_seq"), "at_sec")
