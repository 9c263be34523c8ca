"""Identities in frames: runs, overlaps, centroids and nearest persons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.functions.spans import SLOT, overlapping
from footage_lake.operators.close_pairs import PIVOTS, celled, pivots_of
from footage_lake.operators.dedup import unit

KEYS = ["project_id", "asset_id"]
UNKNOWN = "unknown"


def appearances(detections: DataFrame, gap: int = 3, fps: float = 24.0) -> DataFrame:
    """Runs of each identity whose frame steps are at most ``gap``; all unknown* count as one."""
    who = F.when(F.col("identity").startswith(UNKNOWN), UNKNOWN).otherwise(F.col("identity"))
    seen = detections.select(*KEYS, who.alias("identity"), "frame_idx", "conf")
    w = Window.partitionBy(*KEYS, "identity").orderBy("frame_idx", "conf")
    step = F.col("frame_idx") - F.lag("frame_idx").over(w)
    runs = seen.withColumn("run", F.sum(F.when(step > gap, 1).otherwise(0)).over(w))
    return runs.groupBy(*KEYS, "identity", "run").agg(
        F.round(F.min("frame_idx") / fps, 3).alias("start_sec"),
        F.round(F.max("frame_idx") / fps, 3).alias("end_sec"),
        F.count("*").alias("frame_count"),
        F.round(F.avg("conf") + 1e-9, 4).alias("confidence"),
    )


def people_in(shots: DataFrame, runs: DataFrame) -> DataFrame:
    """Sorted known names whose runs overlap the shot's start_sec..end_sec."""
    known = runs.where(F.col("identity") != UNKNOWN)
    met = overlapping(shots, known, KEYS, "start_sec", "end_sec", "start_sec", "end_sec", ["identity"], SLOT / 1e6)
    names = met.groupBy("project_id", "shot_id").agg(F.array_sort(F.collect_set("identity")).alias("people"))
    return shots.join(names, ["project_id", "shot_id"], "left").withColumn("people", F.coalesce("people", F.array().cast("array<string>")))


def centroids(gallery: DataFrame) -> DataFrame:
    """A3: mean of each person's unit vectors, renormalised. Averages by place, so no group is gathered."""
    places = gallery.select("person", F.posexplode(unit(F.col("embedding"))).alias("pos", "x"))
    mean = places.groupBy("person", "pos").agg(F.avg("x").alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return mean.groupBy("person").agg(vector.alias("v")).select("person", unit(F.col("v")).alias("centroid"))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, is_person, face_id, person, vector) sorted by place, persons first, in; the best person of each face out."""
    names, vectors, place = [], [], None
    gallery = None
    for batch in batches:
        at, persons = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(persons.astype(np.int8)) != 0)) + 1
        for k, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if at[k] != place:
                names, vectors, gallery, place = [], [], None, at[k]
            piece = batch.slice(k, to - k)
            x = piece.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)
            if persons[k]:
                names += piece.column(3).to_pylist()
                vectors.append(x)
                continue
            if not names:
                continue
            if gallery is None:
                order = sorted(range(len(names)), key=names.__getitem__)
                names, gallery = [names[o] for o in order], np.concatenate(vectors)[order]
            for low in range(0, len(x), 1024):
                near = x[low : low + 1024] @ gallery.T
                best = near.shape[1] - 1 - near[:, ::-1].argmax(axis=1)  # of equal ones the last name
                sim = near[np.arange(len(best)), best]
                rows = [piece.column(2).slice(low, len(best)), pa.array([names[b] for b in best.tolist()], pa.string()), pa.array(sim)]
                yield pa.RecordBatch.from_arrays(rows, ["face_id", "person", "similarity"])


#: Persons that one task compares with, about.
GALLERY = 10_000


def nearest_person(faces: DataFrame, persons: DataFrame, least: float = 0.65, part: int = GALLERY) -> DataFrame:
    """A4: the person of highest cosine, ``unknown`` below ``least``; of equal ones the last name.

    A gallery of over ``part`` persons is dealt to cells around pivots. A face visits its own
    cell and those that may hold a person within ``least`` of it (see ``close_pairs``), so
    the best person is found whenever it reaches ``least``; ``similarity`` is then the
    highest of all, below it the highest among the persons visited. Faces without a vector
    of the gallery's length are unknown with a null similarity; face_ids are distinct.
    """
    ready = lambda rows, name: rows.where(F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull() | F.isnan(x))).withColumn("value", unit(F.col(name))).withColumn("dims", F.size("value")).where("dims > 0")
    known, seen = ready(persons, "centroid").select(F.col("person").cast("string").alias("person"), "dims", "value"), ready(faces, "embedding").select("face_id", "dims", "value")
    sizes = [(r["dims"], r["n"]) for r in known.groupBy("dims").agg(F.count("*").alias("n")).collect()]
    kind = faces.schema["face_id"].dataType
    every = None
    for dims, n in sizes:
        own, asked = known.where(F.col("dims") == dims).drop("dims"), seen.where(F.col("dims") == dims).drop("dims")
        if n > part:
            at = pivots_of(own, min(PIVOTS, -(-n // part)))
            own, asked = celled(own, at, least).where("home"), celled(asked, at, least)
        else:
            own, asked = (rows.withColumns({"cell": F.lit(0), "home": F.lit(True)}) for rows in (own, asked))
        places = F.ceil(F.lit(n) / part / 8).cast("int")  # faces of a cell meet its persons in so many tasks
        own = own.withColumn("deal", F.explode(F.sequence(F.lit(0), places - 1))).withColumns({"is_person": F.lit(True), "face_id": F.lit(None).cast(kind)})
        asked = asked.withColumn("deal", F.pmod(F.xxhash64("face_id"), places).cast("int")).withColumns({"is_person": F.lit(False), "person": F.lit(None).cast("string")})
        columns = [F.xxhash64(F.lit(dims), "cell", "deal").alias("place"), "is_person", "face_id", "person", "value"]
        both = own.select(columns).unionByName(asked.select(columns))
        every = both if every is None else every.unionByName(both)
    if every is None:
        return faces.select("face_id", F.lit(UNKNOWN).alias("person"), F.lit(None).cast("double").alias("similarity"))
    met = every.repartition("place").sortWithinPartitions("place", F.desc("is_person")).mapInArrow(_nearest, f"face_id {kind.simpleString()}, person string, similarity double")
    best = met.groupBy("face_id").agg(F.max(F.struct("similarity", "person")).alias("best"))
    sim = F.col("best.similarity")
    named = F.when(sim >= least, F.col("best.person")).otherwise(UNKNOWN)
    return faces.select("face_id").join(best, "face_id", "left").select("face_id", named.alias("person"), sim.alias("similarity"))
