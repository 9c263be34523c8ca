"""Shots to script beats: a lexical matcher, stored responses, request texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from footage_lake.functions.ordered import FEW

#: Weight of a shared token by the field that it comes from.
WEIGHTS = {"location": 0.3, "action": 0.3, "emotion": 0.2, "dialogue": 0.2}


def _token_list(said: Column) -> Column:
    """Distinct words and single Chinese characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(said, F.lit(""))), F.lit(r"[\p{IsHan}]|[a-z0-9]+"), F.lit(0)))


def _tokens(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct (keys, field, token) of words and single Chinese characters."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("said")) for f in fields])
    each = rows.select(*keys, F.explode(pairs).alias("p"))
    return each.select(*keys, "p.field", F.explode(_token_list(F.col("p.said"))).alias("token"))


class _Script:
    """The beats of a project: for each field the beats of a token and the tokens of a beat."""

    def __init__(self, rows: list, weights: dict[str, float]) -> None:
        self.beats = sorted({r["beat_id"] for r in rows})
        place = {b: k for k, b in enumerate(self.beats)}
        self.fields = []
        for field, weight in weights.items():
            at: dict[str, list[int]] = {}
            for r in rows:
                if r["field"] == field:
                    at.setdefault(r["token"], []).append(place[r["beat_id"]])
            size = np.bincount([k for ks in at.values() for k in ks], minlength=len(self.beats))
            self.fields.append((weight, {t: np.array(ks) for t, ks in at.items()}, np.maximum(size, 1)))

    def near(self, tokens: list[list[str] | None]) -> tuple[np.ndarray, np.ndarray]:
        """Beats that may be the best once rounded, and their scores."""
        score, met = np.zeros(len(self.beats)), np.zeros(len(self.beats), bool)
        for (weight, at, size), said in zip(self.fields, tokens, strict=True):
            found = [at[t] for t in said or () if t in at]
            if found:
                n = np.bincount(np.concatenate(found), minlength=len(self.beats))
                score += weight * n / size
                met |= n > 0
        if not met.any():
            return np.array([], int), np.array([])
        best = np.flatnonzero(met & (score >= score[met].max() - 1e-6))
        return best, score[best]


def _scored(shots: DataFrame, beats: list, kind: DataType, weights: dict[str, float]) -> DataFrame:
    """(project_id, shot_id, beat_id, confidence) of the beats of highest overlap and of those that rounding may make equal, shot by shot."""
    by_project: dict = {}
    for r in beats:
        by_project.setdefault(r["project_id"], []).append(r)
    sent = shots.sparkSession.sparkContext.broadcast({p: _Script(rows, weights) for p, rows in by_project.items()})
    said = shots.select("project_id", "shot_id", *[_token_list(F.col(f)).alias(f"_t_{k}") for k, f in enumerate(weights)])
    names = ["project_id", "shot_id", "beat_id", "confidence"]
    schema = StructType([said.schema["project_id"], said.schema["shot_id"], StructField("beat_id", kind), StructField("confidence", DoubleType())])
    beat_type = to_arrow_type(kind)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows, ids, scores = whole.slice(at, 256), [], [], []
                for k, (project, *tokens) in enumerate(zip(batch.column(0).to_pylist(), *[c.to_pylist() for c in batch.columns[2:]], strict=True)):
                    script = sent.value.get(project)
                    if script is not None:
                        best, score = script.near(tokens)
                        rows += [k] * len(best)
                        ids += [script.beats[b] for b in best.tolist()]
                        scores += score.tolist()
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(ids, beat_type), pa.array(scores, pa.float64())], names)

    return said.mapInArrow(of_task, schema).withColumn("confidence", F.round("confidence", 6))


def anchor_lexical(shots: DataFrame, beats: DataFrame, weights: dict[str, float] | None = None, floor: float = 0.05, most: int = FEW) -> DataFrame:
    """The beat of highest weighted token overlap; below ``floor`` UNMATCHED.

    Beats of a script are few: up to ``most`` tokens they are sent to the shots, and each
    shot counts its shared tokens by itself, so no row is made for a shot and a beat that
    is not its best. Longer scripts are joined on (project, field, token), so only shots and
    beats that share a token meet. A field's share is shared tokens over the beat's tokens
    in it. Ties: the first beat.
    """
    w = weights or WEIGHTS
    fields = list(w)
    b = _tokens(beats.where("project_id IS NOT NULL AND beat_id IS NOT NULL"), ["project_id", "beat_id"], fields)
    held = b.limit(most + 1).collect()
    if len(held) <= most:
        scored = _scored(shots, held, beats.schema["beat_id"].dataType, w)
    else:
        s = _tokens(shots, ["project_id", "shot_id"], fields)
        size = b.groupBy("project_id", "beat_id", "field").agg(F.count("*").alias("n_beat"))
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in w.items() for x in kv]), F.col("field"))
        common = s.join(b, ["project_id", "field", "token"]).groupBy("project_id", "shot_id", "beat_id", "field").agg(F.count("*").alias("n"))
        scored = common.join(size, ["project_id", "beat_id", "field"]).groupBy("project_id", "shot_id", "beat_id").agg(
            F.round(F.sum(weight * F.col("n") / F.col("n_beat")), 6).alias("confidence")
        )
    best = scored.groupBy("project_id", "shot_id").agg(F.max("confidence").alias("confidence"), F.min_by("beat_id", F.struct(-F.col("confidence"), F.col("beat_id"))).alias("beat"))
    rows = shots.select("project_id", "shot_id").join(best, ["project_id", "shot_id"], "left")
    good = F.coalesce(F.col("confidence") >= floor, F.lit(False))
    return rows.select("project_id", "shot_id", F.when(good, F.col("beat")).otherwise("UNMATCHED").alias("beat"), F.when(good, F.col("confidence")).otherwise(0.0).alias("confidence"))


def anchors_from_responses(members: DataFrame, responses: DataFrame) -> DataFrame:
    """Anchors of batch members (project_id, batch, shot_id) from JSON lists per batch.

    ``matched_beat`` and ``matched_act`` serve too; a batch whose response does not
    parse gives ERROR to all members, members that it leaves out are UNMATCHED.
    """
    schema = "array<struct<shot_id:string,beat:string,matched_beat:string,act:string,matched_act:string,function:string,confidence:double,reasoning:string>>"
    ok = F.try_parse_json("response").isNotNull()
    parsed = responses.select("project_id", "batch", F.when(ok, F.from_json("response", schema)).alias("items"))
    rows = members.join(parsed, ["project_id", "batch"], "left")
    own = F.get(F.filter("items", lambda x: x["shot_id"] == F.col("shot_id")), F.lit(0))
    rows = rows.withColumn("own", own)
    beat = F.when(F.col("items").isNull(), "ERROR").otherwise(F.coalesce(F.expr("nullif(own.beat, '')"), F.expr("nullif(own.matched_beat, '')"), F.lit("UNMATCHED")))
    return rows.select(
        "project_id", "shot_id", beat.alias("beat"), F.coalesce("own.act", "own.matched_act", F.lit("")).alias("act"), F.coalesce("own.function", F.lit("")).alias("function"),
        F.coalesce("own.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("own.reasoning", F.lit("")).alias("reasoning"),
    )


def attach_anchors(shots: DataFrame, anchors: DataFrame) -> DataFrame:
    """Shots with beat, act, function and confidence; UNMATCHED where there is no anchor."""
    a = anchors.select("project_id", "shot_id", "beat", "act", "function", "confidence")
    rest = shots.drop("beat", "act", "function", "confidence")
    return rest.join(a, ["project_id", "shot_id"], "left").withColumns({"beat": F.coalesce("beat", F.lit("UNMATCHED")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def build_requests(batched: DataFrame, template: str) -> DataFrame:
    """The request text of each batch (project_id, batch, pos, text), rows in order, one a line."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n")
    return batched.groupBy("project_id", "batch").agg(F.count("*").alias("n_rows"), F.replace(F.lit(template), F.lit("{rows}"), lines).alias("request"))


def apply_user_model(requests: DataFrame, call) -> DataFrame:
    """``call`` maps a request text to a response text; batches run where their rows are."""

    def of_batch(batches):
        for rows in batches:
            yield rows[["project_id", "batch"]].assign(response=[call(t) for t in rows["request"]])

    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("project_id", "batch")}
    return requests.select("project_id", "batch", "request").mapInPandas(of_batch, f"project_id {kinds['project_id']}, batch {kinds['batch']}, response string")
