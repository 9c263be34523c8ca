"""Duplicate takes: equal content, close perceptual hashes, close vectors.

Shots carry ``idx``, their input order in the project, which is distinct there; ties
and the greedy choice depend on it. Pairs are formed inside (project, beat) of numbers
and hashes or vectors alone; only the close ones get their shots by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.functions.ordered import few, numbered
from footage_lake.functions.staged import staged
from footage_lake.functions.timecode import direction_sign
from footage_lake.operators import takes_walk
from footage_lake.operators.close_pairs import CELL, PART, Measure, close_pairs

DISCARDED, PROTECTED, REVIEW, CANDIDATE, CORE, ALTERNATE, UNMATCHED = "废弃", "强制保留", "待复核", "候选", "核心", "备选", "未匹配"
STRONG = ["情绪延续", "动作衔接", "对话衔接"]


def content_md5(files: DataFrame) -> DataFrame:
    """Digest of each file read with the binaryFile source."""
    return files.select("path", F.md5("content").alias("md5"))


def state_priority(state: Column) -> Column:
    return F.when(state == "PROCESSED", 3).when(state == "ANALYZED", 2).otherwise(1)


def dedup_exact(shots: DataFrame, md5: str = "md5") -> DataFrame:
    """Of shots with equal content the best (state, quality, first seen) stays; others are discarded.

    Shots without a digest are left as they are, and so are the core and the protected ones.
    """
    alone = shots.where(F.col(md5).isNull())
    w = Window.partitionBy("project_id", md5)
    order = w.orderBy(state_priority(F.col("state")).desc(), F.col("quality_score").desc(), "idx")
    rows = shots.where(F.col(md5).isNotNull()).withColumn("rank_in_copies", F.row_number().over(order)).withColumn("keeper", F.first("shot_id").over(order))
    lost = (F.col("rank_in_copies") > 1) & ~F.col("status").isin(CORE, PROTECTED)
    reason = F.concat(F.lit("L1文件级重复(MD5 "), F.substring(md5, 1, 8), F.lit("...): 保留 "), F.col("keeper"))
    return (
        rows.withColumn("dedup_reason", F.when(lost, reason).otherwise(F.col("dedup_reason")))
        .withColumn("status", F.when(lost, DISCARDED).otherwise(F.col("status")))
        .drop("rank_in_copies", "keeper")
        .unionByName(alone)
    )


def direction_conflict(a: Column, b: Column) -> Column:
    """A shared character seen in opposite directions."""
    none = F.array().cast("array<string>")
    shared = F.arrays_overlap(F.coalesce(a["characters"], none), F.coalesce(b["characters"], none))
    sa, sb = direction_sign(a["direction"]), direction_sign(b["direction"])
    return F.coalesce(shared, F.lit(False)) & (sa != 0) & (sa == -sb)


def are_related(a: Column, b: Column) -> Column:
    """D3: pairs that never count as duplicates; reads only the links of ``a``, the earlier row."""

    def linked(side: str) -> Column:
        link = a[side]
        strong = (link["coherence_score"] >= 0.6) | link["relationship_type"].isin(STRONG)
        return F.coalesce((link["shot_id"] == b["shot_id"]) & strong, F.lit(False))

    same_file = a["source_file"].eqNullSafe(b["source_file"]) & a["source_path"].eqNullSafe(b["source_path"])
    return (a["shot_id"] == b["shot_id"]) | linked("prev") | linked("next") | same_file | direction_conflict(a, b)


#: Columns that a pair carries.
PAIR = ["idx", "shot_id", "quality_score", "source_file", "source_path", "characters", "direction", "prev", "next"]


def _told(found: DataFrame, candidates: DataFrame, value: str, related: bool, shots: bool) -> DataFrame:
    """Close pairs (project_id, beat, i, j, value) with the shots and qualities of both; related ones go. Bare numbers, which need no join, unless ``shots``."""
    if not (shots or related):
        return found.withColumnRenamed("value", value)
    side = lambda n: candidates.select(F.col("project_id").alias(f"{n}_project"), F.col("beat").alias(f"{n}_beat"), F.struct(*PAIR).alias(n))
    at = lambda n, k: (F.col("project_id") == F.col(f"{n}_project")) & (F.col("beat") == F.col(f"{n}_beat")) & (F.col(k) == F.col(f"{n}.idx"))
    rows = found.join(side("a"), at("a", "i")).join(side("b"), at("b", "j"))
    a, b = F.col("a"), F.col("b")
    if related:
        rows = rows.where(~are_related(a, b))
    return rows.select("project_id", "beat", "i", "j", a["shot_id"].alias("shot_a"), b["shot_id"].alias("shot_b"), a["quality_score"].alias("q_a"), b["quality_score"].alias("q_b"), F.col("value").alias(value))


#: Shots of a beat up to which all are compared with all; in larger ones hashes meet by their segments.
FEW_SHOTS = 512
#: Bits in which a segment of two hashes may differ to be looked up.
_FLIPS = 2


def _budgets(most: int) -> list[int]:
    """Per 16-bit segment the bits that may differ: hashes that differ in ``most`` bits keep one of these; -1: not looked up."""
    whole, over = divmod(most + 1, 4)
    return [whole - (k >= over) for k in range(4)]


def _by_segments(rows: DataFrame, most: int) -> DataFrame:
    """Pairs of rows (project_id, beat, idx, value) whose 64-bit values differ in ``most`` bits, up to 11.

    A segment is looked up under itself and under each flip of one bit, on both sides: two
    that differ in two bits meet halfway. A pair counts in its first segment within budget
    only, and there only where the earlier row has the lower flip (or neither has one).
    """
    budgets = _budgets(most)
    segment = lambda v, k: F.shiftrightunsigned(v, 16 * k).bitwiseAND(F.lit(65535))
    flips = lambda n: F.array(*[F.lit(0 if b == 0 else 1 << b - 1).cast("bigint") for b in range(17 if n else 1)])

    def side(n: str) -> DataFrame:
        """The earlier row of a pair needs no flip where one bit may differ."""
        looked = [_looked(F.col("value"), k, t, n) for k, t in enumerate(budgets) if t >= 0]
        each = rows.select("project_id", "beat", "idx", "value", F.explode(F.flatten(F.array(*looked))).alias("at"))
        return each.select(*[F.col(c).alias(f"{n}_{c}") for c in ("project_id", "beat", "idx", "value")], *[F.col(f"at.{c}").alias(f"{n}_{c}") for c in ("segment", "key", "flip")])

    def _looked(value: Column, k: int, budget: int, n: str) -> Column:
        every = flips(budget > (1 if n == "a" else 0))
        return F.transform(every, lambda f: F.struct(F.lit(k).alias("segment"), segment(value, k).bitwiseXOR(f).alias("key"), f.alias("flip")))

    c = F.col
    x = c("a_value").bitwiseXOR(c("b_value"))
    earlier = F.lit(False)
    for k, t in enumerate(budgets):
        earlier = earlier | ((c("a_segment") > k) & (F.bit_count(segment(x, k)) <= t))
    on = [c(f"a_{n}") == c(f"b_{n}") for n in ("project_id", "beat", "segment", "key")]
    once = (c("a_flip") < c("b_flip")) | ((c("a_flip") == 0) & (c("b_flip") == 0))
    test = (c("a_idx") < c("b_idx")) & once & ~earlier & (F.bit_count(x) <= most)
    met = side("a").join(side("b"), reduce(and_, on) & test)
    return met.select(c("a_project_id").alias("project_id"), c("a_beat").alias("beat"), c("a_idx").alias("i"), c("b_idx").alias("j"), F.bit_count(x).cast("double").alias("value"))


_HASHED = "phash RLIKE '^[0-9a-fA-F]{16}$'"


def _number() -> Column:
    """The hash as a 64-bit number."""
    half = lambda k: F.conv(F.substring("phash", k, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hash_pairs(candidates: DataFrame, most: int = 10, mode: str = "bits", related: bool = True, shots: bool = True) -> DataFrame:
    """Pairs of candidates in a beat whose hashes (16 hex digits) differ in ``most`` places, bits or digits.

    In beats of over ``FEW_SHOTS`` shots, hashes within 11 bits meet by a segment of 16
    bits that differs in two at most; other beats, wider distances and digits compare
    all hashes of a beat on arrays, in parts. Without ``shots``, pairs are told as numbers,
    and related ones are left out where they are found.
    """
    if related and not shots:
        rows = _takes(candidates.where(_HASHED), _number(), F.lit(1))
        found = takes_walk.pairs(rows, Measure("bits" if mode == "bits" else "digits", most))
        return found.withColumnRenamed("value", "distance").withColumn("distance", F.col("distance").cast("int"))
    rows = candidates.where(_HASHED).select("project_id", "beat", F.col("idx").cast("bigint").alias("idx"), _number().alias("value"))
    kind = Measure("bits" if mode == "bits" else "digits", most)
    if mode != "bits" or most > 4 * (_FLIPS + 1) - 1:
        found = close_pairs(rows, kind)
    else:
        sizes = rows.groupBy("project_id", "beat").agg(F.count("*").alias("n"))
        marked = rows.join(few(sizes), ["project_id", "beat"])
        found = close_pairs(marked.where(F.col("n") <= FEW_SHOTS), kind).unionByName(_by_segments(marked.where(F.col("n") > FEW_SHOTS), most))
    return _told(found, candidates, "distance", related, shots).withColumn("distance", F.col("distance").cast("int"))


def unit(vector: Column) -> Column:
    """The vector over its length, which is taken once, not for each entry; a zero vector stays as it is."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    over = lambda v, norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    pair = F.transform(F.array(F.transform(vector, lambda x: x.cast("double"))), lambda v: F.struct(v.alias("v"), length(v).alias("norm")))
    return F.get(F.transform(pair, lambda p: over(p["v"], p["norm"])), F.lit(0))


def _whole(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def vector_pairs(candidates: DataFrame, least: float = 0.92, related: bool = True, cell: int = CELL, part: int = PART, shots: bool = True) -> DataFrame:
    """Pairs of candidates in a beat with cosine ``least`` or more; vectors are normalised once.

    Exact: beats of over ``cell`` vectors are dealt to cells around pivots, with the vectors
    near a border in both. Vectors with a null entry have no pair.
    """
    rows = _whole(candidates).select("project_id", "beat", "idx", unit(F.col("vector")).alias("value"))
    return _told(close_pairs(rows, Measure("cosine", least), part, cell), candidates, "similarity", related, shots)


#: Close pairs of a beat that are walked in one run.
WALK = 200_000


def _walk(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Pairs in order in, told apart by project, beat and block; what each removes out. ``gone_i`` and ``gone_j`` say what was gone before the block."""
    group, gone = None, set()
    for b in batches:
        out = []
        for project, beat, block, i, j, shot_a, shot_b, q_a, q_b, gone_i, gone_j in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (project, beat, block) != group:
                group, gone = (project, beat, block), set()
            if gone_i or gone_j or i in gone or j in gone:
                continue
            first_wins = q_a >= q_b
            gone.add(j if first_wins else i)
            out.append((project, beat, block, *((j, shot_b, shot_a) if first_wins else (i, shot_a, shot_b))))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _removed(rows: DataFrame) -> DataFrame:
    """(project_id, beat, block, idx, shot_id, kept_shot) that a walk over the pairs of each block removes."""
    names = ["project_id", "beat", "block", "idx", "shot_id", "kept_shot"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    sorted_ = rows.select("project_id", "beat", "block", "i", "j", "shot_a", "shot_b", "q_a", "q_b", "gone_i", "gone_j").repartition("project_id", "beat", "block")
    return sorted_.sortWithinPartitions("project_id", "beat", "block", "i", "j").mapInArrow(
        lambda it: _walk(it, names, kinds), "project_id string, beat string, block bigint, idx bigint, shot_id string, kept_shot string"
    )


def resolve_greedy(pairs: DataFrame, walk: int = WALK) -> DataFrame:
    """Losers of the greedy walk over close pairs, with the winner, per project and beat.

    Pairs are taken in order of i, then j; a pair with a removed side is skipped; the lower
    quality goes, on a tie the later; a losing i ends its row. Beats of up to ``walk`` pairs
    are walked in one run. Larger ones are cut into blocks of so many pairs, each walked
    by itself under a guess of what the blocks before it removed, which is nothing at first and
    then what they removed in the last round. A round that removes what the one before did
    has guessed right in every block, so its result is that of the one walk; rounds are
    at most one more than blocks, and few where blocks hardly touch each other.
    """
    rows = pairs.select("project_id", F.col("beat").cast("string").alias("beat"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("shot_a").cast("string").alias("shot_a"), F.col("shot_b").cast("string").alias("shot_b"), F.col("q_a").cast("double").alias("q_a"), F.col("q_b").cast("double").alias("q_b"))
    rows = staged(rows)
    result = ["project_id", "beat", "shot_id", "kept_shot"]
    no = {"gone_i": F.lit(False), "gone_j": F.lit(False)}
    large = rows.groupBy("project_id", "beat").agg(F.count("*").alias("n")).where(F.col("n") > walk)
    if large.isEmpty():
        return _removed(rows.withColumns({"block": F.lit(0).cast("bigint"), **no})).select(result)
    marked = rows.join(few(large), ["project_id", "beat"], "left")
    small = _removed(marked.where("n IS NULL").withColumns({"block": F.lit(0).cast("bigint"), **no})).select(result)
    placed = numbered(marked.where("n IS NOT NULL").drop("n"), "place", ["project_id", "beat"], {"_row": F.floor(F.col("i") / 256)}, ["i", "j"])
    blocks = staged(placed.withColumn("block", F.floor((F.col("place") - 1) / walk).cast("bigint")).drop("place"))
    most = blocks.agg(F.max("block")).first()[0] + 2
    told = staged(_removed(blocks.withColumns(no)))
    for _ in range(most):
        first = told.groupBy("project_id", "beat", "idx").agg(F.min("block").alias("since"))
        side = lambda n: first.select("project_id", "beat", F.col("idx").alias(n), F.col("since").alias(f"since_{n}"))
        known = blocks.join(side("i"), ["project_id", "beat", "i"], "left").join(side("j"), ["project_id", "beat", "j"], "left")
        before = lambda n: F.coalesce(F.col(f"since_{n}") < F.col("block"), F.lit(False))
        again = staged(_removed(known.withColumns({"gone_i": before("i"), "gone_j": before("j")})))
        if _same(told, again):
            return small.unionByName(again.select(result))
        told = again
    raise RuntimeError("the walk over close pairs did not settle")


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, none twice."""
    return a.count() == b.count() and a.join(b, a.columns, "left_anti").isEmpty()


def _takes(candidates: DataFrame, value: Column, dims: Column) -> DataFrame:
    """Candidates as ``takes_walk.losers`` reads them; only strong links are kept."""
    strong = lambda side: F.when((F.col(side)["coherence_score"] >= 0.6) | F.col(side)["relationship_type"].isin(STRONG), F.col(side)["shot_id"]).cast("string")
    text = lambda c: F.col(c).cast("string").alias(c)
    return candidates.select(
        text("project_id"), text("beat"), dims.cast("int").alias("dims"), F.col("idx").cast("bigint").alias("idx"), text("shot_id"), value.alias("value"), F.col("quality_score").cast("double").alias("quality_score"),
        text("source_file"), text("source_path"), F.col("characters").cast("array<string>").alias("characters"), direction_sign(F.col("direction")).alias("sign"), strong("prev").alias("prev_to"), strong("next").alias("next_to"),
    )


def hash_losers(candidates: DataFrame, most: int = 10, mode: str = "bits", block: int = takes_walk.BLOCK) -> DataFrame:
    """The losers of the greedy walk over the pairs of ``hash_pairs``, which are not formed."""
    rows = _takes(candidates.where(_HASHED), _number(), F.lit(1))
    return takes_walk.losers(rows, Measure("bits" if mode == "bits" else "digits", most), block=block)


def vector_losers(candidates: DataFrame, least: float = 0.92, block: int = takes_walk.BLOCK) -> DataFrame:
    """The losers of the greedy walk over the pairs of ``vector_pairs``, which are not formed."""
    rows = _takes(_whole(candidates), unit(F.col("vector")), F.size("vector")).where("dims > 0")
    return takes_walk.losers(rows, Measure("cosine", least), block=block)


def drop_losers(candidates: DataFrame, losers: DataFrame, level: str) -> DataFrame:
    """Candidates with the losers discarded and the reason noted."""
    l = losers.select("project_id", "shot_id", F.col("kept_shot"))
    rows = candidates.join(l, ["project_id", "shot_id"], "left")
    lost = F.col("kept_shot").isNotNull()
    return (
        rows.withColumn("status", F.when(lost, DISCARDED).otherwise(F.col("status")))
        .withColumn("dedup_reason", F.when(lost, F.concat(F.lit(level), F.lit(": 与 "), F.col("kept_shot"))).otherwise(F.col("dedup_reason")))
        .drop("kept_shot")
    )


def dedup_group(shots: DataFrame, hashes: bool = True, vectors: bool = False) -> DataFrame:
    """Candidates pass the hash and the vector step, everything else passes through. Close pairs are walked, not formed."""
    rest, candidates = shots.where(F.col("status") != CANDIDATE), shots.where(F.col("status") == CANDIDATE)
    steps = [(hashes, hash_losers, "L2视觉重复"), (vectors, vector_losers, "L3语义重复")]
    for wanted, losers, level in steps:
        if wanted:
            alive = candidates.where(F.col("status") == CANDIDATE)
            candidates = drop_losers(candidates, losers(alive), level)
    return rest.unionByName(candidates)
