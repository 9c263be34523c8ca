"""Meetings of points and intervals in time slots, so that no task or join holds all intervals of an asset.

A long interval is not dealt to all slots that it touches. Its first and last slot have a
row each; what lies between is covered by few nodes of a tree of slots (16 slots, 16 of
these, ...), the largest that fit. A point looks into its slot and into the nodes above it,
so a pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of a slot, in microseconds.
SLOT = 10_000_000
#: Levels of the tree above the slots, each of 16 nodes of the level below. The highest node is 7.6 days long.
LEVELS = 4
#: The level of the first and last slot of an interval.
EDGE = -1
_BITS = 4


def slot_of(t: Column, slot: float = SLOT) -> Column:
    return F.floor(t / slot).cast("bigint")


def _run(low: Column, high: Column, level: int) -> Column:
    """Nodes low to high - 1 of a level."""
    nodes = F.transform(F.sequence(low, high - 1), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))
    return F.when(low < high, nodes).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def homes_of(start: Column, end: Column, slot: float = SLOT) -> Column:
    """(level, node) of the places of start..end: its first and last slot as ``EDGE``, and the largest nodes that cover the slots between.

    At most 32 a level below the highest; none where it ends before it starts or a side is null.
    """
    first, last = slot_of(start, slot), slot_of(end, slot)
    low = [-F.shiftright(-(first + 1), _BITS * k) for k in range(LEVELS + 1)]
    high = [F.shiftright(last, _BITS * k) for k in range(LEVELS + 1)]
    runs = [_run(first, first + 1, EDGE), _run(F.greatest(first + 1, last), last + 1, EDGE)]
    for k in range(LEVELS):
        # what the next level covers is left to it
        inner = low[k + 1] < high[k + 1]
        left, right = F.shiftleft(low[k + 1], _BITS), F.shiftleft(high[k + 1], _BITS)
        runs += [_run(low[k], F.when(inner, left).otherwise(high[k]), k), _run(F.when(inner, right).otherwise(high[k]), high[k], k)]
    runs.append(_run(low[LEVELS], high[LEVELS], LEVELS))
    return F.when(start <= end, F.flatten(F.array(*runs))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def places_of(slot: Column) -> Column:
    """(level, node) of the places where a point in ``slot`` meets intervals."""
    level = lambda k: F.lit(k).alias("level")
    above = [F.struct(level(k), F.shiftright(slot, _BITS * k).alias("node")) for k in range(LEVELS + 1)]
    return F.array(F.struct(level(EDGE), slot.alias("node")), *above)


def at_slots(spans: DataFrame, keys: list[str], start: Column, end: Column, value: Column, slot: float = SLOT, *, points: DataFrame) -> DataFrame:
    """(keys, _slot, _value): for each slot the values of spans that begin or end there, and the least of those that cover it, by node.

    For tests that one covering span decides. Nodes are reduced to their least value before
    they meet the slots, so rows grow with the spans and the length of an asset, not with
    their product. Only slots of ``points`` (keys, _slot) are covered.
    """
    homes = spans.select(*keys, value.alias("_value"), F.inline(homes_of(start, end, slot)).alias("_level", "_node"))
    edges = homes.where(F.col("_level") == EDGE).select(*keys, F.col("_node").alias("_slot"), "_value")
    nodes = homes.where(F.col("_level") != EDGE).groupBy(*keys, "_level", "_node").agg(F.min("_value").alias("_value"))
    above = F.slice(places_of(F.col("_slot")), 2, LEVELS + 1)
    asked = points.select(*keys, "_slot").where("_slot IS NOT NULL").distinct().select("*", F.inline(above).alias("_level", "_node"))
    covers = asked.join(nodes, [*keys, "_level", "_node"]).groupBy(*keys, "_slot").agg(F.min("_value").alias("_value"))
    return edges.unionByName(covers)


def _renamed(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c.alias(n) for n, c in values.items()])


def _same(keys: list[str], test: Column) -> Column:
    for k in keys:
        test = test & (F.col(k) == F.col(f"_{k}"))
    return test


def outside(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: Column, end: Column, slot: float = SLOT) -> DataFrame:
    """The points whose ``t`` lies in no span start..end, ends included, of their keys; points without a time stay. A span has a row for each slot that it touches."""
    first, last = slot_of(F.col("_start"), slot), slot_of(F.col("_end"), slot)
    taken = _renamed(spans, keys, {"_start": start, "_end": end}).where("_start <= _end").withColumn("_at", F.explode(F.sequence(first, last)))
    inside = _same(keys, F.col("_slot") == F.col("_at")) & (F.col(t) >= F.col("_start")) & (F.col(t) <= F.col("_end"))
    return points.withColumn("_slot", slot_of(F.col(t), slot)).join(taken, inside, "left_anti").drop("_slot")


def _meet(spans: DataFrame, start: str, end: str, points: DataFrame, t: str, keys: list[str], test: Column, slot: float) -> DataFrame:
    """Each span with each of ``points`` whose ``t`` lies in start..end and of which ``test`` holds; one side has its keys with a leading _."""
    at = points.select("*", F.inline(places_of(slot_of(F.col(t), slot))).alias("_p_level", "_p_node"))
    dealt = spans.select("*", F.inline(homes_of(F.col(start), F.col(end), slot)).alias("_h_level", "_h_node"))
    place = (F.col("_h_level") == F.col("_p_level")) & (F.col("_h_node") == F.col("_p_node"))
    return dealt.join(at, _same(keys, place) & test)


def within(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, carried: list[str], slot: float = SLOT) -> DataFrame:
    """Each point with each of ``spans`` (its columns ``carried``) in whose start..end its ``t`` lies, ends included.

    Slots that hold points find their spans in the tree, then points look into their slot alone, so
    no point is copied for the levels of the tree.
    """
    held = _renamed(spans, keys, {"_start": F.col(start), "_end": F.col(end)} | {f"_c_{c}": F.col(c) for c in carried}).where("_start <= _end")
    placed = points.withColumn("_slot", slot_of(F.col(t), slot))
    asked = placed.select(*keys, "_slot").where("_slot IS NOT NULL").distinct().select("*", F.inline(places_of(F.col("_slot"))).alias("_p_level", "_p_node"))
    dealt = held.select("*", F.inline(homes_of(F.col("_start"), F.col("_end"), slot)).alias("_h_level", "_h_node"))
    place = (F.col("_h_level") == F.col("_p_level")) & (F.col("_h_node") == F.col("_p_node"))
    of_slot = asked.join(dealt, _same(keys, place)).select(*held.columns, F.col("_slot").alias("_at"))
    inside = _same(keys, F.col("_slot") == F.col("_at")) & (F.col(t) >= F.col("_start")) & (F.col(t) <= F.col("_end"))
    return placed.join(of_slot, inside).select(*points.columns, *[F.col(f"_c_{c}").alias(c) for c in carried])


def containing(spans: DataFrame, inner: DataFrame, keys: list[str], start: Column, end: Column, inner_start: str, inner_end: str, slot: float = SLOT) -> DataFrame:
    """Each span with each of ``inner`` (columns _start, _end) that lies in start..end: they meet where the inner one starts. One that ends before it starts lies nowhere."""
    held = _renamed(inner, keys, {"_start": F.col(inner_start), "_end": F.col(inner_end)}).where("_start <= _end")
    outer = spans.withColumns({"_low": start, "_high": end})
    test = (F.col("_start") >= F.col("_low")) & (F.col("_end") <= F.col("_high"))
    return _meet(outer, "_low", "_high", held, "_start", keys, test, slot).select(*spans.columns, "_start", "_end")


def overlapping(spans: DataFrame, others: DataFrame, keys: list[str], start: str, end: str, other_start: str, other_end: str, carried: list[str], slot: float = SLOT) -> DataFrame:
    """Each span with each of ``others`` (its columns ``carried``) that it overlaps, ends included: they meet where the later one starts."""
    held = _renamed(others, keys, {"_start": F.col(other_start), "_end": F.col(other_end)} | {f"_c_{c}": F.col(c) for c in carried}).where("_start <= _end")
    whole = spans.where(F.col(start) <= F.col(end))
    out = [*spans.columns, *[F.col(f"_c_{c}").alias(c) for c in carried]]
    later = (F.col("_start") >= F.col(start)) & (F.col("_start") <= F.col(end))
    # equal starts meet in the first of the two
    earlier = (F.col(start) > F.col("_start")) & (F.col(start) <= F.col("_end"))
    other_later = _meet(whole, start, end, held, "_start", keys, later, slot).select(*out)
    return other_later.unionByName(_meet(held, "_start", "_end", whole, start, keys, earlier, slot).select(*out))
