"""Time codes, durations, playing speeds and names as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def sec_to_tc(seconds: Column, fps: Column | float = 24.0) -> Column:
    """``HH:MM:SS:FF``; the frame part is cut, not rounded, and negative times count as 0."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("bigint")
    frame = F.floor((s - whole) * rate).cast("bigint")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(whole / 3600).cast("bigint"), F.floor(whole % 3600 / 60).cast("bigint"), whole % 60, frame)


def tc_to_sec(tc: Column, fps: Column | float = 24.0) -> Column:
    """Seconds of ``H:M:S:F``, ``H:M:S`` or ``H:M:S.mmm``; anything else is null."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    p = F.split(F.trim(tc), ":")
    part = lambda k: F.get(p, F.lit(k)).try_cast("double")
    whole = part(0) * 3600 + part(1) * 60 + part(2)
    return F.when(F.size(p) == 4, whole + F.try_divide(part(3), rate)).when(F.size(p) == 3, whole)


def tc_span(tc_in: Column, tc_out: Column, fps: float = 24.0) -> Column:
    """Length between two time codes, 0 where one is malformed or they are reversed."""
    return F.coalesce(F.greatest(tc_to_sec(tc_out, fps) - tc_to_sec(tc_in, fps), F.lit(0.0)), F.lit(0.0))


def parse_duration(text: Column) -> Column:
    """Seconds of digits, ``5s``, ``5 min``, ``1小时`` or a time code; what cannot be read is 0."""
    s = F.lower(F.trim(text))
    number = lambda units: F.regexp_extract(s, rf"^(\d+(?:\.\d+)?)\s*(?:{units})$", 1).try_cast("double")
    read = F.coalesce(
        F.when(s.rlike(r"^\d+$"), s.try_cast("double")),
        number("s|sec|秒"),
        number("m|min|分钟") * 60,
        number("h|hr|小时") * 3600,
        F.when(s.contains(":"), tc_to_sec(s)),
        s.try_cast("double"),
    )
    return F.coalesce(read, F.lit(0.0))


def parse_speed(text: Column, delete: bool = True) -> Column:
    """Multiplier of ``50%``, ``2x`` or a number; null for 删除 where ``delete``; null, empty and bad texts are 1."""
    s = F.lower(F.trim(text))
    bare = F.regexp_replace(s, "[%x]$", "").try_cast("double")
    value = F.coalesce(F.when(s.endswith("%"), bare / 100).otherwise(bare), F.lit(1.0))
    return F.when(F.coalesce(s, F.lit("")) == "删除", F.lit(None).cast("double")).otherwise(value) if delete else value


def export_speed(text: Column) -> Column:
    """Multiplier for the timeline: whatever is no speed, 删除 too, plays at 1."""
    return parse_speed(text, delete=False)


def format_speed(speed: Column) -> Column:
    """``1x`` near one, whole percent below, ``2x`` or ``2.5x`` above; null is ``1x``."""
    near = F.abs(speed - F.round(speed)) < 0.01
    above = F.when(near, F.format_string("%dx", F.rint(speed).cast("int"))).otherwise(F.format_string("%.1fx", speed))
    below = F.format_string("%d%%", F.rint(speed * 100).cast("int"))
    return F.when(speed.isNull() | (F.abs(speed - 1.0) < 0.01), F.lit("1x")).when(speed < 1, below).otherwise(above)


def direction_sign(text: Column) -> Column:
    """+1 for left to right, -1 for right to left, 0 otherwise."""
    d, low = F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda c, words: F.greatest(*[c.contains(w) for w in words])
    # fixed phrases, Chinese before English
    return (
        F.when(any_of(d, ["从左向右", "左到右", "向左到右"]), F.lit(1))
        .when(any_of(d, ["从右向左", "右到左", "向右到左"]), F.lit(-1))
        .when(any_of(low, ["left to right", "left-to-right"]), F.lit(1))
        .when(any_of(low, ["right to left", "right-to-left"]), F.lit(-1))
        .otherwise(F.lit(0))
    )


def reel_name(file: Column) -> Column:
    """Letters and digits of the name without its extension, upper case, eight at most."""
    stem = F.regexp_replace(file, r"(?<=[^.])\.[^./]*$", "")
    return F.substring(F.upper(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "")), 1, 8)


def hex_hamming(a: Column, b: Column) -> Column:
    """Characters in which two hashes differ; 999 where their lengths do."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) != F.length(b), F.lit(999)).otherwise(differ)


def bit_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits, in halves of 32 bits each."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


_DIGITS = "一二三四五六七八九"


def chinese_number(text: Column) -> Column:
    """Value of digits or of a Chinese numeral up to 99; null for anything else."""
    pos = lambda c: F.instr(F.lit(_DIGITS), c)
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    with_ten = F.when(F.length(tens) == 0, F.lit(1)).otherwise(pos(tens)) * 10 + F.when(F.length(ones) == 0, F.lit(0)).otherwise(pos(ones))
    return F.coalesce(
        text.try_cast("int"),
        F.when(text.rlike(f"^[{_DIGITS}]?十[{_DIGITS}]?$"), with_ten).when(text.rlike(f"^[{_DIGITS}]$"), pos(text)),
    )


def act_number(act: Column, chinese: bool = True) -> Column:
    """Number in ``第N幕``; 99 without one. Chinese numerals count unless switched off."""
    digits = F.regexp_extract(act, r"第(\d+)幕", 1).try_cast("int")
    words = chinese_number(F.regexp_extract(act, f"第([{_DIGITS}十]+)幕", 1)) if chinese else F.lit(None).cast("int")
    return F.coalesce(digits, words, F.lit(99))


def scene_number(scene: Column) -> Column:
    """Number in ``场N``; 99 without one."""
    return F.coalesce(F.regexp_extract(scene, r"场(\d+)", 1).try_cast("int"), F.lit(99))


def shot_id(number: Column) -> Column:
    return F.format_string("S%03d", number)


def frame_rate(text: Column) -> Column:
    """Frames a second of ``n/d``; 24 where the divisor is 0 or the text is no rate."""
    p = F.split(text, "/")
    n, d = F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.coalesce(F.when(d != 0, F.try_divide(n, d)), F.lit(24.0))


def strip_fence(text: Column) -> Column:
    """Body of a fenced block (with or without the word json), else the text itself, trimmed."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(F.length(fenced) > 0, fenced).otherwise(text))
