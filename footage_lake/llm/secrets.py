"""Secret scans: pattern matches and high-entropy strings, as spans of code points.

Only DataFrame functions. Base kinds are plain patterns. The method then looks at
candidate strings of each character class: a window slides over the candidate,
its sum of c log2 c changes only by the counts of the character that enters and
of the one that leaves, and a candidate is a secret if the entropy of some window
reaches the bound of its class, unless the allow-list knows it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footage_lake.llm.common import found_before, let, running

ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Order of kinds at one start.
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates that are no secrets whatever their entropy: identifiers in the
#: 8-4-4-4-12 form, digits alone, letters of one case, names and paths made of words
#: with one digit at most, placeholder texts, alphabets.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_+/=-]+$",
    r"^[a-z_+/=-]+$",
    r"^[A-Z_+/=-]+$",
    r"^[A-Z]?[a-z_+/=-]+$",
    r"^(?=[^0-9]*+[0-9]?[^0-9]*+$)[a-z]?(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|(?<![A-Z])[A-Z]+(?=[A-Z][a-z])|(?<![A-Za-z])[A-Za-z]{1,2}(?![A-Za-z])|[0-9_+/=-])++$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
]


@dataclass(frozen=True)
class EntropyClass:
    """A character class: what a candidate is, its window, and the bits a window must reach."""

    name: str
    candidate: str
    needs: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("hex", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{16,}+(?![A-Za-z0-9+/_=-])", r"^(?=[^0-9]*+[0-9])(?=[^A-Fa-f]*+[A-Fa-f])", 16, 2.8),
    EntropyClass("base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", r"^(?:(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])|(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z]))", 20, 3.6),
)
#: A long candidate is looked at in pieces of this many characters, each with the window's rest after it.
PIECE = 256
MARK = "[SECRET]"
#: Characters of a block that is masked by itself.
BLOCK = 512
#: Code of the character that stands for a count of none.
_ZERO = 48


def _placed(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, kind number, end, string) of the matches, left to right."""

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("size"), x.alias("found")))

        def of_pairs(p: Column) -> Column:
            before = running(F.transform(p, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)

            def row(x: Column, at: Column) -> Column:
                start = at + x["gap"]
                return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["size"]).alias("end"), x["found"])

            return F.zip_with(p, before, row)

        return let(pairs, of_pairs)

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = let(found, lambda x: F.when(F.size(x) == 0, empty).otherwise(walk(x)))
    return rows if keep is None else F.filter(rows, keep)


def window_entropy(text: Column, window: int) -> Column:
    """Highest Shannon entropy (bits) of any ``window`` consecutive characters; shorter texts: of the whole.

    The counts of the window are a string with a place for each ASCII character
    (others share one), in which two places change at each step.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    total = lambda s, size: F.log2(size) - s / size

    def changed(state: Column, ch: Column, by: int) -> Column:
        """One more (or less) of a character, in the counts and in the sum."""

        def at_place(place: Column) -> Column:
            def of_count(c: Column) -> Column:
                return F.struct(
                    F.overlay(state["counts"], F.char(c + (_ZERO + by)), place, F.lit(1)).alias("counts"),
                    (state["sum"] + F.get(weight, c + by) - F.get(weight, c)).alias("sum"),
                    state["best"].alias("best"),
                )

            return let(F.ascii(F.substr(state["counts"], place, F.lit(1))) - _ZERO, of_count)

        return let(F.least(F.ascii(ch), F.lit(127)) + 1, at_place)

    def over(piece: Column) -> Column:
        def of_chars(chars: Column) -> Column:
            size = F.least(F.size(chars), F.lit(window)).cast("double")

            def step(acc: Column, k: Column) -> Column:
                left = F.when(k >= window, changed(acc, F.get(chars, k - window), -1)).otherwise(acc)

                def scored(state: Column) -> Column:
                    full = k + 1 >= size
                    return F.struct(state["counts"], state["sum"], F.when(full, F.greatest(state["best"], total(state["sum"], size))).otherwise(state["best"]).alias("best"))

                return let(let(left, lambda s: changed(s, F.get(chars, k), 1)), scored)

            start = F.struct(F.lit(chr(_ZERO) * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
            return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: acc["best"])

        return let(F.array_remove(F.split(piece, "", -1), ""), of_chars)

    pattern = F.lit(f"(?s)(.{{1,{PIECE}}})(?=(.{{0,{window - 1}}}))")
    pieces = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.concat(a, b)
    )
    # a last piece shorter than the window lies within the one before
    whole = F.filter(pieces, lambda p, i: (F.length(p) >= window) | (i == 0))
    return F.coalesce(F.array_max(F.transform(whole, over)), F.lit(0.0))


def _entropy(text: Column, base: dict[str, Column]) -> Column:
    """Spans of kind entropy that lie in no base span and are not the name that one assigns to; sorted, each once.

    Spans of one base kind do not overlap, so only the last that starts before a
    place can reach over it.
    """
    allowed = "|".join(f"(?:{x})" for x in ALLOWED)

    def last(rows: Column, starts_before, test) -> Column:
        of_index = lambda k: F.when(k > 0, let(F.get(rows, k - 1), test)).otherwise(False)
        return let(found_before(F.size(rows), lambda k: starts_before(F.get(rows, k)["start"])), of_index)

    def of_class(k: EntropyClass) -> Column:
        def keep(row: Column) -> Column:
            s = row["found"]
            inside = [last(rows, lambda at: at <= row["start"], lambda b: row["end"] <= b["end"]) for rows in base.values()]
            names = last(base["assign"], lambda at: at < row["end"], lambda b: (row["start"] < b["start"]) & (row["end"] < b["end"]))
            likely = F.rlike(s, F.lit(k.needs)) & ~F.rlike(s, F.lit(allowed))
            apart = F.when(likely, ~reduce(or_, inside) & ~names).otherwise(False)
            return F.when(apart, window_entropy(s, k.window) >= k.bits).otherwise(False)

        return _placed(text, k.candidate, "entropy", keep)

    spans = F.sort_array(F.concat(*[of_class(k) for k in CLASSES]))
    return let(spans, lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["start"] != x["start"]) | (F.get(a, k - 1)["end"] != x["end"])))


def scan(text: Column) -> Column:
    """Struct of ``base`` and ``spans``: arrays of (start, kind, end, found) sorted by start, then kind.

    A null text counts as empty. Starts and ends are code points, ends exclusive.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_text(t: Column) -> Column:
        assign = _placed(t, ASSIGN, "assign", lambda r: F.length(F.regexp_extract(r["found"], ASSIGN, 2)) >= 6)
        kinds = F.struct(assign.alias("assign"), _placed(t, ACCESS, "access").alias("access"), _placed(t, HEX, "hex").alias("hex"))

        def of_kinds(k: Column) -> Column:
            base = {name: k[name] for name in ("assign", "access", "hex")}
            both = F.struct(F.sort_array(F.concat(*base.values())).alias("base"), _entropy(t, base).alias("more"))
            return let(both, lambda b: F.struct(b["base"], F.sort_array(F.concat(b["base"], b["more"])).alias("spans")))

        return let(kinds, of_kinds)

    return let(text, of_text)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans and all spans, a row per document.

    Documents without a secret have zero counts and the digest of the empty
    string. Repeated rows are reported as often as they come; an empty table
    gives no rows; other columns are ignored, whatever their names. The work grows with a text's length.
    """
    count = lambda k: F.size(F.filter(F.col("s.base"), lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return documents.select("doc_id", scan(F.col("text")).alias("s")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("s.base")), 256).alias("base_sha256"),
        _joined(F.col("s.spans")).alias("spans"),
    )


def redacted(text: Column, mark: str = MARK) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``; null stays null.

    The text is cut into blocks, and each block is masked by the spans that touch it,
    so that no span needs a look at the whole text.
    """

    def cuts(spans: Column) -> Column:
        """Disjoint (start, end, mark): a span that begins in an earlier one only prolongs it."""
        reach = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
        row = lambda s, at: F.struct(
            F.greatest(s["start"], at).alias("start"), F.greatest(s["end"], at).alias("end"), F.when(s["start"] >= at, F.lit(mark)).otherwise("").alias("mark")
        )
        return F.zip_with(spans, reach, row)

    def masked(block: Column, base: Column, rows: Column) -> Column:
        n, end = F.size(rows), base + F.length(block)
        part = lambda at, length: F.substr(block, at - base + 1, length)

        def step(acc: Column, k: Column) -> Column:
            def of_row(s: Column) -> Column:
                gap = part(acc["at"], F.greatest(s["start"] - acc["at"], F.lit(0)))
                said = F.when(s["start"] >= base, s["mark"]).otherwise("")
                return F.struct(F.concat(acc["out"], gap, said).alias("out"), F.greatest(acc["at"], F.least(s["end"], end)).alias("at"))

            return let(F.get(rows, k), of_row)

        def of_range(r: Column) -> Column:
            start = F.struct(F.lit("").alias("out"), base.alias("at"))
            fold = F.aggregate(F.sequence(r["low"], r["high"] - 1), start, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.lit(BLOCK))))
            return F.when(r["low"] < r["high"], fold).otherwise(block)

        low = found_before(n, lambda k: F.get(rows, k)["end"] <= base)
        high = found_before(n, lambda k: F.get(rows, k)["start"] < end)
        return let(F.struct(low.alias("low"), high.alias("high")), of_range)

    def of_text(t: Column) -> Column:
        def cut(spans: Column) -> Column:
            blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
            whole = lambda rows: F.array_join(F.transform(blocks, lambda x, k: masked(x, k * BLOCK, rows)), "")
            return F.when(F.size(spans) == 0, t).otherwise(let(cuts(spans), whole))

        return F.when(t.isNotNull(), let(scan(t)["spans"], cut))

    return let(text.cast("string"), of_text)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with secrets in ``text`` masked; ``n_chars``, where present, follows the new text.

    Null texts stay null, and their ``n_chars`` becomes null. Texts without a secret,
    empty ones too, stay as they are. Rows come back as often as they came, with all
    their columns; an empty table gives no rows. The work grows with a text's length.
    """
    out = documents.withColumn("text", redacted(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
