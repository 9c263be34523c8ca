"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance.

Candidates come from pigeonring filtering. A fingerprint has four segments of 16
bits in a ring. If two fingerprints differ in at most three bits, some segment
starts a chain in which l consecutive segments differ in at most 3 l / 4 bits for
every l: none in the first, one in two, two in three, three in all. The first two
steps are the join key (a segment, and the next with one bit flipped or none),
the third and fourth are tested on the candidates.

Keys of dense groups hold many fingerprints, so a key's rows are not paired: each
task keeps a forest over what it links and emits only links that join two trees.
Where a key would meet more than ``HOT`` rows, the chain's third step joins the key.
Connected components then come from large-star / small-star rounds on the distinct
fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footage_lake.llm.common import discard, fresh_name, shared_folder, small, stored

SEED = 42
DISTANCE = 3
SHINGLE = 3
#: Rows that one key may meet before the third step of the chain joins the key.
HOT = 65_536
_BLOCK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, ASCII letters in lower case, repeats counted.

    Fewer words than a shingle: their sequence is the one shingle. No word: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) per document."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.array([fingerprint(t, shingle) for t in rows.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of_batch, f"doc_id {kind}, fp bigint")


class _Forest:
    """Union-find over fingerprints seen in one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top and x != top:
            up[x] = top
            x = above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        return True


def _chain(counts: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Pairs whose chain from ``start`` stays within its budgets; ``counts`` has a row per pair, a column per segment.

    A chain of l of n segments may differ in l * distance / n bits. Only pairs that
    pass all steps reach the full count, which is the last one.
    """
    n = counts.shape[1]
    left, sums = np.arange(len(counts)), np.zeros(len(counts), np.int64)
    for step in range(1, n + 1):
        sums = sums + counts[left, (start[left] + step - 1) % n]
        near = n * sums <= step * distance
        left, sums = left[near], sums[near]
    ok = np.zeros(len(counts), bool)
    ok[left] = True
    return ok


def _segment_counts(x: np.ndarray) -> np.ndarray:
    """Bits set in each of the four segments of 64-bit differences."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (place, fp, own) sorted by place in; links that join two trees out. A place's last two bits are the chain's start."""
    forest, held = _Forest(), None

    def of_pairs(group, fp, own):
        """Pairs within groups of up to 16 rows, one offset at a time."""
        start = group & 3
        for step in range(1, 16):
            a = np.flatnonzero(group[:-step] == group[step:]) if step < len(group) else np.array([], int)
            a = a[(own[a] | own[a + step]) & (fp[a] != fp[a + step])]
            if len(a):
                ok = _chain(_segment_counts(fp[a] ^ fp[a + step]), start[a], distance)
                yield from zip(fp[a][ok].tolist(), fp[a + step][ok].tolist(), strict=True)

    def of_group(fp, own, start):
        """Own rows against the rows of the group that are not in their tree yet."""
        base = np.unique(fp[own])
        fp = np.unique(fp)
        tree = np.array([forest.root(x) for x in fp.tolist()])
        for x in base.tolist():
            mine = tree[np.searchsorted(fp, x)]
            others = np.flatnonzero(tree != mine)
            if not len(others):
                break
            counts = _segment_counts(fp[others] ^ x)
            near = others[_chain(counts, np.full(len(others), start), distance)]
            for y in fp[near].tolist():
                yield x, y
            if len(near):
                tree[np.isin(tree, [mine, *tree[near]])] = min(int(mine), int(tree[near].min()))

    def of_rows(place, fp, own):
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        sizes = np.diff(np.concatenate([firsts, [len(place)]]))
        any_own = np.add.reduceat(own.astype(np.int64), firsts) > 0
        wanted = (sizes > 1) & any_own
        little = wanted & (sizes <= 16)
        rows = np.repeat(little, sizes)
        found = [x for x in of_pairs(place[rows], fp[rows], own[rows]) if forest.join(*x)]
        for g in np.flatnonzero(wanted & ~little):
            s = slice(firsts[g], firsts[g] + sizes[g])
            found += [x for x in of_group(fp[s], own[s], int(place[firsts[g]] & 3)) if forest.join(*x)]
        return _pairs_out(found)

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[last:] for x in rows]
        if last:
            yield of_rows(*(x[:last] for x in rows))
    if held is not None:
        yield of_rows(*held)


def _pairs_out(found: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rows.min(axis=1, initial=2**63 - 1)), pa.array(rows.max(axis=1, initial=-(2**63)))], ["a", "b"])


_LINK = "a bigint, b bigint"


def _segment(k: str) -> str:
    return f"(shiftrightunsigned(fp, 16 * ({k})) & 65535)"


def _flips(most: int) -> list[int]:
    """Masks of a segment with up to ``most`` bits set, by their number."""
    return [m for n in range(most + 1) for m in range(1 << 16) if m.bit_count() == n] if most < 3 else []


def linked(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) with the same components as all pairs of distinct ``fp`` within ``distance``.

    ``distance`` is 0 to 3: two segments of the chain may then differ in one bit at
    most, three in two. A fingerprint looks itself up under its own key in each
    segment; under the keys one flip away it is only met.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    rows = (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(67))).alias("v"))
        .select("fp", F.expr("v div 17").cast("int").alias("i"), F.expr("v % 17").alias("f"))
        .select(
            F.expr(
                f"shiftleft((shiftleft({_segment('i')}, 16) | {_segment('(i + 1) % 4')})"
                " ^ (case when f = 0 then 0L else shiftleft(1L, cast(f - 1 as int)) end), 2) | i"
            ).alias("place"),
            "fp",
            (F.col("f") == 0).alias("own"),
        )
    )
    dealt = _longer_keys(rows).repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(lambda it: _links(it, distance), _LINK).distinct()


def _longer_keys(rows: DataFrame) -> DataFrame:
    """Rows (place, fp, own) in which the places that over ``HOT`` rows meet get the third segment.

    A row under its own key may differ there in two bits, one under a flipped key in
    one more, so a row of such a place becomes 137 or 17. Own fingerprints of a
    longer key differ in one segment only, so they are 65,536 at most.
    """
    spread = HOT // 17  # a place meets its own rows and those of the 16 places around
    heavy = rows.where("own").groupBy("place").count().where(F.col("count") > spread)
    around = heavy.select(F.explode(F.expr("transform(sequence(0, 16), f -> if(f = 0, place, place ^ shiftleft(4L, f - 1)))")).alias("place"), "count")
    hot = stored(around.groupBy("place").agg(F.sum("count").alias("n")).where(F.col("n") > HOT).select(F.col("place").alias("hot")))
    n_hot = hot.count()
    if not n_hot:
        return rows
    marked = rows.join(small(hot, n_hot), F.col("place") == F.col("hot"), "left")
    flips = F.array(*[F.lit(m) for m in _flips(2)])
    flipped = F.slice(flips, 1, F.when(F.col("own"), F.lit(len(_flips(2)))).otherwise(F.lit(len(_flips(1)))))
    third = F.expr(_segment("((place & 3) + 2) % 4")).bitwiseXOR(F.col("flip"))
    longer = marked.where("hot IS NOT NULL").withColumn("flip", F.explode(flipped)).select(
        F.expr("-4L").bitwiseAND(F.xxhash64("place", third)).bitwiseOR(F.col("place").bitwiseAND(F.lit(3))).alias("place"), "fp", (F.col("own") & (F.col("flip") == 0)).alias("own")
    )
    return marked.where("hot IS NULL").drop("hot").unionByName(longer)


#: Keys of very many rows, at most, whose least value is broadcast.
CENTRES = 10_000


def with_least(rows: DataFrame, n: int, key: str, value: Column, name: str) -> DataFrame:
    """``rows`` (``n`` of them) with the smallest ``value`` among those of their key.

    Keys of very many rows are few, so their value is sent to the rows instead of all
    their rows to one task.
    """
    least = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("of_key"))
    much = max(100, 2 * n // CENTRES)
    large, few = (least.where(test).drop("of_key") for test in (F.col("of_key") > much, F.col("of_key") <= much))
    marked = rows.join(F.broadcast(large), key, "left")
    return marked.where(F.col(name).isNotNull()).unionByName(marked.where(F.col(name).isNull()).drop(name).join(few, key))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each linked node and the smallest node that it reaches.

    Alternates large stars (each node's larger neighbours go to its smallest) and
    small stars (smaller ones too) until a round changes nothing, which takes a
    number of rounds that grows with the logarithm of the links; an error after
    ``most_rounds``. Nodes of very many links (a star's centre) are few, so their
    smallest neighbour is sent to the links instead of all their links to one task.
    """
    spark = links.sparkSession

    def large_star(e: DataFrame, n: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        return with_least(both, 2 * n, "u", F.col("v"), "m").where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))

    def small_star(e: DataFrame, n: int) -> DataFrame:
        down = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        rows = with_least(down, n, "u", F.col("v"), "m")
        # the smallest neighbour itself keeps its link to the node, the others go to it
        return rows.select(F.col("m").alias("a"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b")).distinct()

    def state_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    path = shared_folder(spark)
    edges = stored(links, path)
    state = state_of(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        old = path
        middle, path = shared_folder(spark), shared_folder(spark)
        edges = stored(small_star(stored(large_star(edges, state[0]), middle), state[0]), path)
        discard(spark, old)
        discard(spark, middle)
        before, state = state, state_of(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select("a", F.col("a").alias("a2")).distinct()
    )


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) per row.

    Null and empty texts have fingerprint zero and are linked like any other. Texts of
    any length are read whole. A null doc_id is never the smallest; a component of null
    ids has a null id. Repeated rows come back as often as they came. An empty table gives
    no rows; other columns are ignored, whatever their names. Fingerprints of very many
    rows are few, so their component is sent to the rows instead of these to one task. See
    ``components`` for the error of too many rounds.
    """
    prints = stored(fingerprints(documents, shingle))
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("of_fp_rows")))
    nodes = stored(components(linked(first.select("fp"), distance)))
    member = stored(first.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "of_fp_rows"))
    lowest = F.struct(F.col("first_id").isNull().alias("unnamed"), F.col("first_id").alias("id"))
    sizes = member.agg(F.count("*"), F.sum("of_fp_rows")).first()
    told = with_least(member, sizes[0], "root", lowest, "lowest").select(F.col("fp").alias("of_fp"), "of_fp_rows", F.col("lowest.id").alias("component_id"))
    much = max(100, 2 * (sizes[1] or 0) // CENTRES)
    hot = told.where(F.col("of_fp_rows") > much).select("of_fp", F.lit(True).alias("sent"), "component_id")
    marked = prints.join(F.broadcast(hot), F.col("fp") == F.col("of_fp"), "left")
    rest = told.where(F.col("of_fp_rows") <= much).select("of_fp", "component_id")
    both = marked.where("sent").select("doc_id", "fp", "component_id").unionByName(
        marked.where("sent IS NULL").select("doc_id", "fp").join(rest, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")
    )
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by similarity

#: Five words a shingle, similarity 0.8 of the shingle sets.
COPY_SHINGLE = 5
#: Least-hash bands: a pair of similarity 0.8 shares one of 16 bands of 4 with probability 0.9998.
BANDS, ROWS = 16, 4
#: Bits of the wide fingerprint, and the distance up to which a pair is tested: at similarity
#: 0.8 it is 77 with deviation 8 (sets of five shingles: 96, 9), at 0.5 it is 137, between unrelated texts 256.
WIDE, WIDE_DISTANCE = 512, 128
#: Texts of a candidate group that are tested together; of larger groups some are pivots.
BLOCK, PIVOTS = 256, 8
#: Texts under one band that are tested; in larger ones all are candidates of each other.
BAND = 4096
_ODD = np.random.default_rng(20).integers(0, 2**63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """An independent 64-bit hash of hashes for each lane."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (lane + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def copy_shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's set of five-word shingles, sorted. Fewer words: their sequence is the one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < COPY_SHINGLE:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(COPY_SHINGLE)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 9 * shared >= 4 * (len(a) + len(b))


def copy_print(text: str | None) -> tuple[int, list[int], bytes]:
    """(signature, band keys, wide SimHash) of a text's set of five-word shingles.

    Texts of one set have one signature. Texts without a word share theirs.
    """
    hashes = copy_shingles(text)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _ODD[:, None]).min(axis=1))
        lanes = np.stack([_mixed(part, k) for k in range(WIDE // 64)], axis=1)
        ones += np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    wide = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes()
    bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED), bands, wide


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and ``place``, a hash of the text: rows equal in doc_id and place are repeated rows."""
    text = F.col("text").cast("string")
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("place"))


def _copy_prints(documents: DataFrame) -> DataFrame:
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [copy_print(t) for t in rows.column(1).to_pylist()]
            arrays = [
                rows.column(0),
                rows.column(2),
                pa.array(signed([f[0] for f in found])),
                pa.array([signed(f[1]) for f in found], pa.list_(pa.int64())),
                pa.array([f[2] for f in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "place", "sig", "bands", "wide"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _keyed(documents).mapInArrow(of_batch, f"doc_id {kind}, place bigint, sig bigint, bands array<bigint>, wide binary")


def _near(wide: np.ndarray, of: np.ndarray, distance: int) -> np.ndarray:
    """Rows of ``wide`` within ``distance`` of ``of``: those in which some chain of segments keeps all its budgets."""
    counts = np.bitwise_count(wide ^ of).astype(np.int64)
    ok = np.zeros(len(counts), bool)
    for start in range(counts.shape[1]):
        rows = np.flatnonzero(~ok & (counts.shape[1] * counts[:, start] <= distance))
        if len(rows):
            ok[rows] = _chain(counts[rows], np.full(len(rows), start), distance)
    return np.flatnonzero(ok)


def _wide(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint64).reshape(-1, WIDE // 64)


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one place after the other, without the place, their first column; they come sorted by it."""
    rows, at = [], None
    for batch in batches:
        for place, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place != at:
                if rows:
                    yield rows
                rows, at = [], place
            rows.append(tuple(row))
    if rows:
        yield rows


def _close(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (place, sig, wide) sorted by place in; links that join two trees out.

    A row is compared only with rows of its group that are not in its tree yet.
    """
    forest = _Forest()
    for rows in _by_place(batches):
        if len(rows) < 2:
            continue
        ids, raw = zip(*rows, strict=True)
        wide, found = _wide(raw), []
        tree = np.array([forest.root(x) for x in ids])
        for i in range(len(ids)):
            others = np.flatnonzero(tree != tree[i])
            if not len(others):
                break
            near = others[_near(wide[others], wide[i], distance)]
            found += [(ids[i], ids[j]) for j in near.tolist() if forest.join(ids[i], ids[j])]
            if len(near):
                tree[np.isin(tree, [tree[i], *tree[near]])] = forest.root(ids[i])
        if found:
            yield _pairs_out(found)


def _candidates(nodes: DataFrame, distance: int) -> DataFrame:
    """Links of texts that share a band and are close by their wide fingerprints.

    In a place of over ``BAND`` texts all are linked to the first of them: more
    candidates than needed, but each text once.
    """
    rows = nodes.select(F.explode("bands").alias("place"), "sig", "wide")
    large = stored(rows.groupBy("place").agg(F.count("*").alias("n"), F.min("sig").alias("first")).where(F.col("n") > BAND).select(F.col("place").alias("large"), "first"))
    n = large.count()
    if n:
        rows = rows.join(small(large, n), F.col("place") == F.col("large"), "left")
    dealt = (rows.where("large IS NULL") if n else rows).select("place", "sig", "wide").repartition("place").sortWithinPartitions("place")
    links = dealt.mapInArrow(lambda it: _close(it, distance), _LINK)
    if n:
        links = links.unionByName(rows.where("large IS NOT NULL AND sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b")))
    return links.distinct()


def _verified(batches: Iterator[pa.RecordBatch], distance: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows (place, sig, wide, shingles, own) sorted by place in; links (a, b) of similar shingle sets out.

    Where all rows of a place are its own, each meets each, else its own rows meet
    the others. The wide fingerprint and the sizes rule pairs out, the sets decide.
    Links come as (own row, other row) for all pairs if ``every``, else only those that join two trees.
    """
    forest = _Forest()
    for rows in _by_place(batches):
        if len(rows) < 2:
            continue
        sig, raw, sets, owned = zip(*rows, strict=True)
        wide, sets, own = _wide(raw), [np.frombuffer(s, np.uint64) for s in sets], np.array(owned)
        size = np.array([len(s) for s in sets])
        tree = np.array([forest.root(x) for x in sig])
        met = np.ones(len(sig), bool) if own.all() else ~own
        found = []
        for i in np.flatnonzero(own).tolist():
            apart = np.array([x != sig[i] for x in sig]) if every else tree != tree[i]
            others = np.flatnonzero(met & apart & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])))
            close = others[_near(wide[others], wide[i], distance)]
            far = np.bitwise_count(wide[close] ^ wide[i]).sum(axis=1)
            taken = []
            for j in close[np.argsort(far, kind="stable")].tolist():
                if (every or forest.root(sig[i]) != forest.root(sig[j])) and similar(sets[i], sets[j]):
                    forest.join(sig[i], sig[j])
                    found.append((sig[i], sig[j]))
                    taken.append(j)
            if taken:
                tree[np.isin(tree, [tree[i], *tree[taken]])] = forest.root(sig[i])
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the last column, as the bytes of its shingle set."""
    for rows in batches:
        sets = pa.array([copy_shingles(t).tobytes() for t in rows.columns[-1].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], sets], [*rows.schema.names[:-1], "shingles"])


def _similar_links(documents: DataFrame, nodes: DataFrame, candidates: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of similar shingle sets within the groups (node, root) of ``candidates``.

    Only texts in such groups are read again, one for each set. In groups of up to
    ``BLOCK`` texts each meets each. Of larger groups ``PIVOTS`` texts meet all; the
    texts that are similar to the best of these hang together, so only the others
    have to meet all.
    """
    grouped = stored(candidates.groupBy("root").agg(F.count("*").alias("n")))
    wanted = stored(
        nodes.join(candidates.join(small(grouped, grouped.count()), "root"), F.col("sig") == F.col("node"))
        .select(F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"), "sig", "wide", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    of_text = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place"))
    texts = _keyed(documents).join(small(wanted, wanted.count()), of_text).select("sig", "wide", "root", "blocks", "text")
    sets = texts.mapInArrow(_shingle_sets, "sig bigint, wide binary, root bigint, blocks int, shingles binary")
    once = sets.groupBy("sig").agg(*(F.any_value(c).alias(c) for c in ("wide", "root", "blocks", "shingles")))
    once = stored(once.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "sig"), F.col("blocks"))))

    def met(own: DataFrame | None, others: DataFrame, every: bool) -> DataFrame:
        """Own rows of a group, in parts, against its other rows, in blocks: a place for each part and block."""
        columns = [F.xxhash64("root", "block", "part").alias("place"), "sig", "wide", "shingles"]
        if own is None:
            rows = others.withColumn("part", F.lit(0)).select(*columns, F.lit(True).alias("own"))
        else:
            parts = stored(own.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
            parts = small(parts, parts.count())
            dealt = own.join(parts, "root").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "sig"), F.col("parts")))
            rows = dealt.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)"))).select(*columns, F.lit(True).alias("own"))
            met_by = others.join(parts, "root").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
            rows = rows.unionByName(met_by.select(*columns, F.lit(False).alias("own")))
        dealt = rows.repartition("place").sortWithinPartitions("place", "sig")
        return dealt.mapInArrow(lambda it: _verified(it, distance, every), _LINK)

    links = met(None, once.where("blocks = 1"), False)
    large = once.where("blocks > 1")
    if large.isEmpty():
        return links.distinct()
    # thinned to about 64 texts a group before they are ordered
    some = large.where(F.pmod(F.xxhash64(F.lit("pivot"), "sig"), F.col("blocks") * max(1, BLOCK // 64)) == 0)
    order = F.row_number().over(Window.partitionBy("root").orderBy("sig"))
    pivots = some.withColumn("nth", order).where(F.col("nth") <= PIVOTS).drop("nth")
    tied = stored(met(pivots, large, True))
    of_pivot = pivots.select(F.col("sig").alias("a"), "root").join(tied.groupBy("a").count(), "a")
    best = stored(of_pivot.groupBy("root").agg(F.max_by("a", F.struct("count", "a")).alias("a")))
    held = tied.join(small(best, best.count()), "a").select(F.col("b").alias("sig")).unionByName(best.select(F.col("a").alias("sig")))
    held = stored(held.distinct())
    rest = large.join(small(held, held.count()), "sig", "left_anti")
    return links.unionByName(tied).unionByName(met(rest, large, False)).distinct()


def near_copies(documents: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(doc_id, place, component_id, n, kept): groups of texts whose five-word shingle sets are similar to 0.8 or more.

    A row per distinct (doc_id, text), the text as its hash ``place``; ``n`` counts its
    repeats, and ``kept`` marks one row of each component: the smallest doc_id, null
    ids last, then the smallest place. ``component_id`` is its doc_id.

    The 64-bit fingerprints at three bits reach only the closest of such pairs, so
    candidates share a band of least hashes here and are close in a SimHash of 512
    bits. That gives candidate groups; within them the shingle sets themselves
    decide. Texts of one shingle set are one node, so exact copies cost nothing;
    all texts without a word are copies of each other. An empty table gives no rows.
    """
    prints = stored(_copy_prints(documents))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    nodes = stored(prints.groupBy("sig").agg(F.min(row).alias("first"), *(F.any_value(c).alias(c) for c in ("bands", "wide"))))
    candidates = stored(components(_candidates(nodes, distance)))
    roots = stored(components(_similar_links(documents, nodes, candidates, distance)))
    member = stored(nodes.select("sig", "first").join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "first"))
    of_sig = with_least(member, member.count(), "root", F.col("first"), "kept_row").select(F.col("sig").alias("of_sig"), "kept_row")
    texts = prints.groupBy("doc_id", "place", "sig").agg(F.count("*").alias("n"))
    return texts.join(of_sig, F.col("sig") == F.col("of_sig")).select(
        "doc_id", "place", F.col("kept_row.doc_id").alias("component_id"), "n", (F.col("kept_row") == row).alias("kept")
    )


def keep_first(documents: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id; columns as they came, whatever their names.

    Null ids come last, so of copies with null ids alone one stays. Of different
    texts of one id each is judged by itself. Of rows that repeat an id and its
    text one stays. Null and empty texts are copies of each other. An empty table
    gives no rows.
    """
    columns = documents.columns
    key, place = fresh_name(documents, "near_id"), fresh_name(documents, "near_place")
    groups = stored(near_copies(documents, distance))
    gone = groups.where("NOT kept").select(F.col("doc_id").alias(key), F.col("place").alias(place))
    repeated = groups.where("kept AND n > 1").select(F.col("doc_id").alias(key), F.col("place").alias(place))
    n_gone, n_repeated = gone.count(), repeated.count()
    here = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(place))
    others = documents.join(small(gone.unionByName(repeated), n_gone + n_repeated), here, "left_anti")
    if not n_repeated:
        return others.select(columns)
    text = F.xxhash64(F.col("text").cast("string"))
    once = documents.join(small(repeated, n_repeated), here, "left_semi").withColumn(place, text).dropDuplicates(["doc_id", place])
    return others.select(columns).unionByName(once.select(columns))
