"""Exact vector similarity: near-duplicate pairs, pair counts, Hamming pairs, top-k, perceptual hashes.

Pairs of vectors are compared tile by tile. Each vector belongs to the cell of its nearest pivot and lies in a tile
of vectors of about the same angle to it, so the triangle inequality bounds every angle between two tiles from below; pairs of tiles
that cannot reach the wanted cosine are never compared. Tiles travel in blocks, of which there are STRIPES at most until a block is full, so what is
shuffled follows the rows and not their square. Counts over all pairs, and the components that pairs link, are taken inside the tasks. Fingerprints within a
small distance agree in some bands whole, by which they are joined; for large distances, where such bands say nothing, tiles are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.windows import global_rank
from chatloom.session import staged

BLOCK = 2000
#: Tiles of a block at least and at most, and blocks wanted: each row is sent to as many tasks.
LEAST_TILES, MOST_TILES, STRIPES = 4, 128, 24
#: Rows of a tile that are compared at once, so that the cosines stay in a core's cache.
SLAB = 128
#: Pivots at most, so that pairs of cells stay few, and rows that pivots are chosen from.
PIVOTS, PIVOT_ROWS = 256, 4096
#: Copies of a fingerprint at most, bits that its bands must hold, and fingerprints wanted for each value of them.
COPIES, LEAST_BITS, CROWD = 40, 8, 16
#: Slack of bounds on angles against rounding.
SLACK = 1e-6


def _unit(values) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat, n = values.flatten(), len(values)
    even = n and not values.null_count and not flat.null_count and (pa.compute.list_value_length(values).unique().to_pylist() == [len(flat) // n])
    m = np.asarray(flat).astype(np.float64).reshape(n, -1) if even else np.array(values.to_pylist(), np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else np.zeros((0, 1))


def _pivots(rows: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """n pivots far from each other, from PIVOT_ROWS rows of least hash."""
    found = _unit(rows.orderBy(F.xxhash64(key), key).limit(PIVOT_ROWS).select(vector).toArrow().column(0))
    chosen, near = [0], found @ found[0]
    while len(chosen) < min(n, len(found)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, found @ found[chosen[-1]])
    return found[chosen]


def tiles(rows: DataFrame, key: str, vector: str, least: float, extra: tuple[str, ...] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(cell, tile, id, v, extra) and the pairs of tiles (x, y), x <= y, in which some pair could reach the cosine `least`."""
    spark, n = rows.sparkSession, rows.count()
    pivots = _pivots(rows, key, vector, max(1, min(PIVOTS, n // block))) if n else np.zeros((1, 1))
    columns = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *extra)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(batch.column(1)) @ pivots.T if batch.num_rows else np.zeros((0, 1))
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)
    ranked = staged(global_rank(columns.mapInArrow(cells, f"{kinds}, cell int, angle double"), ["cell", "angle", "id"], "place"))
    # Tiles are runs of `block` places; those that would reach into another cell are cut there.
    placed = ranked.withColumn("tile", (F.floor(F.col("place") / block) * PIVOTS + F.col("cell")).cast("long"))
    about = placed.groupBy("tile", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    most = math.acos(max(-1.0, min(1.0, least)))
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach = {r["cell"]: r["high"] for r in about.groupBy("cell").agg(F.max("high").alias("high")).collect()}  # PIVOTS rows
    meet = [(i, j, float(between[i, j])) for i in reach for j in reach if between[i, j] - reach[i] - reach[j] <= most + SLACK]
    meet = F.broadcast(spark.createDataFrame(meet, "cell int, other int, apart double"))  # PIVOTS * PIVOTS rows at most
    other = about.select(F.col("cell").alias("other"), F.col("tile").alias("y"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    bound = F.greatest(F.col("apart") - F.col("high") - F.col("_high"), F.col("low") - F.col("apart") - F.col("_high"), F.col("_low") - F.col("apart") - F.col("high"))
    pairs = about.join(meet, "cell").join(other, "other").filter((F.col("tile") <= F.col("y")) & (bound <= most + SLACK))
    return placed.drop("place", "angle", "cell"), pairs.select(F.col("tile").alias("x"), "y")


def blocks(rows: DataFrame, key: str, vector: str, least: float, extra: tuple[str, ...] = (), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(tile, id, v, extra, block) and the pairs of blocks (a, b, meet), a <= b, with the pairs of their tiles that could reach `least`."""
    dealt, pairs = tiles(rows, key, vector, least, extra, block)
    held = staged(global_rank(dealt.select("tile").distinct(), ["tile"], "_place"))
    per = max(LEAST_TILES, min(MOST_TILES, -(-held.count() // STRIPES)))
    of = held.select("tile", F.floor(F.col("_place") / per).cast("int").alias("block"))
    side = lambda c: of.select(F.col("tile").alias(c), F.col("block").alias(f"_{c}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
    return staged(dealt.join(of, "tile")), staged(met.groupBy("a", "b").agg(F.collect_list(F.struct("x", "y")).alias("meet")))


def over_blocks(dealt: DataFrame, met: DataFrame, reduce: Callable[[dict[str, np.ndarray], Iterator[tuple]], pa.Table], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What reduce(columns of all rows, compared) makes of each pair of blocks; see over_pairs()."""
    both = met.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    sent = dealt.select("tile", "id", "v", "block", *extra).join(both, "block").drop("block")
    wanted = met.select(F.col("a").alias("c"), F.col("b").alias("d"), "meet")

    def run(group: pa.Table, wanted: pa.Table) -> pa.Table:
        group = group.sort_by([("tile", "ascending"), ("id", "ascending")]) if group.num_rows else group
        return reduce({c: np.asarray(group.column(c)) for c in extra}, _compared(group, wanted, extra))

    return sent.groupBy("a", "b").cogroup(wanted.groupBy("c", "d")).applyInArrow(run, schema)


def _compared(group: pa.Table, wanted: pa.Table, extra: tuple[str, ...]) -> Iterator[tuple]:
    """Pairs of tiles in runs of SLAB rows of the first."""
    tile, ids = np.asarray(group.column("tile")), np.asarray(group.column("id"))
    own = {c: np.asarray(group.column(c)) for c in extra}
    first = np.flatnonzero(np.diff(tile, prepend=-1) != 0)
    at = dict(zip(tile[first].tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(tile)]), strict=True))
    vectors, meet = group.column("v"), [p for x in wanted.column("meet").to_pylist() for p in x]
    cut = lambda s: _unit(vectors.slice(s.start, s.stop - s.start))
    last, left = None, np.zeros((0, 1))
    for x, y in sorted((p["x"], p["y"]) for p in meet):
        if x != last:
            last, left = x, cut(at[x])
        b, right = at[y], None
        apart = x != y and not np.isin(ids[at[x]], ids[b]).any()
        for k in range(0, len(left), SLAB):
            a = slice(at[x].start + k, min(at[x].start + k + SLAB, at[x].stop))

            def cosines(part=left[k : k + SLAB], b=b) -> np.ndarray:
                nonlocal right
                right = cut(b).T if right is None else right
                return part @ right

            asked = None if apart else ids[a][:, None] < ids[b][None, :] if x == y else ids[a][:, None] != ids[b][None, :]
            yield ids[a], ids[b], {c: v[a] for c, v in own.items()}, {c: v[b] for c, v in own.items()}, cosines, asked


def over_pairs(rows: DataFrame, key: str, vector: str, least: float, reduce: Callable[[dict[str, np.ndarray], Iterator[tuple]], pa.Table], schema: str, extra: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """What reduce(columns of all rows, compared) makes of each pair of blocks of tiles.

    compared gives (ids, others, columns, columns of others, cosines(), asked) of some rows against those of a tile that could reach `least`.
    asked marks the pairs to count, each pair of rows once, with the smaller id first or second alike; it is None where all are.
    """
    return over_blocks(*blocks(rows, key, vector, least, extra, block), reduce, schema, extra)


def cosine_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, cosine) of all pairs left < right with a cosine of `least` or more. Ids are unique."""

    def near(_held, compared) -> pa.Table:
        out = [pa.table({"left_id": pa.array([], pa.int64()), "right_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})]
        for a, b, _, __, cosines, asked in compared:
            dots = cosines()
            i, j = np.nonzero(dots >= least if asked is None else asked & (dots >= least))
            out.append(pa.table({"left_id": np.minimum(a[i], b[j]), "right_id": np.maximum(a[i], b[j]), "cosine": pa.array(dots[i, j], pa.float64())}))
        return pa.concat_tables(out)

    return over_pairs(rows, key, vector, least, near, "left_id long, right_id long, cosine double", (), block)


class _Parts:
    """Components of the values seen, each under its smallest; a value is a part of its own until it is linked."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.of = np.arange(len(self.values))

    def place(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.values, values)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (up := self.of[self.of] != self.of).any():
                self.of[up] = self.of[self.of[up]]


def near_links(rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id): links that join the same rows as all pairs with a cosine of `least` or more do, and name no others.

    Blocks of rows find their own components first. Then blocks meet by these: two tiles that are one component by then are not compared,
    and a task gives back one link for each component that it has joined to another, not every pair.
    """
    dealt, met = blocks(rows, key, vector, least, (), block)

    def links(held, compared) -> pa.Table:
        parts = _Parts(held["part"])
        for _, __, own, other, cosines, asked in compared:
            i, j = parts.place(own["part"]), parts.place(other["part"])
            first = parts.of[i[0]]
            if (parts.of[i] == first).all() and (parts.of[j] == first).all():
                continue
            near = cosines() >= least
            a, b = np.nonzero(near if asked is None else asked & near)
            parts.link(i[a], j[b])
        joined = np.flatnonzero(parts.of != np.arange(len(parts.of)))
        return pa.table({"left_id": pa.array(parts.values[parts.of[joined]], pa.int64()), "right_id": pa.array(parts.values[joined], pa.int64())})

    schema = "left_id long, right_id long"
    inside = staged(over_blocks(dealt.withColumn("part", F.col("id")), met.filter("a = b"), links, schema, ("part",)))
    parted = dealt.join(inside.select(F.col("right_id").alias("id"), F.col("left_id").alias("_part")), "id", "left").withColumn("part", F.coalesce("_part", "id"))
    return inside.unionByName(over_blocks(parted, met.filter("a < b"), links, schema, ("part",)))


def _binned(dots: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each cosine over [-1, 1], the last one closed; dots are overwritten."""
    np.clip(dots, -1, 1, out=dots)
    dots += 1
    dots *= bins / 2
    at = dots.astype(np.int64)
    return np.minimum(at, bins - 1, out=at)


def cosine_histogram(rows: DataFrame, key: str, vector: str, bins: int = 20, block: int = BLOCK) -> DataFrame:
    """(bin, n) over all pairs, counted in the tiles; the last bin is closed, empty bins are 0."""

    def count(_held, compared) -> pa.Table:
        n = np.zeros(bins, np.int64)
        for _, __, ___, ____, cosines, asked in compared:
            at = _binned(cosines(), bins)
            n += np.bincount(at.ravel() if asked is None else at[asked], minlength=bins)
        return pa.table({"bin": pa.array(np.flatnonzero(n), pa.int64()), "n": pa.array(n[n > 0], pa.int64())})

    counts = over_pairs(rows, key, vector, -1.0, count, "bin long, n long", (), block).groupBy("bin").agg(F.sum("n").alias("n"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pool_counts(rows: DataFrame, key: str, vector: str, pool: Callable[[dict, dict], np.ndarray], names: tuple[str, ...], thresholds: tuple[float, ...], extra: tuple[str, ...], bins: int = 20, block: int = BLOCK) -> DataFrame:
    """(pool, pairs, at_or_above array, histogram array, warning) for every pool, counted in the tiles.

    pool(columns, columns of others) gives a matrix of pool numbers, below 0 for none. Columns are arrays of shape (n, 1)
    and (1, m). A pool without a pair at any threshold is EMPTY_STRUCTURAL_POOL.
    """

    def count(_held, compared) -> pa.Table:
        n, above = np.zeros((len(names) + 1, bins), np.int64), np.zeros((len(thresholds), len(names) + 1), np.int64)
        for _, __, own, other, cosines, asked in compared:
            dots = cosines()
            where = np.broadcast_to(pool({c: v[:, None] for c, v in own.items()}, {c: v[None, :] for c, v in other.items()}), dots.shape)
            where = np.where(where < 0, len(names), where)  # those of no pool are counted last
            if asked is not None:
                where[~asked] = len(names)
            high = dots >= min(thresholds)
            near, in_pool = dots[high], where[high]
            for k, t in enumerate(thresholds):
                above[k] += np.bincount(in_pool[near >= t], minlength=len(names) + 1)
            at = _binned(dots, bins)
            where *= bins
            at += where
            n += np.bincount(at.ravel(), minlength=n.size).reshape(n.shape)
        own = range(len(names))
        return pa.table({"k": pa.array(own, pa.int32()), "pairs": pa.array([int(n[k].sum()) for k in own], pa.int64()), "above": pa.array([above[:, k].tolist() for k in own], pa.list_(pa.int64())), "bins": pa.array([n[k].tolist() for k in own], pa.list_(pa.int64()))})

    counts = over_pairs(rows, key, vector, -1.0, count, "k int, pairs long, above array<long>, bins array<long>", extra, block)
    each = lambda c, n: F.array(*(F.coalesce(F.sum(F.col(c)[j]), F.lit(0)) for j in range(n)))
    counts = counts.groupBy("k").agg(F.sum("pairs").alias("pairs"), each("above", len(thresholds)).alias("above"), each("bins", bins).alias("bins"))
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "k int, pool string").join(counts, "k", "left")
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    found = every.select("pool", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("above", zeros(len(thresholds))).alias("at_or_above"), F.coalesce("bins", zeros(bins)).alias("histogram"))
    return found.withColumn("warning", F.when(F.aggregate("at_or_above", F.lit(0).cast("long"), lambda s, x: s + x) == 0, "EMPTY_STRUCTURAL_POOL"))


def measure_counts(rows: DataFrame, key: str, vector: str, bits: str, least: float, most: int, block: int = BLOCK) -> DataFrame:
    """(cosine, phash, both, edges): how many pairs each measure finds, counted in the tiles."""

    def count(_held, compared) -> pa.Table:
        n = np.zeros(4, np.int64)
        for _, __, own, other, cosines, asked in compared:
            h = np.bitwise_count(own[bits].astype(np.int64).view(np.uint64)[:, None] ^ other[bits].astype(np.int64).view(np.uint64)[None, :]) <= most
            c = cosines() >= least
            if asked is not None:
                c &= asked
                h &= asked
            n += [np.count_nonzero(x) for x in (c, h, c & h, c | h)]
        return pa.table({name: pa.array([int(x)], pa.int64()) for name, x in zip(("cosine", "phash", "both", "edges"), n, strict=True)})

    counts = over_pairs(rows, key, vector, -1.0, count, "cosine long, phash long, both long, edges long", (bits,), block)
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cosine", "phash", "both", "edges")))


# --- fingerprints --------------------------------------------------------------------------------------


def band_plan(n: int, most: int) -> tuple[list[int], int] | None:
    """(masks of bands, bands that agree) by which n fingerprints within `most` bits are joined; None where no bands would tell.

    Of most + k bands k agree whole. k is the least that leaves each value of k bands to about CROWD fingerprints.
    """
    for k in range(1, 5):
        bands = most + k
        if bands > 64 or math.comb(bands, k) > COPIES or k * (64 // bands) < LEAST_BITS:
            continue
        if n >> (k * (64 // bands)) <= CROWD or k == 4 or math.comb(bands + 1, k + 1) > COPIES:
            cuts = [64 * j // bands for j in range(bands + 1)]
            return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)], k
    return None


def hamming_pairs(rows: DataFrame, key: str, bits: str, most: int, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, distance) of all pairs left < right within `most` bits. Null fingerprints have no pairs."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(bits).cast("long").alias("fp")).filter("fp is not null")
    plan = band_plan(own.count(), most)
    return _by_tiles(own, most, block) if plan is None else _by_bands(own, most, *plan)


def _by_bands(own: DataFrame, most: int, masks: list[int], agree: int) -> DataFrame:
    """Distinct fingerprints meet by the bands that agree, each pair in its first ones only, and are then given their rows."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    plans = []
    for k, chosen in enumerate(combinations(range(len(masks)), agree)):
        before = [signed(masks[b]) for b in range(chosen[-1]) if b not in chosen]
        plans.append(F.struct(F.lit(k).alias("plan"), F.lit(signed(sum(masks[b] for b in chosen))).cast("long").alias("mask"), F.array(*(F.lit(x).cast("long") for x in before)).cast("array<bigint>").alias("before")))
    distinct = staged(own.select("fp").distinct())
    dealt = distinct.withColumn("at", F.explode(F.array(*plans))).select("fp", "at.plan", F.col("fp").bitwiseAND(F.col("at.mask")).alias("value"), "at.before")
    away = dealt.select(F.col("fp").alias("other"), "plan", "value")
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    met = dealt.join(away, ["plan", "value"]).filter(F.col("fp") < F.col("other")).filter(F.bit_count(differ) <= most).filter(F.forall("before", lambda m: differ.bitwiseAND(m) != 0))
    near = met.select("fp", "other", F.bit_count(differ).cast("long").alias("distance"))
    left, right = own.select("fp", F.col("id").alias("_a")), own.select(F.col("fp").alias("other"), F.col("id").alias("_b"))
    pairs = near.join(left, "fp").join(right, "other").select("_a", "_b", "distance")
    same = left.join(own.select("fp", F.col("id").alias("_b")), "fp").filter("_a < _b").select("_a", "_b", F.lit(0).cast("long").alias("distance"))
    return pairs.unionByName(same).select(F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id"), "distance")


def _by_tiles(own: DataFrame, most: int, block: int) -> DataFrame:
    """All pairs of tiles of fingerprints."""
    n = max(1, -(-own.count() // block))
    dealt = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    sides = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id", "fp")

    def near(group: pa.Table) -> pa.Table:
        b, ids, v = np.asarray(group.column("b")), np.asarray(group.column("id")), np.asarray(group.column("fp"), np.int64).view(np.uint64)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        far = np.bitwise_count(v[left][:, None] ^ v[right][None, :])
        i, j = np.nonzero(far <= most)
        a, c = ids[left[i]], ids[right[j]]
        keep = a < c if x == y else a != c
        return pa.table({"left_id": np.minimum(a, c)[keep], "right_id": np.maximum(a, c)[keep], "distance": pa.array(far[i, j][keep].astype(np.int64))})

    return sides.groupBy("x", "y").applyInArrow(near, "left_id long, right_id long, distance long")


def sign_bits(vector: str) -> Column:
    """The signs of a vector column of up to 64 numbers as bits, the first lowest."""
    return F.expr(f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (s, b) -> s | b)")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_top_k(rows: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, most_queries: int = 4096) -> DataFrame:
    """Exact nearest rows by cosine, without the row itself. Queries go to every task in blocks of most_queries, and k rows a query come back from it."""
    spark, out = rows.sparkSession, None
    n = max(1, -(-queries.count() // most_queries))
    for b in range(n):
        got = queries.filter(F.pmod(F.xxhash64(query), F.lit(n)) == b).select(query, vector).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(got.column(0), np.int64), _unit(got.column(1))))

        def near(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            score, held = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
            for batch in batches if len(q) else ():
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids = np.asarray(part.column(0), np.int64)
                    s = np.where(names[:, None] == ids[None, :], -2.0, np.round(q @ _unit(part.column(1)).T, 6))
                    score, held = np.hstack([score, s]), np.hstack([held, np.broadcast_to(ids, s.shape)])
                    best = np.lexsort((held, -score), axis=1)[:, :k]
                    score, held = np.take_along_axis(score, best, 1), np.take_along_axis(held, best, 1)
            which = np.repeat(np.arange(len(names)), held.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names[which], pa.int64()), pa.array(held.ravel(), pa.int64()), pa.array(score.ravel(), pa.float64())], names=["query_id", "id", "score"])

        found = rows.select(key, vector).mapInArrow(near, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.filter("score > -2").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts over [-1, 1] in equal bins, the last one closed; empty bins are 0, values outside are dropped."""
    at = F.least(F.floor((F.col(value) + 1) * (bins / 2)), F.lit(bins - 1)).cast("long")
    counts = rows.filter(F.col(value).between(-1, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits of a 32 x 32 grey image: low 8 x 8 cosine coefficients above their median (taken without the first)."""
    n = 32
    basis = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(n)[:, None] / (2 * n))
    low = (basis @ grey.astype(float) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">u8")[0])


def edge_counts(cosine_edges: DataFrame, hamming_edges: DataFrame) -> DataFrame:
    """(cosine, phash, both, edges): how many pairs each measure found."""
    flag = lambda df, name: df.select("left_id", "right_id", F.lit(True).alias(name))
    edges = flag(cosine_edges, "_c").join(flag(hamming_edges, "_h"), ["left_id", "right_id"], "full")
    c, h = F.col("_c").isNotNull(), F.col("_h").isNotNull()
    return edges.agg(F.count_if(c).alias("cosine"), F.count_if(h).alias("phash"), F.count_if(c & h).alias("both"), F.count("*").alias("edges"))
