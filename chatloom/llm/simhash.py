"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their two
32-bit halves (33 x 33 cells at most). Two fingerprints within the radius lie in cells
whose counts differ by no more than the radius in sum, so all other cell pairs are
skipped unseen. A cell is dealt into tiles of bounded size; a task compares one tile with
a few others. Inside, a tile falls into runs by the population counts of its quarters, runs that
differ beyond the radius are skipped too, and the rest is compared by numpy exclusive-or
and bit counts. Every task reduces its links to a forest before it emits
them, so a group of k copies yields about k links a task and never all its pairs.

A tile travels to the tiles it meets, so shuffled bytes are the fingerprints times the number of tiles
they meet; with n fingerprints that is about 0.2 n / TILE of them beyond the first dozen.

Defined cases: a null or blank text has fingerprint zero and links like any other; a
null doc_id takes part with its text's fingerprint but is no candidate for a component
id (null where its fingerprint has no other); repeated rows give repeated results; rows with
one doc_id and several texts are linked each by its own text; a tie for a component's id cannot
be, as ids are whole numbers; a very long text is read in blocks of shingles; an empty table gives no rows;
extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from chatloom.llm.common import documents, per_slice
from chatloom.operators.graph import connected_components
from chatloom.session import staged

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, and tiles that a task compares one with.
TILE, VISITORS = 1 << 15, 4
_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash over word shingles of a lower-cased (A-Z) text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat, stop = b" ".join(words), np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - width + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    total, n = np.zeros(64, np.int64), len(start)
    stop = stop[width - 1 :].tolist()
    for at in range(0, n, 4096):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(start[at : at + 4096], stop[at : at + 4096], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _prints(width: int):
    def run(rows: pa.RecordBatch, texts: list[str]) -> dict:
        fp = np.fromiter((fingerprint(x, width) for x in texts), np.uint64, len(texts)).view(np.int64)
        return {"doc_id": rows.column(0), "fp": fp}

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; fp is the unsigned value's two's complement."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_slice(_prints(width), _PRINT), "doc_id long, fp long")


class _Runs:
    """Fingerprints in order of the population counts of their quarters, and the runs of equal counts."""

    def __init__(self, fps: np.ndarray, ids: np.ndarray):
        quarter = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)
        code = ((quarter[:, 0] * 17 + quarter[:, 1]) * 17 + quarter[:, 2]) * 17 + quarter[:, 3]
        order = np.argsort(code, kind="stable")
        self.fps, self.ids, code = fps[order], ids[order], code[order]
        self.start = np.nonzero(np.concatenate(([True], code[1:] != code[:-1])))[0] if len(code) else np.zeros(0, np.int64)
        self.stop = np.append(self.start[1:], len(code))
        self.count = quarter[order][self.start]

    def near(self, other: _Runs, radius: int) -> zip:
        """Pairs of runs whose counts differ by no more than the radius in sum."""
        far = np.zeros((len(self.start), len(other.start)), np.int64)
        for k in range(4):
            far += np.abs(self.count[:, k][:, None] - other.count[:, k][None, :])
        return zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True)


def _join(lab: np.ndarray, r: np.ndarray, c: np.ndarray, out: list) -> None:
    """Merge labels over the links (r, c) and add to out those links that merged two: a forest of true links."""
    while True:
        a, b = lab[r], lab[c]
        live = np.nonzero(a != b)[0]
        if not len(live):
            return
        r, c, high, low = r[live], c[live], np.maximum(a[live], b[live]), np.minimum(a[live], b[live])
        # Each label hooks onto one smaller label, so no circle can close.
        hooked, first = np.unique(high, return_index=True)
        out.append((r[first], c[first]))
        to = np.arange(len(lab))
        to[hooked] = low[first]
        while ((nxt := to[to]) != to).any():
            to = nxt
        lab[:] = to[lab]


def _link(own: _Runs, other: _Runs, radius: int, lab: np.ndarray, at: int, out: list) -> None:
    """Join labels of all pairs within the radius; `at` is where other starts in lab, own starts at 0."""
    rows, cols, held = [], [], 0
    for i, j in own.near(other, radius):
        if own is other and j < i:
            continue
        for a in range(own.start[i], own.stop[i], 128):
            mine = own.fps[a : min(a + 128, own.stop[i])]
            for b in range(other.start[j], other.stop[j], 4096):
                r, c = np.nonzero(np.bitwise_count(mine[:, None] ^ other.fps[b : min(b + 4096, other.stop[j])][None, :]) <= radius)
                if own is other and i == j:
                    r, c = r[keep := r + a < c + b], c[keep]
                if len(r):
                    rows.append(r + a)
                    cols.append(c + (b + at))
                    held += len(r)
                if held > 1 << 20:
                    _join(lab, np.concatenate(rows), np.concatenate(cols), out)
                    rows, cols, held = [], [], 0
    if held:
        _join(lab, np.concatenate(rows), np.concatenate(cols), out)


def _compare(radius: int):
    def run(group: pa.Table) -> pa.Table:
        home = np.asarray(group.column("home"), dtype=bool)
        tiles = [_Runs(np.asarray(f.values, dtype=np.int64).view(np.uint64), np.asarray(x.values, dtype=np.int64)) for f, x in zip(group.column("fps"), group.column("ids"), strict=True)]
        own = next(k for k, h in enumerate(home) if h)
        order = [own, *(k for k in range(len(tiles)) if k != own)]
        every = np.concatenate([tiles[k].ids for k in order])
        lab, at, out = np.arange(len(every)), 0, []
        for k in order:
            if k != own or group.column("inner")[own].as_py():
                _link(tiles[own], tiles[k], radius, lab, at, out)
            at += len(tiles[k].ids)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": every[a], "b": every[b]})

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """(a, b): pairs of fingerprints within the radius, as the smallest doc_id of each; of those that a task finds a spanning forest.

    prints: (fp, id), one row a fingerprint. A tile meets its own cell's later tiles
    and the tiles of the cells ahead of it, `visitors` tiles a task.
    """
    spark = prints.sparkSession
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).cast("int")
    cells = prints.withColumn("hi", half(32)).withColumn("lo", half(0))
    held = {(r["hi"], r["lo"]): -(-r["n"] // tile) for r in cells.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 * 33 rows at most
    if not held:
        return spark.createDataFrame([], "a long, b long")
    ahead = [(dh, dl) for dh in range(radius + 1) for dl in range(-radius, radius + 1) if dh + abs(dl) <= radius and (dh, dl) > (0, 0)]
    meet = {(h, lo): [(h + dh, lo + dl) for dh, dl in ahead if (h + dh, lo + dl) in held] for h, lo in held}
    parts = {at: max(1, -(-(held[at] + sum(held[x] for x in others)) // visitors)) for at, others in meet.items()}
    chunks = spark.createDataFrame([(*at, n, parts[at]) for at, n in held.items()], "hi int, lo int, chunks int, parts int")
    tiles = cells.join(F.broadcast(chunks), ["hi", "lo"]).withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks")).cast("int"))
    tiles = tiles.groupBy("hi", "lo", "chunk").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("fp", "id")).alias("x"))
    tiles = staged(tiles.select("hi", "lo", "chunk", "parts", F.col("x.fp").alias("fps"), F.col("x.id").alias("ids")))
    # Visitor cell -> the home cells it lies ahead of, and its own: 1,089 * 21 rows at most.
    pairs = [(*home, *away, held[home], parts[home]) for home, others in meet.items() for away in [home, *others]]
    pairs = spark.createDataFrame(pairs, "h_hi int, h_lo int, hi int, lo int, h_chunks int, h_parts int")
    away = tiles.join(F.broadcast(pairs), ["hi", "lo"]).withColumn("h_chunk", F.explode(F.sequence(F.lit(0), F.col("h_chunks") - 1)))
    away = away.filter((F.col("h_hi") != F.col("hi")) | (F.col("h_lo") != F.col("lo")) | (F.col("chunk") > F.col("h_chunk")))
    away = away.select("h_hi", "h_lo", "h_chunk", F.pmod(F.hash("hi", "lo", "chunk"), F.col("h_parts")).alias("part"), F.lit(False).alias("home"), F.lit(False).alias("inner"), "fps", "ids")
    # A home tile goes to each of its parts; the first part also compares it with itself.
    home = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = home.select(F.col("hi").alias("h_hi"), F.col("lo").alias("h_lo"), F.col("chunk").alias("h_chunk"), "part", F.lit(True).alias("home"), (F.col("part") == 0).alias("inner"), "fps", "ids")
    both = home.unionByName(away)
    return both.groupBy("h_hi", "h_lo", "h_chunk", "part").applyInArrow(_compare(radius), "a long, b long")


def linked_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp), distinct ones (fp, id) under their smallest doc_id, and links (a, b) between those."""
    prints = staged(fingerprints(docs, key, text, width))
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    return prints, distinct, staged(near_links(distinct.filter("id is not null"), radius))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for every row of docs."""
    prints, distinct, links = linked_fingerprints(docs, key, text, width, radius)
    parts = connected_components(links, "a", "b")
    named = distinct.join(parts, distinct["id"] == parts["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(staged(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these ids, all columns; of several with one id the one with the smallest text, then the smallest other columns (those that Spark cannot order, such as maps, as JSON)."""
    found = rows.join(ids, "doc_id", "left_semi")
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    ordered = [F.to_json(F.struct(c)) if _has_map(rows.schema[c].dataType) else F.col(c) for c in others]
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("text", *others), F.struct("text", *ordered)).alias("_row"))
    return first.select("doc_id", "_row.*").select(rows.columns)


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return True
    return any(_has_map(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, ArrayType) and _has_map(kind.elementType)


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The rows, all columns, of the smallest doc_id of each group; rows without a doc_id stay; of rows with one doc_id that with the smallest text."""
    found = near_duplicates(docs, "doc_id", "text", width, radius)
    first = staged(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.lit(1).alias("one")).select("doc_id"))
    return one_of_each_id(docs, first).unionByName(docs.filter("doc_id is null"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
