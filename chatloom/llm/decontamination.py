"""Benchmark decontamination by greedy string tiling.

Shared-token seeds join documents to benchmark items: every run of `least` words of an
item is a seed, found in a document by its Karp-Rabin hash. For each pair so joined,
running Karp-Rabin string tiling repeatedly marks the longest matches that do not
overlap, wherever they lie, so that reordered passages count. A pair is contaminated
if tiles cover enough of the item.

The benchmark is read in blocks of bounded size, each one sent to all tasks, so it may be
of any size. Documents are read whole where they lie; nothing is shuffled.

A pair is tiled only if the item's words under shared seeds could reach the threshold, which loses
no pair: items that share a common wording are told apart by counts.

Defined cases: null or empty texts match nothing; items without a word are left out;
items with fewer words than `least` must occur whole; a null doc_id or item_id stays null;
repeated rows give repeated results; of matches of one length the first in the item, then in the document, is
marked first; very long texts are looked at whole; an empty benchmark or an empty table of documents gives no
pairs; extra columns of any name are ignored (and kept by without_contaminated).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import documents, slices

LEAST, FIRST_LENGTH = 5, 32
COVERAGE = 0.5
BLOCK_CHARS = 16_000_000
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WORD = re.compile(r"\w+")
PAIR = "doc_id long, item_id long, n_tiles int, longest_tile int, covered int, item_words int, coverage double"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rolled(ids: list[int], free: bytearray, n: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every run of n free positions."""
    top, h, run = pow(_BASE, n, 1 << 64), 0, 0
    for at, x in enumerate(ids):
        if not free[at]:
            h = run = 0
            continue
        h, run = (h * _BASE + x) & _MASK, run + 1
        if run > n:
            h = (h - ids[at - n] * top) & _MASK
        if run >= n:
            yield at - n + 1, h


def greedy_tiles(item: list[int], doc: list[int], least: int = LEAST, length: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words), longest first; id 0 matches nothing."""
    free_i, free_d = bytearray(x != 0 for x in item), bytearray(x != 0 for x in doc)
    tiles, n = [], max(least, min(length, len(item)))
    while True:
        starts = defaultdict(list)
        for at, h in _rolled(doc, free_d, n):
            starts[h].append(at)
        found, longest = [], 0
        for i, h in _rolled(item, free_i, n):
            for j in starts.get(h, ()):
                k = 0
                while i + k < len(item) and j + k < len(doc) and free_i[i + k] and free_d[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k >= n:
                    found.append((-k, i, j))
                    longest = max(longest, k)
        if longest > 2 * n:
            n = longest
            continue
        marked = False
        for k, i, j in sorted(found):
            if all(free_i[i : i - k]) and all(free_d[j : j - k]):
                free_i[i : i - k] = free_d[j : j - k] = bytes(-k)
                tiles.append((i, j, -k))
                marked = True
        if marked:
            continue  # what is left of an overlapped match may still have n words
        if n == least:
            return tiles
        n = max(least, n // 2)


#: Seeds of all pairs looked at together.
HELD = 1 << 22


class _Seeds:
    """All runs of n words of the items: sorted hashes, and for each the (item, position) pairs that have it."""

    def __init__(self, n: int, runs: list[tuple[int, int, int]]):
        self.n = n
        h, item, at = (np.array(x, t) for x, t in zip(zip(*runs, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        order = np.lexsort((at, item, h))
        self.item, self.at = item[order], at[order]
        self.hashes, self.start = np.unique(h[order], return_index=True)
        self.size = np.diff(np.append(self.start, len(order)))

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes by number: whose turn it is, and places in item and at, one after the other."""
        size = self.size[which]
        turn = np.repeat(np.arange(len(which)), size)
        return turn, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[which], size)


class Items:
    """A block of the benchmark, indexed by seeds."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int = LEAST):
        self.vocabulary: dict[str, int] = {}
        self.items, self.least = [], least
        runs = defaultdict(list)  # seed length -> (hash, item, position)
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            if ids:
                n = min(least, len(ids))
                runs[n] += [(h, len(self.items), at) for at, h in _rolled(ids, bytearray(b"\1" * len(ids)), n)]
                self.items.append((item_id, ids))
        self.lengths = np.array([len(x[1]) for x in self.items], np.int64)
        self.seeds = [_Seeds(n, x) for n, x in sorted(runs.items())]

    def _likely(self, seeds: _Seeds, doc: np.ndarray, which: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(text, item) pairs whose seeds cover enough of the item. doc, which: distinct pairs of a text and a seed's number, sorted."""
        total = np.append(0, np.cumsum(seeds.size[which]))
        edges = np.append(np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[0], len(doc)) if len(doc) else np.zeros(1, np.int64)
        k = 0
        while k < len(edges) - 1:
            # As many whole texts as stay within HELD, one at least.
            to = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + HELD, side="right")) - 1)
            at, stop, k = edges[k], edges[to], to
            turn, place = seeds.places(which[at:stop])
            own, item, pos = doc[at:stop][turn], seeds.item[place], seeds.at[place]
            order = np.lexsort((pos, item, own))
            own, item, pos = own[order], item[order], pos[order]
            edge = np.nonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (item[1:] != item[:-1]))))[0]
            width = np.minimum(np.append(pos[1:] - pos[:-1], seeds.n), seeds.n)
            width[np.append(edge[1:], len(pos)) - 1] = seeds.n
            most = np.add.reduceat(width, edge)
            good = edge[most >= coverage * self.lengths[item[edge]]]
            yield from zip(own[good].tolist(), item[good].tolist(), strict=True)

    def match(self, texts: list[str], coverage: float = 0.0) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(number of the text, number of the item, tiles) for every pair that shares a seed and could reach the coverage.

        Tiles lie under shared seeds, so what these cover of an item bounds what tiles can;
        pairs below the threshold, as those of items with a common beginning, are never tiled.
        """
        get, ids, size = self.vocabulary.get, [], []
        for text in texts:
            found = [get(w, 0) for w in words(text)]
            ids += found
            ids.append(0)  # parts the texts
            size.append(len(found) + 1)
        flat = np.array(ids, np.uint64)
        begin = np.concatenate(([0], np.cumsum(size)))
        for seeds in self.seeds:
            n, hashes = seeds.n, seeds.hashes
            m = len(flat) - n + 1
            if m <= 0:
                continue
            key, known = np.zeros(m, np.uint64), np.ones(m, bool)
            for k in range(n):
                key = key * np.uint64(_BASE) + flat[k : k + m]
                known &= flat[k : k + m] > 0
            at = np.nonzero(known)[0]
            which = np.minimum(np.searchsorted(hashes, key[at]), len(hashes) - 1)
            near = hashes[which] == key[at]
            at, which = at[near], which[near]
            doc = np.searchsorted(begin, at, side="right") - 1
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            pairs = np.unique(doc * len(hashes) + which)
            held: dict[int, np.ndarray] = {}
            for d, item in self._likely(seeds, *np.divmod(pairs, len(hashes)), coverage):
                own = self.items[item][1]
                if item not in held:
                    held[item] = np.array(sorted({h for _, h in _rolled(own, bytearray(b"\1" * len(own)), n)}), np.uint64)
                mine = slice(first[d], first[d + 1])
                # All of a match lies under seeds, so the rest of the document is left aside.
                part: list[int] = []
                stop = -1
                for a in at[mine][np.isin(hashes[which[mine]], held[item])].tolist():
                    if a > stop and part:
                        part.append(0)
                    part += ids[max(a, stop) : a + n]
                    stop = a + n
                yield d, item, greedy_tiles(own, part, n)


def blocks(benchmark: DataFrame, most_chars: int = BLOCK_CHARS, key: str = "item_id", text: str = "text") -> Iterator[list[tuple]]:
    """The benchmark's rows in lists of about most_chars."""
    rows = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // most_chars))
    for k in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every document and item whose tiles cover the item to the threshold."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("n_tiles", "longest_tile", "covered", "item_words")), ("coverage", pa.float64())])
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(Items(block, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids, found = part.column(0).to_pylist(), []
                    for doc, item, tiles in items.match(texts, coverage):
                        item_id, own = items.items[item]
                        covered = sum(x[2] for x in tiles)
                        if covered >= coverage * len(own):
                            found.append((ids[doc], item_id, len(tiles), max(x[2] for x in tiles), covered, len(own), covered / len(own)))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        pairs = rows.mapInArrow(run, PAIR)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which no benchmark item is covered to the threshold."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        sent = spark.sparkContext.broadcast(Items(block, least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part, texts in slices(batch, text):
                    keep = np.ones(len(texts), bool)
                    for doc, item, tiles in items.match(texts, coverage):
                        keep[doc] &= sum(x[2] for x in tiles) < coverage * len(items.items[item][1])
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
