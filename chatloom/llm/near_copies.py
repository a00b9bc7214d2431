"""The near-duplicate stage: SimHash groups of 5-word shingles, tested exactly, then completed to a Jaccard similarity of 0.8.

First the SimHash operator links documents by fingerprints of 5-word shingles, and every link that it
found is tested on whole shingle sets. Fingerprints alone
cannot hold a similarity of 0.8 (such pairs differ by some 10 of 64 bits, unrelated ones by as few as 15), so
further passes find the pairs that they missed: two sets that similar share one of the first n - ceil(0.8 n) + 1
shingles of each, whatever order all shingles are put in. The order puts shingles seen often in a
sample last, which only keeps the meetings few. Along with the links, each set is tested against the
HUBS sets that are the smallest ids of most of its shingles, which joins nearly all of a large group. Then all meetings of documents that are not yet
linked count, so that no pair is lost and the copies in a group meet few others. Where two sets meet, their sizes
and the places of the shingle in both bound the overlap from above, and only pairs that could reach 0.8 leave
it. A sketch of SKETCH parity bits a set bounds it once more (each differing bit is an element of one set only), for
these pairs and for links and hubs; what is left is tested on whole sets.

Defined cases: a text of fewer than five words is one shingle; null and blank texts are
copies of each other; rows without a doc_id stay, and link no others; a doc_id with several texts links what
any of them is similar to, and the row with its smallest text stays; an exact similarity of 0.8 links; a long text is
one sorted array of numbers; an empty table gives no rows; extra columns are kept and may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_batches, per_slice, slices
from chatloom.llm.simhash import linked_fingerprints, one_of_each_id
from chatloom.operators.graph import connected_components
from chatloom.session import staged

WIDTH = 5
#: Similarity as a fraction of whole numbers, so that the test is exact.
LEAST = 4, 5
#: One of so many documents shows which shingles are common, and so many shingles are put last; neither changes results.
SAMPLED, COMMON = 16, 1 << 17
#: Sets that each set is tested against before all others.
HUBS = 4
#: Parity bits of a set; its bound serves sets of up to some SKETCH * 2 shingles, larger ones pass untested to the exact test.
SKETCH = 2048
#: Meetings of at most so many sets are compared together, by offsets.
SMALL = 64
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDTH + 1)], np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted, distinct shingles of each lower-cased (A-Z) text, hashed to 64 bits."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in number), np.uint64, len(number))
    out = []
    for own in ids:
        if len(own) < WIDTH:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[own].tobytes(), 43)], np.uint64).view(np.int64))
            continue
        h, m = hashes[own], len(own) - WIDTH + 1
        x = sum((h[k : k + m] * _STEPS[k] for k in range(WIDTH)), np.zeros(m, np.uint64))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out.append(np.unique(x.view(np.int64)))
    return out


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 44) - (1 << 63)


def first_shingles(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """As many of the rarest shingles that any set as similar as LEAST shares one of its own. common is sorted; often: how often each was seen."""
    most = len(own) - -(-LEAST[0] * len(own) // LEAST[1]) + 1
    if not len(common):
        return own[:most]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.argsort(np.where(common[at] == own, often[at], 0), kind="stable")[:most]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled documents, sorted, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text", 8_000_000):
                found, n = np.unique(np.concatenate(shingle_sets(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], names=["shingle", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SAMPLED)) == 0).select("text")
    found = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = (np.asarray(found.column(k), np.int64) for k in range(2))
    return shingle[order := np.argsort(shingle)], n[order]


def sketch(own: np.ndarray) -> bytes:
    """Bit k says whether an odd number of elements leave the remainder k."""
    return np.packbits(np.bincount(own & (SKETCH - 1), minlength=SKETCH) & 1, bitorder="little").tobytes()


_FIRST = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.int64())), ("bits", pa.binary())])


def _first(sent):
    def run(rows: pa.RecordBatch, texts: list[str]) -> dict:
        sets = shingle_sets(texts)
        return {
            "doc_id": rows.column(0),
            "key": [_key(x) for x in sets],
            "n": [len(x) for x in sets],
            "first": [first_shingles(x, *sent.value) for x in sets],
            "bits": [sketch(x) for x in sets],
        }

    return run


def _could_reach(n: np.ndarray, part: np.ndarray, pos: np.ndarray, i, j) -> np.ndarray:
    """Sets of different parts and fitting sizes that could be similar if what they meet at is the first that they share."""
    up, down = LEAST
    left = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (part[i] != part[j]) & (down * np.minimum(n[i], n[j]) >= up * np.maximum(n[i], n[j])) & ((up + down) * left >= up * (n[i] + n[j]))


def _meetings(shingle: np.ndarray, n: np.ndarray, part: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that could be similar, of rows sorted by shingle and n. No other pair leaves the place where they meet."""
    start = np.nonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))[0]
    stop = np.append(start[1:], len(shingle))
    size = stop - start
    end, at, d = np.repeat(stop, size), np.nonzero(np.repeat(size <= SMALL, size))[0], 1
    while len(at := at[at + d < end[at]]):
        # Sizes only grow with the offset: a row that one no longer fits is done.
        at = at[LEAST[1] * n[at] >= LEAST[0] * n[at + d]]
        hit = at[_could_reach(n, part, pos, at, at + d)]
        yield hit, hit + d
        d += 1
    for x, y in zip(start[size > SMALL].tolist(), stop[size > SMALL].tolist(), strict=True):
        _, which, members = np.unique(part[x:y], return_inverse=True, return_counts=True)
        # Members of the largest part only meet the others, which meet each other once.
        largest = which == np.argmax(members)
        own = n[x:y]
        for i in np.nonzero(~largest)[0].tolist():
            low, high = (np.searchsorted(own, -(-LEAST[0] * own[i] // LEAST[1])), np.searchsorted(own, LEAST[1] * own[i] // LEAST[0], side="right"))
            j = np.arange(low, high)
            j = x + j[largest[low:high] | (j > i)]
            j = j[_could_reach(n, part, pos, x + i, j)]
            yield np.full(len(j), x + i), j


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, id, n, part, pos) sorted by shingle and n -> (a, b)."""
    held: list[np.ndarray] = []  # rows of a shingle that may go on

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, ids, n, part, pos = rows
        found, waiting = [], 0

        def out() -> pa.RecordBatch:
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for i, j in _meetings(shingle, n, part, pos):
            if len(i):
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
                waiting += len(i)
            if waiting > 1 << 18:
                yield out()
                found, waiting = [], 0
        if found:
            yield out()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(k), np.int64) for k in range(5)])
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if last or held and held[-1][0, -1] != rows[0, 0]:
            yield from closed(np.concatenate([*held, rows[:, :last]], axis=1))
            held = []
        held.append(rows[:, last:])
    if held:
        yield from closed(np.concatenate(held, axis=1))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, sa, sb) -> those (a, b) whose sketches and sizes allow the similarity."""
    up, down = LEAST
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
        one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
        apart = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
        # At most (n - apart) / 2 are shared.
        yield batch.select([0, 1]).filter(pa.array((up + down) * (n - apart) >= 2 * up * n))


def could_be_similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) without those that sizes or sketches rule out; sets: (id, n, bits)."""
    one, two = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").filter(_fit("na", "nb")).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sketched, "a long, b long")


_TEST = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def similar_among(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are similar on whole sets; docs: (id, text)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.lit(1).alias("one")).select("id")
    sets = docs.join(ids, "id", "left_semi").mapInArrow(per_slice(lambda rows, texts: {"id": rows.column(0), "shingles": shingle_sets(texts)}, _TEST), "id long, shingles array<long>")
    sets = staged(sets)
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("a", "b"))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            yield batch.select([0, 1]).filter(pa.array([similar(np.asarray(sa[k].values), np.asarray(sb[k].values)) for k in range(batch.num_rows)], pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(tested, "a long, b long")


def _fit(a: str, b: str) -> Column:
    """Sizes allow the similarity."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def hub_pairs(firsts: DataFrame, hubs: int = HUBS) -> DataFrame:
    """(a, b): each set with those it meets most often among the smallest of its shingles; firsts: (id, n, first)."""
    met = firsts.select(F.explode("first").alias("shingle"), "id", "n")
    least = met.groupBy("shingle").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("most")).filter("hub.id < most").select("shingle", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb"))
    pairs = met.join(least, "shingle").filter((F.col("id") != F.col("b")) & _fit("n", "nb")).groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("met"))
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b"))
    return pairs.withColumn("k", k).filter(F.col("k") <= hubs).select("a", "b")


def meeting_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b) of sets of different parts that could be similar; firsts: (id, n, first, part)."""
    met = firsts.select(F.posexplode("first").alias("pos", "shingle"), "id", "n", "part")
    # Most shingles are of one part, among them those of large groups of copies: they go before rows of a shingle come together.
    mixed = met.groupBy("shingle").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select("shingle")
    met = met.join(mixed, "shingle", "left_semi").select("shingle", "id", "n", "part", F.col("pos").cast("long").alias("pos"))
    return met.repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(_pairs, "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; the smallest doc_id of what similar texts link."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    texts = rows.withColumnRenamed("doc_id", "id")
    sent = docs.sparkSession.sparkContext.broadcast(_common_shingles(rows))
    every = staged(rows.mapInArrow(per_slice(_first(sent), _FIRST), "doc_id long, key long, n long, first array<long>, bits binary"))
    # A set stands for all texts that have it, under its smallest id.
    firsts = staged(every.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits")))
    named = staged(every.select("doc_id", "key").join(firsts.select("key", "id"), "key").groupBy("doc_id", "id").agg(F.lit(1).alias("one")).select("doc_id", "id"))
    # Links of the SimHash operator, under the ids of the sets, and hubs.
    by_print = linked_fingerprints(rows, width=WIDTH)[2]
    set_of = lambda x: named.select(F.col("doc_id").alias(x), F.col("id").alias(f"i{x}"))
    likely = by_print.join(set_of("a"), "a").join(set_of("b"), "b").filter("ia <> ib").select(F.greatest("ia", "ib").alias("a"), F.least("ia", "ib").alias("b"))
    likely = likely.unionByName(hub_pairs(firsts)).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    links = staged(similar_among(texts, staged(could_be_similar(likely, firsts))))
    parts = staged(connected_components(links, "a", "b"))
    parted = firsts.join(parts, firsts["id"] == parts["node"], "left").select("id", "n", "first", F.coalesce("component", "id").alias("part"))
    links = staged(links.unionByName(similar_among(texts, staged(could_be_similar(meeting_pairs(parted), firsts)))))
    parts = connected_components(links, "a", "b")
    found = named.join(parts, named["id"] == parts["node"], "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    return found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows, all columns, of the smallest doc_id of each group; rows without a doc_id stay."""
    first = staged(near_copies(docs).filter("doc_id = component_id").select("doc_id"))
    return one_of_each_id(docs, first).unionByName(docs.filter("doc_id is null"))
