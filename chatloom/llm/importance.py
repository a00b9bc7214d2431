"""Importance resampling towards a target, with word tries that live in a partition.

A feature is a run of one to three consecutive words; it falls into a bucket by the CRC-32 of its text. A
task reads its rows into a trie of words: a node is a run, holds how often the run occurs and the state of the
CRC after it, and a child's state continues its parent's by a space and one more word, so no run is ever spelled
out. A trie is closed once it has read TRIE_WORDS words, its counts are added to the task's bucket totals, and a new one begins: totals add
up, so where tries and partitions end changes nothing. The totals of raw and target texts give each
bucket a gain. Then documents are read into tries again, nodes take the gain of their bucket, and
a document's weight is the sum over the paths that its words walk. The draw ranks weights with a noise made
from the id alone, by ranges and without a task that sees all rows.

Defined cases: a null text has no words, as an empty one; texts without words weigh 0; a null id is drawn
with the noise of an empty id, after all ids of its score; repeated rows are each a document; ties go to the smaller
id; rows equal in score and id are ranked in any order; a long text is read in pieces that overlap by two words; an empty documents table gives no rows, an
empty target leaves all its counts 0; extra columns are ignored and may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_batches, documents, slices
from chatloom.operators.windows import global_rank
from chatloom.session import staged

#: Longest run of words, buckets, and documents drawn of every hundred that have enough words.
DEPTH, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Words of a trie, and bytes of text cut into words at once.
TRIE_WORDS, PIECE_BYTES = 1 << 19, 1 << 22
#: ASCII letters lower-cased, digits and all bytes of longer characters are of words, the rest parts them.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_pieces(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(text number, words that were there before, words): long texts in pieces that begin with the last words of the piece before."""
    for k, text in enumerate(texts):
        flat, at, before = text.encode().translate(_WORDS), 0, []
        while at < len(flat):
            stop = len(flat) if len(flat) - at <= PIECE_BYTES else flat.find(b" ", at + PIECE_BYTES)
            stop = len(flat) if stop < 0 else stop
            words = before + flat[at:stop].split()
            yield k, len(before), words
            before, at = words[1 - DEPTH :], stop


class Trie:
    """The trie of some pieces. Nodes of a depth are numbered; a word's node at each depth is that of the run that begins with it."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]]):
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        word = np.fromiter((number[w] for _, _, words in pieces for w in words), np.int64, sum(len(x[2]) for x in pieces))
        size = np.array([len(x[2]) for x in pieces], np.int64)
        piece, start = np.repeat(np.arange(len(pieces)), size), np.cumsum(size) - size
        place = np.arange(len(word)) - start[piece]
        old, text = np.array([x[1] for x in pieces], np.int64)[piece], np.array([x[0] for x in pieces], np.int64)[piece]
        following = [b" " + w for w in number]
        #: For each depth: text number of every run, its node, and the count and CRC state of every node.
        self.depths: list[tuple[np.ndarray, ...]] = []
        at, node, state = np.arange(len(word)), word, np.fromiter(map(zlib.crc32, number), np.int64, len(number))
        for depth in range(1, DEPTH + 1):
            if depth > 1:
                fits = place[at] + depth <= size[piece[at]]
                at = at[fits]
                paths, node = np.unique(node[fits] * len(number) + word[at + depth - 1], return_inverse=True)
                parent, last = np.divmod(paths, max(1, len(number)))
                state = np.fromiter(map(zlib.crc32, map(following.__getitem__, last.tolist()), state[parent].tolist()), np.int64, len(paths))
            new = place[at] + depth > old[at]
            self.depths.append((text[at[new]], node[new], np.bincount(node[new], minlength=len(state)), state))

    def totals(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(state % buckets, weights=n, minlength=buckets) for _, _, n, state in self.depths).astype(np.int64)

    def weights(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: summed gains, features, words."""
        weight = sum(np.bincount(text, weights=gains[state % len(gains)][node], minlength=texts) for text, node, _, state in self.depths)
        each = [np.bincount(text, minlength=texts) for text, *_ in self.depths]
        return weight.astype(np.int64), sum(each), each[0]


def tries(texts: list[str]) -> Iterator[Trie]:
    """Tries of up to TRIE_WORDS words, and of the words of one more piece."""
    held, size = [], 0
    for piece in word_pieces(texts):
        held.append(piece)
        size += len(piece[2])
        if size >= TRIE_WORDS:
            yield Trie(held)
            held, size = [], 0
    if held:
        yield Trie(held)


def bucket_totals(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row a bucket; the driver takes `buckets` numbers."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text", PIECE_BYTES):
                for trie in tries(texts):
                    total += trie.totals(buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = rows.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over its share in the raw texts, both smoothed by one."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row; nothing is shuffled."""
    bounded_batches(rows.sparkSession)
    gains = gains.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", PIECE_BYTES):
                found = np.zeros((3, len(texts)), np.int64)
                for trie in tries(texts):
                    found += np.stack(trie.weights(gains, len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[k], pa.int64()) for k in (1, 2, 0))], names=["doc_id", "n_features", "n_words", "weight"])

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds score and rank: a Gumbel draw of percent of the rows with enough words, null rank for the others."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    scored = staged(weights.withColumn("score", (F.col("weight") + noise).cast("long")))
    enough = scored.filter(F.col("n_words") >= least_words)
    most = enough.count() * percent // 100
    order = enough.withColumns({"_down": -F.col("score"), "_null": F.col("doc_id").isNull()})
    ranked = global_rank(order, ["_down", "_null", "doc_id"], "_place").withColumn("rank", F.when(F.col("_place") < most, F.col("_place") + 1).cast("long"))
    columns = [*scored.columns, "rank"]
    return ranked.select(columns).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(columns))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank), one row for every row of docs."""
    gains = bucket_gains(bucket_totals(docs, text, buckets), bucket_totals(target, target_text, buckets))
    return drawn(weighed(docs, gains, key, text), percent, least_words, seed)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
