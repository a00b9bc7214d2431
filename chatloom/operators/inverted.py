"""BM25 by channel over a kept inverted index: posting blocks with bounds, document frequencies as signed deltas.

A segment is what one task has read of one channel, SEGMENT documents and about HELD postings at most. Its postings are rows
(channel, segment, term, block) with gap-coded places of documents and term frequencies; a block spans SPAN
places and carries its largest frequency and least length, from which the bound of its scores follows
for any statistics of the channel. A search sends every block of a wanted term once to its segment, where all
queries of the channel are answered: frequent terms are looked at only for documents, and in blocks, that could
still reach the top, and k rows a query and segment leave the task. No (query, document) pair leaves it otherwise.

Defined cases: null texts are empty documents and count in the statistics; a null channel is the empty
one; query terms are a set; ties go to the smaller key; documents that share no term are left out; a key may be indexed once a
channel, and a removed key is not indexed again.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators.lexical import B, K1
from chatloom.session import exists, staged

SEGMENT, SPAN = 1 << 12, 128
#: Postings that a task holds of its open segments, and rows of documents that it turns into words at once.
HELD, READ = 1 << 20, 256
#: Blocks of an Arrow batch.
ROWS = 1 << 14
#: Terms of queries that are broadcast at once; more are answered in further passes.
QUERY_TERMS = 1 << 20
# The usual English stop words of search libraries.
STOP_WORDS = """a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with""".split()


class Scorer(NamedTuple):
    """What counts as a term of a lower-cased text, and what a term's weight is multiplied by."""

    pattern: str = "[a-z0-9]+"
    stop: frozenset = frozenset()
    factor: float = K1 + 1

    def terms(self, text: str) -> list[str]:
        found = re.findall(self.pattern, text)
        return [x for x in found if x not in self.stop] if self.stop else found


PLAIN = Scorer()
#: The defaults of common BM25 libraries: words of two characters or more without stop words, no factor.
LIBRARY = Scorer(r"\b\w\w+\b", frozenset(STOP_WORDS), 1.0)
_ROW = "channel string, segment long, term string, block int, gaps array<int>, tfs array<int>, most_tf int, least_len int, keys array<long>, lens array<int>"
_FIELDS = pa.schema([("channel", pa.string()), ("segment", pa.int64()), ("term", pa.string()), ("block", pa.int32()), ("gaps", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("most_tf", pa.int32()), ("least_len", pa.int32()), ("keys", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32()))])


class _Segment:
    """Documents of one channel in the order of reading, and their postings as flat lists."""

    def __init__(self):
        self.keys, self.lens = [], []
        self.terms, self.places, self.tfs = array("i"), array("i"), array("i")
        self.number: defaultdict[str, int] = defaultdict(count().__next__)

    def add(self, key: int, words: list[str], only: frozenset | None) -> int:
        """How many postings it has added."""
        found = Counter(words if only is None else filter(only.__contains__, words))
        self.terms.extend(map(self.number.__getitem__, found))
        self.tfs.extend(found.values())
        self.places.extend(repeat(len(self.keys), len(found)))
        self.keys.append(key)
        self.lens.append(len(words))
        return len(found)

    def rows(self, channel: str, segment: int) -> Iterator[pa.RecordBatch]:
        """The segment's documents, under the empty term, then its blocks."""
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        none = lambda n, kind: pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], kind))
        zero = pa.array([0], pa.int32())
        yield _batch(channel, segment, [""], zero, none(1, pa.int32()), none(1, pa.int32()), zero, zero, whole(self.keys, pa.int64()), whole(self.lens, pa.int32()))
        term, place, tf = (np.array(x, np.int32) for x in (self.terms, self.places, self.tfs))
        order = np.argsort(term, kind="stable")
        term, place, tf = term[order], place[order], tf[order]
        block, names = place // SPAN, np.array(list(self.number), object)
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        gaps = np.diff(place, prepend=0)
        gaps[first] = place[first] % SPAN
        for at in range(0, len(first), ROWS):
            own = first[at : at + ROWS]
            stop = first[at + ROWS] if at + ROWS < len(first) else len(term)
            offsets, part = pa.array(np.append(own, stop) - own[0], pa.int32()), slice(own[0], stop)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part], pa.int32())) for x in (gaps, tf)]
            most, least = np.maximum.reduceat(tf[part], own - own[0]), np.minimum.reduceat(np.array(self.lens, np.int32)[place[part]], own - own[0])
            yield _batch(channel, segment, names[term[own]].tolist(), block[own], *lists, most, least, none(len(own), pa.int64()), none(len(own), pa.int32()))


def _batch(channel: str, segment: int, term: list[str], *columns) -> pa.RecordBatch:
    n = len(term)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip(([channel] * n, [segment] * n, term, *columns), _FIELDS, strict=True)], schema=_FIELDS)


def _channel(name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def segments(docs: DataFrame, channel: str | None, key: str, text: str, only: frozenset | None = None, scorer: Scorer = PLAIN) -> DataFrame:
    """The index rows of the documents; with `only`, of these terms alone. Nothing is shuffled."""

    def sent(held: dict[str, _Segment], n: int) -> Iterator[pa.RecordBatch]:
        for k, (name, segment) in enumerate(held.items()):
            yield from segment.rows(name, TaskContext.get().partitionId() << 32 | n + k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, _Segment] = defaultdict(_Segment)
        rows = n = postings = 0
        for part in (batch.slice(at, READ) for batch in batches for at in range(0, batch.num_rows, READ)):
            for name, k, words in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                postings += held[name].add(k, scorer.terms(words or ""), only)
                rows += 1
                if rows == SEGMENT or postings >= HELD:
                    yield from sent(held, n)
                    rows, postings, n = 0, 0, n + len(held)
                    held.clear()
        yield from sent(held, n)

    return docs.select(_channel(channel).alias("c"), F.col(key).cast("long").alias("k"), F.lower(F.col(text)).alias("t")).mapInArrow(run, _ROW)


def statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel, term, df) and (channel, n_docs, words) of index rows."""
    df = rows.filter("term <> ''").groupBy("channel", "term").agg(F.sum(F.size("tfs")).alias("df"))
    totals = rows.filter("term = ''").groupBy("channel").agg(F.sum(F.size("keys")).alias("n_docs"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"))
    return df, totals


# --- the kept index ----------------------------------------------------------------------------------


def add(docs: DataFrame, batch: int, folder: str, channel: str | None, key: str, text: str, scorer: Scorer = PLAIN) -> None:
    """Index one batch, as from foreachBatch. A batch that is repeated replaces itself; one that broke off is not seen."""
    spark = docs.sparkSession
    if exists(spark, f"{folder}/committed/batch={batch}/_SUCCESS"):
        return
    at = f"{folder}/rows/batch={batch}"
    segments(docs, channel, key, text, None, scorer).write.mode("overwrite").parquet(at)
    _changes(spark.read.schema(_ROW).parquet(at), 1, batch, folder)


def remove(docs: DataFrame, batch: int, folder: str, channel: str | None, key: str, text: str, scorer: Scorer = PLAIN) -> None:
    """Take documents out again, given as they were added: statistics fall by theirs, their keys are barred."""
    spark = docs.sparkSession
    if exists(spark, f"{folder}/committed/batch={batch}/_SUCCESS"):
        return
    docs.select(_channel(channel).alias("channel"), F.col(key).cast("long").alias("key")).write.mode("overwrite").parquet(f"{folder}/removed/batch={batch}")
    _changes(staged(segments(docs, channel, key, text, None, scorer)), -1, batch, folder)


def _changes(rows: DataFrame, sign: int, batch: int, folder: str) -> None:
    df, totals = statistics(rows)
    df.withColumn("df", F.col("df") * sign).write.mode("overwrite").parquet(f"{folder}/df/batch={batch}")
    totals.withColumns({c: F.col(c) * sign for c in ("n_docs", "words")}).write.mode("overwrite").parquet(f"{folder}/totals/batch={batch}")
    rows.sparkSession.range(1).select(F.lit(batch).cast("long").alias("id")).write.mode("overwrite").parquet(f"{folder}/committed/batch={batch}")


def kept(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, df, totals, removed) of the committed batches, deltas summed up."""
    done = spark.read.schema("id long, batch long").parquet(f"{folder}/committed").select("batch")

    def read(name: str, schema: str) -> DataFrame:
        if not exists(spark, f"{folder}/{name}"):
            return spark.createDataFrame([], f"{schema}, batch long")
        return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}").join(done, "batch", "left_semi")

    rows = read("rows", _ROW).withColumn("segment", F.xxhash64("batch", "segment")).drop("batch")
    df = read("df", "channel string, term string, df long").groupBy("channel", "term").agg(F.sum("df").alias("df"))
    totals = read("totals", "channel string, n_docs long, words long").groupBy("channel").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
    return rows, df, totals, read("removed", "channel string, key long").select("channel", "key")


# --- search ------------------------------------------------------------------------------------------


class _Lists:
    """The posting lists of a segment with scores and, for spans of places, the bounds of their scores."""

    def __init__(self, keys: np.ndarray, lens: np.ndarray, average: float, barred: list[int], factor: float):
        self.keys, self.free, self.average, self.factor = keys, ~np.isin(keys, barred), average, factor
        self.norm = K1 * (1 - B + B * lens / average)
        self.found: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, term: str, weight: float, at: np.ndarray, tf: np.ndarray, block: np.ndarray, most_tf: np.ndarray, least_len: np.ndarray) -> None:
        bound = np.zeros(-(-len(self.keys) // SPAN))
        bound[block] = weight * most_tf * self.factor / (most_tf + K1 * (1 - B + B * least_len / self.average))
        self.found[term] = at, weight * tf * self.factor / (tf + self.norm[at]), bound

    def top(self, wanted: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, rounded to 6 digits, of the k best; exact, ties to the smaller key.

        The rarest lists are added up whole. Once all others together could not lift an unseen document to the k-th best score so far, only
        documents seen by then count, and of them those whose bounds, block by block, still reach it.
        """
        lists = sorted((self.found[t] for t in wanted if t in self.found), key=lambda x: -x[2].max())
        score, seen = np.zeros(len(self.keys)), np.zeros(len(self.keys), bool)
        rest = np.cumsum([x[2].max() for x in lists][::-1])[::-1]
        reached, whole = 0.0, 0
        # Scores are compared after rounding, so a bound counts as reached from a little below.
        kth = lambda found: np.partition(found, -k)[-k] - 2e-6 if len(found) >= k else 0.0
        while whole < len(lists) and reached <= rest[whole]:
            at, part, _ = lists[whole]
            score[at] += part
            seen[at] = True
            whole += 1
            reached = kth(score[seen & self.free])
        live = np.flatnonzero(seen & self.free)
        for j in range(whole, len(lists)):
            live = live[score[live] + sum(x[2][live // SPAN] for x in lists[j:]) >= reached]
            at, part, _ = lists[j]
            place = np.minimum(np.searchsorted(at, live), len(at) - 1)
            hit = at[place] == live
            score[live[hit]] += part[place[hit]]
            reached = max(reached, kth(score[live]))
        value = np.round(score[live], 6)
        first = np.lexsort((self.keys[live], -value))[:k]
        return live[first], value[first]


def _answers(sent, k: int, factor: float):
    """One segment: its blocks of all wanted terms against all queries of its channel."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked, weights, averages = sent.value
        channel, out = key[0].as_py(), []
        documents = group.filter(pa.compute.equal(group.column("term"), ""))
        if documents.num_rows and channel in asked:
            keys, lens = (np.asarray(documents.column(c)[0].values, np.int64) for c in ("keys", "lens"))
            barred = documents.column("barred")[0].as_py() if "barred" in documents.column_names else None
            lists = _Lists(keys, lens, averages[channel], barred or [], factor)
            rows = group.filter(pa.compute.not_equal(group.column("term"), "")).select(["term", "block", "gaps", "tfs", "most_tf", "least_len"]).sort_by([("term", "ascending"), ("block", "ascending")])
            term = np.array(rows.column("term").to_pylist(), object)
            block, most, least = (np.asarray(rows.column(c), np.int64) for c in ("block", "most_tf", "least_len"))
            gaps, tfs = (np.asarray(pa.compute.list_flatten(rows.column(c)), np.int64) for c in ("gaps", "tfs"))
            size = np.asarray(pa.compute.list_value_length(rows.column("gaps")), np.int64)
            start = np.cumsum(size) - size
            run_on = np.cumsum(gaps)
            at = run_on + np.repeat(block * SPAN - (run_on[start] - gaps[start]), size)
            cut = [0, *(np.flatnonzero(term[1:] != term[:-1]) + 1).tolist(), len(term)] if len(term) else []
            for a, b in pairwise(cut):
                if (weight := weights.get((channel, term[a]))) is not None:
                    own = slice(start[a], start[b - 1] + size[b - 1])
                    lists.add(term[a], weight, at[own], tfs[own], block[a:b], most[a:b], least[a:b])
            for query, wanted in asked[channel].items():
                at, score = lists.top(wanted, k)
                out += [(query, channel, *x) for x in zip(keys[at].tolist(), score.tolist(), strict=True)]
        names = ("query", pa.int64()), ("channel", pa.string()), ("key", pa.int64()), ("score", pa.float64())
        return pa.table({name: pa.array([x[j] for x in out], kind) for j, (name, kind) in enumerate(names)})

    return run


def query_terms(queries: DataFrame, query: str, channel: str | None, text: str, scorer: Scorer = PLAIN) -> DataFrame:
    """(query, channel, term), terms once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, name, term) for k, name, words in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for term in dict.fromkeys(scorer.terms(words or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["query", "channel", "term"])

    return queries.select(F.col(query).cast("long").alias("query"), _channel(channel).alias("channel"), F.lower(F.col(text)).alias("text")).mapInArrow(run, "query long, channel string, term string")


def search(asked: DataFrame, rows: DataFrame, df: DataFrame, totals: DataFrame, k: int, removed: DataFrame | None = None, scorer: Scorer = PLAIN, most_terms: int = QUERY_TERMS) -> DataFrame:
    """(query, channel, key, score, rank): the k best documents of the query's channel.

    Queries are dealt into blocks of about most_terms terms; the terms, weights and mean lengths of one block are broadcast.
    """
    spark, out = rows.sparkSession, None
    asked = staged(asked)
    n = max(1, -(-asked.count() // most_terms))
    if removed is not None:
        bars = rows.filter("term = ''").select("channel", "segment", F.explode("keys").alias("key")).join(removed, ["channel", "key"], "left_semi")
        bars = bars.groupBy("channel", "segment").agg(F.collect_list("key").alias("barred")).withColumn("term", F.lit(""))
        rows = rows.join(bars, ["channel", "segment", "term"], "left")
    for b in range(n):
        own = asked.filter(F.pmod(F.xxhash64("query", "channel"), F.lit(n)) == b)
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = own.join(df, ["channel", "term"]).join(totals, "channel").filter("df > 0")
        got = known.select("query", "channel", "term", idf.alias("weight"), (F.col("words") / F.col("n_docs")).alias("average")).toArrow().to_pylist()
        by: defaultdict[str, defaultdict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
        for x in got:
            by[x["channel"]][x["query"]].append(x["term"])
        sent = spark.sparkContext.broadcast(({c: dict(q) for c, q in by.items()}, {(x["channel"], x["term"]): x["weight"] for x in got}, {x["channel"]: x["average"] for x in got}))
        wanted = F.broadcast(own.select("channel", "term").union(own.select("channel", F.lit(""))).distinct())  # most_terms rows, and one a channel among them
        blocks = rows.join(wanted, ["channel", "term"], "left_semi")
        found = blocks.groupBy("channel", "segment").applyInArrow(_answers(sent, k, scorer.factor), "query long, channel string, key long, score double")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query", "channel").orderBy(F.desc("score"), "key"))
    return out.filter("score > 0").withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def best(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, k: int, channel: str | None = None, query_channel: str | None = None, scorer: Scorer = PLAIN) -> DataFrame:
    """(query, channel, key, score, rank) without a kept index: one pass over the documents takes the postings of the terms asked for."""
    asked = staged(query_terms(queries, query, query_channel, query_text, scorer))
    words = asked.select("term").distinct().limit(QUERY_TERMS + 1).toArrow().column(0).to_pylist()
    only = frozenset(words) if len(words) <= QUERY_TERMS else None
    rows = staged(segments(docs, channel, key, text, only, scorer))
    return search(asked, rows, *statistics(rows), k, None, scorer)
