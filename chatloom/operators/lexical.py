"""BM25 ranking, rank fusion and hit measures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The usual constants of BM25 and the weights of the fused lists.
K1, B = 1.5, 0.75
RRF_WEIGHTS = {"rewrite": 1.3, "keyword": 1.0, "original": 0.5}
RRF_CONSTANT = 60


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def bm25_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Number of documents, mean length, distinct terms and postings."""
    one = docs.select(F.size(terms(F.col(text))).alias("dl"), F.size(F.array_distinct(terms(F.col(text)))).alias("kinds")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"), F.sum("kinds").cast("long").alias("n_postings"))
    kinds = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.lit(1).alias("x")).agg(F.count("*").alias("n_terms"))
    return one.crossJoin(kinds)  # one row each


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, key, score) of every pair that shares a term. Query terms are a set.

    Only postings of query terms are kept, so the join sees no other words of the corpus.
    """
    asked = queries.select(query, F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    words = docs.select(key, terms(F.col(text)).alias("_terms")).select(key, F.size("_terms").alias("dl"), F.explode("_terms").alias("term"))
    whole = docs.select(F.coalesce(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")), F.lit(0)).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"))
    postings = words.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_len")))
    rated = postings.join(df, "term").crossJoin(F.broadcast(whole)).select(key, "term", part.alias("part"))  # whole is one row
    return asked.join(rated, "term").groupBy(query, key).agg(F.round(F.sum("part"), 6).alias("score"))


def top_k(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """1-based ranks up to k; ties go to the smaller key, scores of zero are left out."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def rrf(lists: DataFrame, query: str, key: str, constant: int = RRF_CONSTANT, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (list, query, key, rank)."""
    w = F.create_map(*(F.lit(x) for kv in (weights or RRF_WEIGHTS).items() for x in kv))
    fused = lists.groupBy(query, key).agg(F.round(F.sum(F.element_at(w, F.col("list")) / (constant + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)).cast("long"))


def minmax_fusion(scores: DataFrame, query: str, key: str, weights: dict[str, float]) -> DataFrame:
    """(query, key, score, rank): columns of scores brought to 0..1 in each query and added up with weights; a column of equal scores gives 0, a missing score 0."""
    w = Window.partitionBy(query)

    def unit(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.when(high > low, (F.col(c) - low) / (high - low)), F.lit(0.0))

    fused = scores.select(query, key, F.round(sum(F.lit(x) * unit(c) for c, x in weights.items()), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)).cast("long"))


def raw_at_k(ranked: DataFrame, query: str, is_gold: Column, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).groupBy(query).agg(F.max(is_gold.cast("int")).cast("long").alias("hit"))


def distinct_at_k(ranked: DataFrame, query: str, session: str, gold: str, k: int) -> DataFrame:
    """Hit if gold's first rank is no later than where the k-th distinct session appears."""
    first = ranked.groupBy(query, session).agg(F.min("rank").alias("first_rank"), F.max(F.col(gold).cast("int")).alias("is_gold"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("first_rank", session))
    return first.withColumn("_k", place).groupBy(query).agg(F.coalesce(F.max(F.when((F.col("is_gold") == 1) & (F.col("_k") <= k), 1)), F.lit(0)).cast("long").alias("hit"))


def token_overlap(queries: DataFrame, docs: DataFrame, query: str, answer: str, question: str, key: str, text: str, coverage: float = 0.75, most_queries: int = 4096) -> DataFrame:
    """Grounding of an answer in a text: 6 * shared answer terms + 2 * shared question terms, for texts that cover enough of the answer.

    Queries go to every task in blocks of most_queries, as lists by term; a task adds up what a text's terms list and sends only the pairs
    that cover enough. Answers without a term have no coverage.
    """
    asked = queries.select(F.col(query).cast("long").alias("q"), F.array_distinct(terms(F.col(answer))).alias("a"), F.array_distinct(terms(F.col(question))).alias("b"))
    rows, out = docs.select(F.col(key).cast("long").alias("k"), F.lower(F.col(text)).alias("t")), None
    n = max(1, -(-asked.count() // most_queries))
    for block in range(n):
        got = asked.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == block).toArrow().to_pylist()  # most_queries rows or so
        lists: dict[str, list[tuple[int, int]]] = {}
        for j, row in enumerate(got):
            for term in {*row["a"], *row["b"]}:
                lists.setdefault(term, []).append((j, (term in row["a"]) + (term in row["b"]) * 1_000_000))
        index = {term: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for term, own in lists.items()}
        sent = docs.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in got], np.int64), np.array([len(r["a"]) for r in got], np.int64), index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, size, index = sent.value
            for batch in batches:
                found: list[np.ndarray] = []
                for k, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = [index[t] for t in set(re.findall("[a-z0-9]+", words or "")) if t in index]
                    if own:
                        sums = np.bincount(np.concatenate([x[0] for x in own]), weights=np.concatenate([x[1] for x in own]), minlength=len(names)).astype(np.int64)
                        in_a, in_b = sums % 1_000_000, sums // 1_000_000
                        at = np.flatnonzero((size > 0) & (np.round(in_a / np.maximum(size, 1), 6) >= coverage))
                        found.append(np.stack([names[at], np.full(len(at), k), in_a[at], size[at], 6 * in_a[at] + 2 * in_b[at]]))
                table = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(table[0]), pa.array(table[1]), pa.array(np.round(table[2] / np.maximum(table[3], 1), 6)), pa.array(table[4])], names=["q", "k", "coverage", "score"])

        part = rows.filter("k is not null").mapInArrow(run, "q long, k long, coverage double, score long")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("q").alias(query), F.col("k").alias(key), "coverage", "score")


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many terms of a text are among the keywords, repeats counted."""
    return F.size(F.filter(terms(text), lambda x: x.isin(*keywords))).cast("long")
