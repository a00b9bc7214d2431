"""The inverted index against plain BM25, kept over batches, and fed by a stream of closed chunks."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import evaluate, inverted
from chatloom.streaming import conversations


def _plain(docs, asks, k, scorer=inverted.PLAIN):
    """docs: (channel, key, text); asks: (query, channel, text)."""
    out = []
    by = defaultdict(list)
    for channel, key, text in docs:
        by[channel].append((key, Counter(scorer.terms((text or "").lower()))))
    for query, channel, text in asks:
        own = by[channel]
        if not own:
            continue
        average = sum(sum(c.values()) for _, c in own) / len(own)
        score = Counter()
        for term in set(scorer.terms((text or "").lower())):
            df = sum(term in c for _, c in own)
            for key, c in own:
                if term in c:
                    score[key] += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * c[term] * scorer.factor / (c[term] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average))
        found = sorted(((-round(s, 6), key) for key, s in score.items()))[:k]
        out += [(query, channel, key, -s, n + 1) for n, (s, key) in enumerate(found) if s]
    return sorted(out)


def _texts(r, n, words=40):
    pool = [f"w{k}" for k in range(30)] + ["The", "a1", "É", "of"]
    return [" ".join(r.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=r.randrange(words))) for _ in range(n)]


def _rows(df):
    return sorted((r["query"], r["channel"], r["key"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("scorer", [inverted.PLAIN, inverted.LIBRARY])
def test_best_by_channel_equals_plain_bm25(spark, scorer):
    r = random.Random(2)
    docs = [(r.choice(["x", "y", "z", ""]), k, t) for k, t in enumerate(_texts(r, 300) + _texts(r, 1, 4) * 9 + [None, ""])]
    asks = [(k, r.choice(["x", "y", "", "none"]), t) for k, t in enumerate(_texts(r, 20, 6) + [None, "zzz"])]
    table = spark.createDataFrame([(c or None, k, t) for c, k, t in docs], "c string, key long, text string").repartition(3)
    queries = spark.createDataFrame([(k, c or None, t) for k, c, t in asks], "query long, channel string, text string")
    want = _plain(docs, asks, 7, scorer)
    assert _rows(inverted.best(table, queries, "key", "text", "query", "text", 7, "c", "channel", scorer)) == want
    rows = inverted.segments(table, "c", "key", "text", None, scorer)
    assert _rows(inverted.search(inverted.query_terms(queries, "query", "channel", "text", scorer), rows, *inverted.statistics(rows), 7, None, scorer, most_terms=13)) == want


def test_pruned_lists_give_the_exact_top():
    r = np.random.default_rng(4)
    n, average = 3000, 40.0
    lens = r.integers(1, 120, n)
    for trial in range(30):
        lists = inverted._Lists(np.arange(n)[::-1].copy(), lens, average, [n - 1, 5], 2.5)
        want = np.zeros(n)
        for t in range(8):
            at = np.flatnonzero(r.random(n) < r.choice([0.002, 0.05, 0.6]))
            if not len(at):
                continue
            tf = r.integers(1, 9, len(at))
            block = np.unique(at // inverted.SPAN)
            most, least = (np.array([f(x[at // inverted.SPAN == b]) for b in block]) for f, x in ((np.max, tf), (np.min, lens[at])))
            weight = math.log(1 + (n - len(at) + 0.5) / (len(at) + 0.5))
            lists.add(str(t), weight, at, tf, block, most, least)
            want[at] += weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[at] / average))
        want[[0, n - 1 - 5]] = 0
        k = int(r.choice([1, 10, 100]))
        at, score = lists.top([str(t) for t in range(8)], k)
        order = np.lexsort((lists.keys, -np.round(want, 6)))[:k]
        order = order[want[order] > 0]
        assert at[score > 0].tolist() == order.tolist() and np.allclose(score[score > 0], want[order], atol=2e-6)


def test_an_index_kept_in_batches(spark, tmp_path):
    r, folder = random.Random(6), str(tmp_path / "index")
    docs = [(r.choice("xy"), k, t) for k, t in enumerate(_texts(r, 120))]
    asks = [(k, r.choice("xy"), t) for k, t in enumerate(_texts(r, 10, 6))]
    frame = lambda rows: spark.createDataFrame(rows, "channel string, key long, text string")
    queries = spark.createDataFrame(asks, "query long, channel string, text string")

    def found():
        rows, df, totals, removed = inverted.kept(spark, folder)
        return _rows(inverted.search(inverted.query_terms(queries, "query", "channel", "text"), rows, df, totals, 5, removed))

    for batch in range(3):
        inverted.add(frame(docs[batch * 40 : batch * 40 + 40]), batch, folder, "channel", "key", "text")
        inverted.add(frame(docs[:99]), batch, folder, "channel", "key", "text")  # the same batch again changes nothing
        assert found() == _plain(docs[: batch * 40 + 40], asks, 5)
    inverted.remove(frame(docs[10:50]), 3, folder, "channel", "key", "text")
    assert found() == _plain(docs[:10] + docs[50:], asks, 5)
    inverted.segments(frame(docs), "channel", "key", "text").write.parquet(f"{folder}/rows/batch=4")  # broke off before its commit
    assert found() == _plain(docs[:10] + docs[50:], asks, 5)


def test_closed_chunks_enter_the_index_as_the_stream_closes_them(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", conversations.ROCKS)
    r, folder, source = random.Random(8), str(tmp_path / "index"), str(tmp_path / "in")
    schema = "channel_id string, ordinal long, text string"
    every = []
    for part in range(3):
        rows = [(c, part * 10 + k, " ".join(_texts(r, 1, 12))) for c in "ab" for k in range(10)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        closed = conversations.chunk_stream(conversations.messages(spark, source, schema), most_messages=4, most_tokens=30, closed_only=True)
        conversations.index_closed(closed, lambda: spark.read.schema(schema).parquet(source), folder, str(tmp_path / "state")).awaitTermination()
        docs = []
        for c in "ab":
            state, texts = (0, 0, 0), defaultdict(list)
            for _, _, text in sorted(x for x in every if x[0] == c):
                state = conversations.place(state, len(re.findall(r"\S+", text)), 4, 30)
                texts[state[0]].append(text)
            docs += [(c, k, "\n".join(own)) for k, own in texts.items() if k != state[0]]
        asks = [(k, "ab"[k % 2], t) for k, t in enumerate(_texts(r, 6, 6))]
        queries = spark.createDataFrame(asks, "query long, channel string, text string")
        index = inverted.kept(spark, folder)
        assert _rows(inverted.search(inverted.query_terms(queries, "query", "channel", "text"), *index[:3], 5, index[3])) == _plain(docs, asks, 5)
    assert docs


def test_the_gate_rewrites_and_asks_again(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red apple tree house", "blue lake water house", "green field grass barn", "purchased a collar for the cat", "bought a bowl for the cat"])], "doc_id long, text string")
    gold = spark.createDataFrame([(0, "red apple", "s", [0]), (1, "blue lake", "s", [1]), (2, "green barn", "s", [0]), (3, "who purchased a collar", "t", [3]), (4, "purchased", "t", [3]), (5, None, None, None)], "q long, text string, stratum string, evidence array<long>")
    rules = [(r"\bpurchased\b", "bought"), (r"\bgrass\b", "lawn")]
    got = {r["q"]: (r["outcome"], r["initial_hit"], r["final_hit"], r["released"]) for r in evaluate.anti_leak_gate(docs, gold, "doc_id", "text", "q", "text", rules).collect()}
    assert got == {0: ("control_group", True, True, "red apple"), 1: ("unrewritable", True, True, "blue lake"), 2: ("clean", False, False, "green barn"), 3: ("unrewritable", True, True, "who purchased a collar"), 4: ("rewritten", True, False, "bought"), 5: ("clean", False, False, None)}
    report = {r["stratum"]: r for r in evaluate.gate_report(evaluate.anti_leak_gate(docs, gold.filter("q < 5"), "doc_id", "text", "q", "text", rules)).collect()}
    assert (report["all"]["n"], report["all"]["hits"], report["all"]["released_hits"], report["all"]["passes"]) == (5, 4, 3, False)
    assert (report["s"]["control_rate"], report["s"]["gated_rate"]) == (1.0, 0.5) and report["t"]["rewritten"] == 1


def test_containing_finds_whole_items_only(spark):
    docs = spark.createDataFrame([(1, "x one two  three\nfour five six y"), (2, "one two three four five"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two  three\nfour five six"), (2, "ne two three for five"), (3, None), (4, "one two"), (5, "two three four nine ten")], "item long, text string")
    got = evaluate.containing(docs, items, "doc_id", "text", "item", "text").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1)]
