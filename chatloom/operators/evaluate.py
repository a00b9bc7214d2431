"""Splits, leak gates, trace metrics and retrieval measures."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import substituted
from chatloom.operators import inverted
from chatloom.operators.graph import connected_components
from chatloom.operators.lexical import bm25_scores, top_k
from chatloom.operators.windows import global_rank, global_running
from chatloom.session import staged


#: Failed states of a split search that are kept at most.
REMEMBERED = 1 << 20
#: A word boundary of ASCII words, as in the SQL; that of the JVM depends on its version.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def hit_rates(top1: DataFrame, gold: DataFrame, query: str, key: str, stratum: str) -> DataFrame:
    """Top-1 hits by stratum: (stratum, n, hits, hit_rate). gold: (query, stratum, evidence array)."""
    found = gold.join(top1.filter("rank = 1").select(query, key), query, "left")
    hit = F.coalesce(F.array_contains("evidence", F.col(key)), F.lit(False))
    return found.groupBy(stratum).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"))


def leaks(docs: DataFrame, gold: DataFrame, key: str, text: str, query: str, query_text: str) -> DataFrame:
    """Queries whose best BM25 hit is in their own evidence: (query, key)."""
    best = top_k(bm25_scores(docs, gold, key, text, query, query_text), query, key, 1)
    return gold.join(best, query).filter(F.array_contains("evidence", F.col(key))).select(query, key)


def percentile_nearest(value: str, p: float) -> Column:
    """The value at position ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def truncating(p: float) -> Callable[[Column], Column]:
    """The 0-based place int(p * n - 1), no earlier than the first."""
    return lambda n: F.greatest(F.lit(0), (F.lit(p) * n - 1).cast("long"))


def positional(q: float) -> Callable[[Column], Column]:
    """The 0-based place int(n * q), no later than the last."""
    return lambda n: F.least(n - 1, (n * F.lit(q)).cast("long"))


def values_at(rows: DataFrame, group: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, a column for each place): the values at these places of each group's sorted values, nulls left out.

    Equal values are counted first and the counts summed up along one order of groups and values, in ranges; so no
    list of values is built and a large group is spread over many tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    running = global_running(counts, ["_g", "_v"], "_n", "_before")
    groups = running.groupBy("_g").agg(F.sum("_n").alias("_all"), F.min("_before").alias("_first"))
    both = running.join(groups.withColumnRenamed("_g", "_key"), F.col("_g").eqNullSafe(F.col("_key")))
    at = lambda place: place(F.col("_all")) + F.col("_first")
    found = both.groupBy("_g").agg(*(F.max(F.when((at(p) >= F.col("_before")) & (at(p) < F.col("_before") + F.col("_n")), F.col("_v"))).alias(name) for name, p in places.items()))
    return found.withColumnRenamed("_g", group)


def retrieval_metrics(retrieved: DataFrame, gold: DataFrame, query: str, key: str) -> DataFrame:
    """(query, n_retrieved, n_gold, recall, precision) from (query, key) rows; a rate without a denominator is null."""
    flag = lambda df, name: df.groupBy(query, key).agg(F.lit(1).alias(name))
    both = flag(retrieved, "_r").join(flag(gold, "_g"), [query, key], "full")
    counts = both.groupBy(query).agg(F.count("_r").alias("n_retrieved"), F.count("_g").alias("n_gold"), F.count_if(F.col("_r").isNotNull() & F.col("_g").isNotNull()).alias("_both"))
    rate = lambda n: F.round(F.try_divide("_both", n), 6)
    return counts.select(query, "n_retrieved", "n_gold", rate("n_gold").alias("recall"), rate("n_retrieved").alias("precision"))


def answer_metrics(rows: DataFrame, k: int = 5) -> DataFrame:
    """(metric, value, sample_size) over answered questions, each the mean over the questions that have what it needs.

    rows, one a question, arrays of ids: gold_media, answer_media, retrieved_media (in order), gold_evidence, context_ids, gold_bridges,
    bridges; and constraints, an array of booleans. exact_media_accuracy: the answer's media are the gold ones; media_recall_at_k and
    evidence_recall: the share of gold ids found; context_precision: the share of context that is gold evidence; bridge_recall; constraint_satisfaction: the share that hold.
    """
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    share = lambda own, found, of: F.when(some(of), F.size(F.array_intersect(own, F.coalesce(found, F.array()))) / F.size(F.array_distinct(F.col(of))))
    col = F.col
    held = F.filter("constraints", lambda x: F.coalesce(x, F.lit(False)))
    metrics = {
        "exact_media_accuracy": F.when(some("gold_media"), (F.array_sort(F.array_distinct("gold_media")) == F.array_sort(F.array_distinct(F.coalesce(col("answer_media"), F.array())))).cast("double")),
        "media_recall_at_k": share(col("gold_media"), F.slice("retrieved_media", 1, k), "gold_media"),
        "evidence_recall": share(col("gold_evidence"), col("context_ids"), "gold_evidence"),
        "context_precision": share(col("context_ids"), col("gold_evidence"), "context_ids"),
        "bridge_recall": share(col("gold_bridges"), col("bridges"), "gold_bridges"),
        "constraint_satisfaction": F.when(some("constraints"), F.size(held) / F.size("constraints")),
    }
    one = rows.select(*(v.alias(m) for m, v in metrics.items())).agg(*(F.struct(F.round(F.avg(m), 6).alias("value"), F.count(m).alias("n")).alias(m) for m in metrics))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.value").alias("value"), F.col(f"{m}.n").alias("sample_size")) for m in metrics))
    return one.select(F.explode(each).alias("x")).select("x.*")


#: Where a question can be lost, in order.
FAILURES = ("retrieval_miss", "selection_miss", "expansion_miss", "context_miss", "reasoning_miss")


def failure_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """(stage, n) of every stage, 0 where nothing was lost: the first of the five flags (found, kept, reached, with its evidence, answered) that does not hold."""
    lost = rows.select(failure_stage(list(zip(flags, FAILURES, strict=True))).alias("stage")).filter("stage is not null").groupBy("stage").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(x,) for x in FAILURES], "stage string")
    return every.join(lost, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def normalised_answer(text: Column) -> Column:
    """An answer without case, punctuation and articles, for the exact pass before any judge."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " "), r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def trace_metrics(trace: DataFrame) -> DataFrame:
    """(metric, value, sample_size), value null where the denominator is 0.

    trace: record_type, query_id, event_id, action, outcome, role, supporting, used, gained, anchors (arrays), result_event_id, latency_ms, cost_usd.
    """
    jumps = trace.filter("record_type = 'round' and action = 'jump' and outcome = 'executed'")
    finals = trace.filter("record_type = 'query_completed'").select("query_id", F.col("result_event_id").alias("_final"))
    results = trace.filter("record_type = 'result'").select(F.col("event_id").alias("_final"), "supporting")
    support = finals.join(results, "_final").select("query_id", F.explode("supporting").alias("event_id")).distinct().withColumn("_good", F.lit(True))
    rated = jumps.drop("supporting").join(support, ["query_id", "event_id"], "left").withColumn("_good", F.coalesce("_good", F.lit(False)))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    j = rated.agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.count_if(none("gained") & none("anchors")).alias("no_gain"))
    clues = rated.select(F.explode("used").alias("clue"), "_good").groupBy("clue").agg(F.max("_good").alias("good")).agg(F.count("*").alias("used"), F.count_if("good").alias("useful"))
    is_round, call = F.col("record_type") == "round", F.col("record_type") == "llm_call"
    done = F.col("record_type") == "query_completed"
    searches = is_round & F.col("action").isin("retrieve_lexical", "retrieve_dense", "retrieve_visual", "filter_metadata")
    vlm = F.coalesce(F.col("role") == "vlm_extract", F.lit(False))
    cost = F.when(call, F.col("cost_usd").cast("decimal(28,9)"))
    p = lambda cond, q: F.expr(f"percentile_disc({q}) within group (order by case when {cond} then latency_ms end)")
    t = trace.agg(
        F.count_if(done).alias("queries"), F.count_if(is_round).alias("rounds"), F.count_if(searches).alias("searches"), F.count_if(call & ~vlm).alias("llm"), F.count_if(call & vlm).alias("vlm"), F.count_if(call).alias("calls"),
        p("record_type = 'query_completed'", 0.5).alias("s50"), p("record_type = 'query_completed'", 0.95).alias("s95"), p("record_type = 'llm_call'", 0.5).alias("c50"), p("record_type = 'llm_call'", 0.95).alias("c95"), F.coalesce(F.sum(cost), F.lit(0)).alias("cost"),
    )
    one = t.crossJoin(j).crossJoin(clues)  # one row each
    some = lambda v: F.when(F.col("queries") > 0, v)
    rows = {
        "jump_success_rate": (F.try_divide("good", "n"), "n"), "no_gain_jump_rate": (F.try_divide("no_gain", "n"), "n"), "useful_clue_precision": (F.try_divide("useful", "used"), "used"),
        "average_jumps_per_query": (F.try_divide("n", "queries"), "queries"), "average_rounds": (F.try_divide("rounds", "queries"), "queries"),
        "search_calls": (some(F.col("searches")), "queries"), "llm_calls": (some(F.col("llm")), "queries"), "vlm_calls": (some(F.col("vlm")), "queries"),
        "system_latency_p50": (F.col("s50"), "queries"), "system_latency_p95": (F.col("s95"), "queries"), "per_call_latency_p50": (F.col("c50"), "calls"), "per_call_latency_p95": (F.col("c95"), "calls"),
        "total_cost": (some(F.col("cost")), "queries"),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.col(n).cast("long").alias("sample_size")) for k, (v, n) in rows.items()))).alias("m")).select("m.*")


def cost_per_query(trace: DataFrame) -> DataFrame:
    """Exact decimal cost of every completed query, 0 without a call."""
    done = trace.filter("record_type = 'query_completed'").select("query_id").distinct()
    spent = trace.filter("record_type = 'llm_call'").groupBy("query_id").agg(F.sum(F.col("cost_usd").cast("decimal(28,9)")).alias("cost"))
    return done.join(spent, "query_id", "left").select("query_id", F.coalesce("cost", F.lit(0).cast("decimal(38,9)")).alias("cost"))


def blocked_counts(trace: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    every = trace.sparkSession.createDataFrame([(r,) for r in reasons], "block_reason string")
    counts = trace.filter("action = 'jump' and outcome = 'blocked'").groupBy("block_reason").agg(F.count("*").alias("n"))
    return every.join(counts, "block_reason", "left").select("block_reason", F.coalesce("n", F.lit(0)).alias("n"))


def failure_stage(flags: list[tuple[str, str]]) -> Column:
    """The first stage in order that missed; flags: (column, name)."""
    out = F.lit(None).cast("string")
    for column, name in reversed(flags):
        out = F.when(~F.coalesce(F.col(column), F.lit(False)), name).otherwise(out)
    return out


def hit_changes(before: DataFrame, after: DataFrame, query: str, hit: str) -> DataFrame:
    """(outcome, n): queries that both rankings find or miss, and those the later one fixes or breaks."""
    both = before.select(query, (F.col(hit) > 0).alias("_a")).join(after.select(query, (F.col(hit) > 0).alias("_b")), query)
    outcome = F.when(F.col("_a") & F.col("_b"), "both_hit").when(F.col("_b"), "fixed").when(F.col("_a"), "broken").otherwise("both_miss")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, a: str, b: str) -> float | None:
    """Cohen's agreement of two raters from their contingency table."""
    table = {(r[0], r[1]): r[2] for r in rows.groupBy(a, b).count().collect()}
    n = sum(table.values())
    if not n:
        return None
    left, right = Counter(), Counter()
    for (x, y), k in table.items():
        left[x] += k
        right[y] += k
    same, chance = sum(k for (x, y), k in table.items() if x == y) / n, sum(left[x] * right[x] for x in left) / n / n
    return 1.0 if chance == 1 else (same - chance) / (1 - chance)


def assign_splits(components: DataFrame, total: int, quotas: dict[str, int], salt: str, most: int = 1_000_000) -> dict[str, str]:
    """Component -> dev or test so that dev has `total` rows and each stratum is near its quota: within 15 % of it, or 8.

    components: (component, stratum, n) of gold rows, at most `most` components (checked). They are visited in salted order, taking
    one is tried before leaving it, and the first choice that meets all is the answer. A branch ends as soon as some stratum is over, or could no
    longer reach its quota, or the total could not be met; REMEMBERED failed states are kept, which only saves time.
    """
    strata = sorted(quotas)
    known = F.when(F.col("stratum").isin(strata), F.col("stratum"))  # all strata without a quota count as one
    found = components.groupBy("component").agg(F.lit(1).alias("_one")).count()
    if found > most:
        raise ValueError(f"{found} components, more than {most}")
    place, size = {s: k for k, s in enumerate(strata)}, {}
    for r in components.groupBy("component", known.alias("stratum")).agg(F.sum("n").alias("n")).collect():  # most * (quotas + 1) rows
        size.setdefault(r["component"], [0] * (len(strata) + 1))[place.get(r["stratum"], len(strata))] += r["n"]
    order = sorted(size, key=lambda c: (hashlib.sha256(f"{salt}:{c}".encode()).hexdigest(), c))
    own = np.array([size[c] for c in order], np.int64).reshape(len(order), len(strata) + 1)
    left = np.vstack([np.cumsum(own[::-1], axis=0)[::-1], np.zeros((1, len(strata) + 1), np.int64)]).tolist()
    room = [max(8, int(0.15 * quotas[s])) for s in strata]
    low, high = ([quotas[s] + sign * r for s, r in zip(strata, room, strict=True)] for sign in (-1, 1))

    def hopeless(k: int, now: tuple[int, ...]) -> bool:
        taken, rest = sum(now), left[k]
        return taken > total or taken + sum(rest) < total or any(c > h or c + r < lo for c, r, lo, h in zip(now, rest, low, high, strict=False))

    # path: the rows taken before each component decided so far, and whether it was taken.
    path, now, failed = [], (0,) * (len(strata) + 1), set()
    while True:
        k = len(path)
        if sum(now) == total and all(lo <= c <= h for c, lo, h in zip(now, low, high, strict=False)):
            return {c: "dev" if j < k and path[j][1] else "test" for j, c in enumerate(order)}
        if k < len(order) and sum(now) < total and not hopeless(k, now) and (k, now) not in failed:
            path.append((now, True))
            now = tuple(c + x for c, x in zip(now, own[k].tolist(), strict=True))
            continue
        if len(failed) < REMEMBERED:
            failed.add((k, now))
        while path and not path[-1][1]:
            before, _ = path.pop()
            if len(failed) < REMEMBERED:
                failed.add((len(path), before))
        if not path:
            raise ValueError("no assignment meets the quotas")
        now = path[-1][0]
        path[-1] = now, False


def cross_split_edges(edges: DataFrame, split: DataFrame, left: str, right: str) -> DataFrame:
    """Edges whose ends lie in different splits; split: (component, split)."""
    side = lambda name, c: split.select(F.col("component").alias(c), F.col("split").alias(name))
    return edges.join(side("_a", left), left).join(side("_b", right), right).filter("_a <> _b").drop("_a", "_b")


def cluster_edges(members: DataFrame, cluster: str, group: str, most: int = 10) -> DataFrame:
    """(left, right): pairs of groups that share a cluster of 2 to `most` members; larger ones are collisions by rule.

    The size is counted before the self-join, so it pairs at most `most` rows of a cluster.
    """
    sizes = members.groupBy(cluster).agg(F.count("*").alias("_n")).filter(F.col("_n").between(2, most)).select(cluster)
    few = members.join(sizes, cluster, "left_semi").select(cluster, group).distinct()
    left, right = (few.select(cluster, F.col(group).alias(name)) for name in ("left", "right"))
    return left.join(right, cluster).filter("left < right").select("left", "right").distinct()


def group_components(edges: DataFrame, left: str, right: str, prefix: str = "comp") -> DataFrame:
    """(node, component, component_id): components numbered by their first member, as prefix_000_first."""
    found = connected_components(edges, left, right)
    firsts = global_rank(found.groupBy("component").agg(F.lit(1).alias("_one")).select("component"), ["component"], "number")
    named = firsts.select("component", F.format_string(f"{prefix}_%03d_%s", F.col("number"), F.col("component").cast("string")).alias("component_id"))
    return found.join(named, "component").select("node", "component", "component_id")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n_shared, disjoint) of two sets of keys."""
    both = left.select(key).distinct().join(right.select(key), key, "left_semi")
    return both.agg(F.count("*").alias("n_shared"), (F.count("*") == 0).alias("disjoint"))


def saturation(hits: DataFrame, hit: str, dev: Column, ceiling: float = 0.7) -> DataFrame:
    """(n, hits, rate, saturated) over the dev rows alone."""
    rows = hits.filter(dev)
    rate = F.round(F.avg(F.col(hit).cast("double")), 6)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(hit).cast("boolean")).alias("hits"), rate.alias("rate"), F.coalesce(rate >= ceiling, F.lit(False)).alias("saturated"))


def released_leaks(before: DataFrame, after: DataFrame, query: str, most: float = 0.15) -> DataFrame:
    """(n, leaked, rewritten, released_leaks, rate, passes): rows that leak are rewritten and scored again; the gate fails over `most`.

    before: (query, leak) of all rows; after: (query, leak) of those rewritten.
    """
    both = before.select(query, F.col("leak").alias("_a")).join(after.select(query, F.col("leak").alias("_b")), query, "left")
    still = F.col("_a") & F.coalesce("_b", F.lit(True))
    rate = F.round(F.avg(still.cast("double")), 6)
    return both.agg(F.count("*").alias("n"), F.count_if("_a").alias("leaked"), F.count_if(F.col("_a") & F.col("_b").isNotNull()).alias("rewritten"), F.count_if(still).alias("released_leaks"), rate.alias("rate"), F.coalesce(rate <= most, F.lit(True)).alias("passes"))


def containing(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(item, key): documents that hold an item's whole text. Items of fewer than five words have none.

    Words 2 to 4 of an item stand whole in every such document, so documents and items meet by equal runs of three words.
    """
    words = lambda c: F.split(F.col(c), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.concat_ws(" ", F.slice("_w", i, F.lit(3))))
    held = docs.select(key, words(text).alias("_w")).filter(F.size("_w") > 2).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    asked = items.select(item, F.col(item_text).alias("_item"), words(item_text).alias("_w")).filter(F.size("_w") > 4).select(item, "_item", F.concat_ws(" ", F.slice("_w", 2, 3)).alias("_run"))
    pairs = held.join(asked, "_run").select(item, key, "_item")
    return pairs.join(docs.select(key, F.col(text).alias("_text")), key).filter(F.contains("_text", "_item")).select(item, key).distinct()


def holding(docs: DataFrame, pairs: DataFrame, key: str, text: str, item: str, item_text: str, most: int = inverted.QUERY_TERMS) -> DataFrame:
    """(item, key) of those pairs whose document holds the item's whole text, whatever its length; pairs: (item, item_text, key).

    The keys of up to `most` pairs are broadcast (checked), so of the documents only theirs are moved.
    """
    pairs = staged(pairs.select(item, F.col(item_text).alias("_item"), key).distinct())
    keys = pairs.select(key).distinct()
    named = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(keys) if pairs.count() <= most else keys, key, "left_semi")
    return pairs.join(named, key).filter(F.contains("_text", "_item")).select(item, key).distinct()


def anti_leak_gate(docs: DataFrame, gold: DataFrame, key: str, text: str, query: str, query_text: str, rewrites: list[tuple[str, str]], control_every: int = 20, scorer: inverted.Scorer = inverted.LIBRARY) -> DataFrame:
    """(query, stratum, outcome, initial_hit, final_hit, released): what the gate does with each gold row.

    gold: (query, query_text, stratum, evidence array); without an evidence column every document that holds a row's whole text is its
    evidence, and the best hits alone are looked at. A row leaks if its best BM25 hit is among its evidence. Every
    control_every-th row in id order, rows without an id last, is a control and stays. Other leaking rows are rewritten by the rules and asked again: `rewritten` if
    the new question no longer leaks, else `unrewritable` with the old question; rows without a leak are `clean`. In the rules \\b is the edge of a run of [A-Za-z0-9_].
    """
    given = "evidence" in gold.columns
    # Lower case is of one code point each, as in the SQL; that of whole texts knows a final sigma and adds a dot to i.
    plain = lambda c: F.replace(F.replace(F.col(c), F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3"))
    asked = gold.select(query, query_text, "stratum", *["evidence"] * given, F.col(query).isNull().alias("_none"))
    rows = staged(global_rank(asked, ["_none", query], "_place").drop("_none"))

    def leaking(asked: DataFrame, column: str, flag: str) -> DataFrame:
        """(query, flag) of the rows that leak."""
        top = inverted.best(docs.select(key, plain(text).alias(text)), asked.select(query, plain(column).alias(column)), key, text, query, column, 1, scorer=scorer).select(F.col("query").alias(query), F.col("key").alias("_key"))
        found = asked.join(top, query)
        found = found.filter(F.array_contains("evidence", F.col("_key"))) if given else holding(docs.select(F.col(key).alias("_key"), text), found, "_key", text, query, query_text)
        return found.select(query).distinct().withColumn(flag, F.lit(True))

    new = substituted(F.col(query_text), [(f"(?i){a}".replace(r"\b", EDGE), b) for a, b in rewrites])
    first = staged(rows.join(leaking(rows, query_text, "_hit"), query, "left").withColumns({"_hit": F.coalesce("_hit", F.lit(False)), "_control": F.col("_place") % control_every == 0, "_new": new}))
    tried = staged(first.filter(F.col("_hit") & ~F.col("_control") & (F.col("_new") != F.col(query_text))))
    again = tried.select(query).distinct().join(leaking(tried, "_new", "_again"), query, "left").select(query, F.coalesce("_again", F.lit(False)).alias("_again"))
    outcome = F.when(F.col("_control"), "control_group").when(~F.col("_hit"), "clean").when(F.coalesce(~F.col("_again"), F.lit(False)), "rewritten").otherwise("unrewritable")
    done = first.join(again, query, "left").withColumn("outcome", outcome)
    changed = F.col("outcome") == "rewritten"
    return done.select(query, "stratum", "outcome", F.col("_hit").alias("initial_hit"), (F.col("_hit") & ~changed).alias("final_hit"), F.when(changed, F.col("_new")).otherwise(F.col(query_text)).alias("released"))


def gate_report(outcomes: DataFrame, most: float = 0.15) -> DataFrame:
    """(stratum, n, hits, rewritten, unrewritable, clean, control_n, control_hits, control_rate, gated_rate, released_hits, released_rate, passes); the row of all strata is called `all`, and is there, its released rate null, without any rows."""
    of = lambda name: F.col("outcome") == name
    control = of("control_group")
    counts = {"n": F.lit(True), "hits": F.col("initial_hit"), **{x: of(x) for x in ("rewritten", "unrewritable", "clean")}, "control_n": control, "control_hits": control & F.col("initial_hit"), "_gated": ~control, "_gated_hits": ~control & F.col("initial_hit"), "released_hits": F.col("final_hit")}
    each = staged(outcomes.groupBy("stratum").agg(*(F.count_if(c).alias(name) for name, c in counts.items())))
    whole = each.agg(*(F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name) for name in counts))
    found = each.withColumn("stratum", F.col("stratum").cast("string")).unionByName(whole.withColumn("stratum", F.lit("all")))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    found = found.withColumns({"control_rate": rate("control_hits", "control_n"), "gated_rate": rate("_gated_hits", "_gated"), "released_rate": F.round(F.try_divide("released_hits", "n"), 6)})
    return found.withColumn("passes", F.col("released_rate") <= most).drop("_gated", "_gated_hits")


def probe_summary(probes: DataFrame, endpoint: str, latency: str, rejected: str) -> DataFrame:
    """(endpoint, n, p50, rejection_rate, chosen): the endpoint with the smallest latency seen is chosen, ties by name."""
    rows = probes.groupBy(endpoint).agg(F.count("*").alias("n"), percentile_nearest(latency, 0.5).alias("p50"), F.round(F.avg(F.col(rejected).cast("double")), 6).alias("rejection_rate"), F.min(latency).alias("_least"))
    best = probes.agg(F.min_by(endpoint, F.struct(F.col(latency), F.col(endpoint))).alias("_best"))
    return rows.crossJoin(F.broadcast(best)).select(endpoint, "n", "p50", "rejection_rate", (F.col(endpoint) == F.col("_best")).alias("chosen"))  # one row
