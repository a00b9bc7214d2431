"""Queries of context and answers: directed expansion, capped output, fusion by scaled scores, measures of answers, chunk headers, canonical rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import chunks, evaluate, lexical
from chatloom.plans.catalog import _CHUNKS, _HITS, _chunks, _placed, _sections, query, table
from chatloom.sources.files import canonical_json

_DIRECTED = _HITS + """, lv as (select *, (first_index + conv_id) % 4 as level, case (first_index + conv_id) % 3 when 0 then 'both' when 1 then 'forward' else 'backward' end direction from sec),
en as (select conv_id, min(chunk_index) mn, max(chunk_index) mx from t group by 1),
rg as (select lv.*, case when level = 1 then first_index when direction = 'both' then center_index - case level when 2 then 2 else 5 end when direction = 'backward' then first_index - case level when 2 then 4 else 10 end else first_index end lo,
case when level = 1 then last_index when direction = 'both' then center_index + case level when 2 then 2 else 5 end when direction = 'forward' then last_index + case level when 2 then 4 else 10 end else last_index end hi, mn, mx from lv join en using (conv_id) where level > 0),
ok as (select conv_id, center_index, section_rank, level, direction, greatest(lo, mn) low, least(hi, mx) high, lo < mn or hi > mx truncated from rg)
"""


def _ranges(spark, sf_dir):
    place = F.col("first_index") + F.col("conv_id")
    chosen = _sections(spark, sf_dir).withColumns({"level": place % 4, "direction": F.element_at(F.array(F.lit("both"), F.lit("forward"), F.lit("backward")), (place % 3 + 1).cast("int"))})
    return chunks.directed_ranges(chosen, _chunks(spark, sf_dir).select("conv_id", "chunk_index"), "conv_id", "chunk_index")


@query(_DIRECTED + "select conv_id, center_index, level, direction, low, high, truncated from ok")
def directed_expansion(spark, sf_dir):
    """To both sides or to one, by level, cut at the ends of the document."""
    return _ranges(spark, sf_dir).select("conv_id", "center_index", "level", "direction", "low", "high", "truncated")


@query(_DIRECTED + ", e as (select conv_id % 5 q, conv_id, unnest(generate_series(low, high)) chunk_index, section_rank from ok), o as (select q, conv_id, chunk_index, min(section_rank) section_rank from e group by all) select * from o qualify row_number() over (partition by q order by section_rank, conv_id, chunk_index) <= 30")
def capped_output(spark, sf_dir):
    """Overlapping sections once, thirty chunks of a question at most."""
    return chunks.output_chunks(_ranges(spark, sf_dir).withColumn("q", F.col("conv_id") % 5), "q", "conv_id", "section_rank")


_HEADED = _CHUNKS + """, l as (select conv_id, turn, chunk_index, coalesce(role, 'unknown') || ': ' || coalesce(text, '') || case turn % 3 when 0 then ' [image:a' || turn || ']' when 1 then ' [image:b' || turn || '] [image:c]' else '' end l from p join conversations using (conv_id, turn))
select conv_id, chunk_index, sha256('[conversation:' || conv_id || '] [day:' || (date '2026-01-01' + ((conv_id + min(turn)) % 28)::int)::varchar || ']' || chr(10) || string_agg(l, chr(10) order by turn)) as digest from l group by conv_id, chunk_index"""


@query(_HEADED)
def chunk_headers(spark, sf_dir):
    """Chunks with the day in their header and images in their lines."""
    k = F.col("turn") % 3
    number = F.col("turn").cast("string")
    media = F.when(k == 0, F.array(F.concat(F.lit("a"), number))).when(k == 1, F.array(F.concat(F.lit("b"), number), F.lit("c")))
    day = F.date_add(F.lit("2026-01-01").cast("date"), ((F.col("conv_id") + F.col("turn")) % 28).cast("int"))
    found = chunks.chunk_table(_placed(spark, sf_dir).withColumns({"media": media, "day": day}), "conv_id", "turn", "role", "text", day="day", media="media")
    return found.select("conv_id", "chunk_index", F.sha2("text", 256).alias("digest"))


@query("""with l as (select l_orderkey, l_partkey, max(l_quantity)::double a, min(l_extendedprice)::double b from lineitem group by all),
w as (select *, min(a) over q la, max(a) over q ha, min(b) over q lb, max(b) over q hb from l window q as (partition by l_orderkey)),
f as (select l_orderkey, l_partkey, round(0.5::double * case when ha > la then (a - la) / (ha - la) else 0 end + 0.5::double * case when hb > lb then (b - lb) / (hb - lb) else 0 end, 9) score from w)
select *, row_number() over (partition by l_orderkey order by score desc, l_partkey) as rank from f""")
def minmax_fusion(spark, sf_dir):
    """Two scores brought to one scale in each question and added half and half."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("double").alias("a"), F.min("l_extendedprice").cast("double").alias("b"))
    return lexical.minmax_fusion(rows, "l_orderkey", "l_partkey", {"a": 0.5, "b": 0.5})


@query("""with q as (select o_orderkey k, list(l_partkey % 20 order by l_linenumber, l_partkey % 20, l_suppkey % 6, l_quantity > 25) r, list(l_suppkey % 6 order by l_linenumber, l_partkey % 20, l_suppkey % 6, l_quantity > 25) c, list(l_quantity > 25 order by l_linenumber, l_partkey % 20, l_suppkey % 6, l_quantity > 25) ok, o_custkey from orders join lineitem on l_orderkey = o_orderkey group by all),
g as (select *, [o_custkey % 20, (o_custkey + 3) % 20] gm, case when k % 3 <> 0 then [o_custkey % 6] else [] end ge, case when k % 4 = 0 then [o_custkey % 20] else [] end gb, [r[1]] am from q),
m as (select (list_sort(list_distinct(gm)) = list_sort(list_distinct(am)))::int::double a, len(list_intersect(list_distinct(gm), list_distinct(r[1:3]))) / len(list_distinct(gm)) b, case when len(ge) > 0 then len(list_intersect(ge, c)) / len(ge) end c1, len(list_intersect(list_distinct(c), ge)) / len(list_distinct(c)) d, case when len(gb) > 0 then len(list_intersect(gb, r)) / len(gb) end e, len(list_filter(ok, lambda x: x)) / len(ok) f from g)
select metric, round(avg(v), 6) as value, count(v)::bigint sample_size from (select unnest([{'metric': 'exact_media_accuracy', 'v': a}, {'metric': 'media_recall_at_k', 'v': b}, {'metric': 'evidence_recall', 'v': c1}, {'metric': 'context_precision', 'v': d}, {'metric': 'bridge_recall', 'v': e}, {'metric': 'constraint_satisfaction', 'v': f}], recursive := true) from m) group by 1""")
def answer_metrics(spark, sf_dir):
    """Six measures of answers, each over the questions that have what it needs."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 20).alias("p"), (F.col("l_suppkey") % 6).alias("s"), (F.col("l_quantity") > 25).alias("ok")))).alias("x"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        F.array(c % 20, (c + 3) % 20).alias("gold_media"), F.array(F.col("x.p")[0]).alias("answer_media"), F.col("x.p").alias("retrieved_media"), F.when(k % 3 != 0, F.array(c % 6)).otherwise(none).alias("gold_evidence"),
        F.col("x.s").alias("context_ids"), F.when(k % 4 == 0, F.array(c % 20)).otherwise(none).alias("gold_bridges"), F.col("x.p").alias("bridges"), F.col("x.ok").alias("constraints"),
    )
    return evaluate.answer_metrics(rows, 3)


@query("""with s as (select case when event_id % 2 = 0 then 'retrieval_miss' when event_id % 3 = 0 then 'selection_miss' when event_id % 5 = 0 then 'expansion_miss' when event_id % 7 = 0 then 'context_miss' when value <= 50 then 'reasoning_miss' end stage from events)
select n.stage, count(s.stage)::bigint n from (select unnest(['retrieval_miss', 'selection_miss', 'expansion_miss', 'context_miss', 'reasoning_miss']) stage) n left join s using (stage) group by 1""")
def failure_counts(spark, sf_dir):
    """Where questions are lost, all five stages."""
    flags = {"found": F.col("event_id") % 2 != 0, "kept": F.col("event_id") % 3 != 0, "reached": F.col("event_id") % 5 != 0, "evident": F.col("event_id") % 7 != 0, "answered": ~F.coalesce(F.col("value") <= 50, F.lit(False))}
    return evaluate.failure_counts(table(spark, sf_dir, "events").withColumns(flags), list(flags))


@query("select c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":' || case when c_custkey % 3 = 0 then 'null' else '\"' || c_mktsegment || '\"' end || ',\"c_nationkey\":' || c_nationkey || '}') digest from customer")
def canonical_rows(spark, sf_dir):
    """Rows as JSON with sorted keys and nulls kept."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return rows.select("c_custkey", F.sha2(canonical_json(rows.columns), 256).alias("digest"))
