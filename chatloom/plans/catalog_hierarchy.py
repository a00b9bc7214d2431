"""The query down the hierarchy of topics, episodes and messages of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import hierarchy
from chatloom.plans.catalog import query, table

KEEP, WIDTH = {"topic": 2, "episode": 3, "message": 5}, 8


def _level_sql(name: str, parent: str | None) -> str:
    """CTEs of one level: its kept nodes as {name}k (query, node, score, rank)."""
    n = name
    first = f"{n}p as (select query, node from (select query, node, row_number() over (partition by query order by bm25 desc, node) r from {n}s) where r <= {WIDTH})"
    lower = f"{n}p as (select query, c.node from {n}n c join {parent}k k on k.node = c.parent)"
    return f"""{n}t as (select node, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) term from {n}n),
{n}l as (select node, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) dl from {n}n), {n}w as (select count(*) n, avg(dl) a from {n}l),
{n}f as (select node, term, count(*) tf from {n}t where term in (select term from asked) group by all), {n}d as (select term, count(*) df from {n}f group by 1),
{n}s as (select query, node, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) bm25, count(*) overlap from asked join {n}f using (term) join {n}d using (term) join {n}l using (node), {n}w group by all),
{lower if parent else first},
{n}r as (select query, node, row_number() over (partition by query order by bm25 desc, node) a, bm25 > 0 pos, row_number() over (partition by query order by overlap desc, node) b from {n}s join {n}p using (query, node)),
{n}u as (select query, node, round(case when pos then 1.0::double / (60 + a) else 0 end + 0.5::double / (60 + b), 9) score from {n}r),
{n}k as (select * from (select *, row_number() over (partition by query order by score desc, node) as rank from {n}u) where rank <= {KEEP[name]})"""


_SQL = f"""with asked as (select distinct query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from (select conv_id query, text from conversations where turn = 1 and conv_id % 10 = 0)),
topicn as (select conv_id % 12 node, string_agg(text, chr(10) order by conv_id) text from conversations where turn = 0 group by 1),
episoden as (select conv_id node, conv_id % 12 parent, string_agg(coalesce(text, ''), chr(10) order by turn) text from conversations where turn is not null group by all),
messagen as (select conv_id * 100000 + turn node, conv_id parent, text from conversations where turn is not null),
{_level_sql("topic", None)}, {_level_sql("episode", "topic")}, {_level_sql("message", "episode")}
"""


@query(_SQL + " union all ".join(f"select query, '{n}' as level, node, score, rank from {n}k" for n in KEEP))
def hierarchy_search(spark, sf_dir):
    """Topics, then episodes of kept topics, then messages of kept episodes, each level ranked by fused ranks of two models."""
    rows = table(spark, sf_dir, "conversations").filter("turn is not null")
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text")
    topics = rows.filter("turn = 0 and text is not null").groupBy((F.col("conv_id") % 12).alias("node")).agg(joined("conv_id"))
    episodes = rows.groupBy(F.col("conv_id").alias("node"), (F.col("conv_id") % 12).alias("parent")).agg(joined("turn"))
    messages = rows.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("node"), F.col("conv_id").alias("parent"), "text")
    questions = rows.filter("turn = 1 and conv_id % 10 = 0").select(F.col("conv_id").alias("query"), "text")
    levels = [hierarchy.Level(n, nodes, KEEP[n]) for n, nodes in (("topic", topics), ("episode", episodes), ("message", messages))]
    return hierarchy.descend(questions, levels, WIDTH)
