"""Queries over the inverted index: BM25 by channel, an index kept in batches, the anti-leak gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators import evaluate, inverted
from chatloom.plans.catalog import _BM25, _CHUNKS, TOP_K, _chunks, query, table
from chatloom.session import shared_dir


def _bm25_sql(docs: str, asks: str, more: str) -> str:
    """BM25 by channel over docs (channel, key, text) and asks (query, channel, text), to ranked (query, channel, key, score, rank)."""
    return more + f"""docs as ({docs}), asks as ({asks}),
dt as (select channel, key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from docs),
dl as (select channel, key, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) dl from docs),
w as (select channel, count(*) n, avg(dl) a from dl group by 1),
q as (select distinct query, channel, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from asks),
tf as (select channel, key, term, count(*) tf from dt where term in (select term from q) group by all),
df as (select channel, term, count(*) df from tf group by all),
s as (select q.query, q.channel, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score
  from q join tf using (channel, term) join df using (channel, term) join dl using (channel, key) join w using (channel) group by q.query, q.channel, key),
ranked as (select *, row_number() over (partition by query, channel order by score desc, key) as rank from s where score > 0)
"""


@query(_bm25_sql("select source channel, doc_id as key, text from documents", "select item_id query, 'src' || (item_id % 7) channel, text from benchmark", "with ") + f"select query item_id, channel, key doc_id, score, rank from ranked where rank <= {TOP_K}")
def bm25_by_channel(spark, sf_dir):
    """Each item asks one source, with the source's own statistics."""
    asks = table(spark, sf_dir, "benchmark").withColumn("channel", F.concat(F.lit("src"), F.col("item_id") % 7))
    found = inverted.best(table(spark, sf_dir, "documents"), asks, "doc_id", "text", "item_id", "text", TOP_K, "source", "channel")
    return found.select(F.col("query").alias("item_id"), "channel", F.col("key").alias("doc_id"), "score", "rank")


_CLOSED = _CHUNKS + """, l as (select conv_id, turn, chunk_index, coalesce(role, 'unknown') || ': ' || coalesce(text, '') l from p join conversations using (conv_id, turn)),
cl as (select conv_id, chunk_index, '[conversation:' || conv_id || ']' || chr(10) || string_agg(l, chr(10) order by turn) as text from l group by conv_id, chunk_index), """


@query(_bm25_sql("select (conv_id % 4)::varchar channel, conv_id * 100000 + chunk_index as key, text from cl where chunk_index < (select max(chunk_index) from cl o where o.conv_id = cl.conv_id) and (conv_id + chunk_index) % 9 <> 0", "select conv_id query, (conv_id % 4)::varchar channel, text from conversations where turn = 0 and conv_id % 10 = 0", _CLOSED) + f"select query conv_id, channel, key, score, rank from ranked where rank <= {TOP_K}")
def bm25_closed_chunks(spark, sf_dir):
    """An index kept in three batches of closed chunks, of which a ninth is taken out again."""
    closed = _chunks(spark, sf_dir).filter("status = 'closed'").select((F.col("conv_id") % 4).cast("string").alias("channel"), (F.col("conv_id") * 100_000 + F.col("chunk_index")).alias("key"), "text", "conv_id", "chunk_index")
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    for batch in range(3):
        inverted.add(closed.filter(F.pmod("conv_id", F.lit(3)) == batch), batch, folder, "channel", "key", "text")
    inverted.remove(closed.filter((F.col("conv_id") + F.col("chunk_index")) % 9 == 0), 3, folder, "channel", "key", "text")
    asks = table(spark, sf_dir, "conversations").filter("turn = 0 and conv_id % 10 = 0").withColumn("channel", (F.col("conv_id") % 4).cast("string"))
    rows, df, totals, removed = inverted.kept(spark, folder)
    found = inverted.search(inverted.query_terms(asks, "conv_id", "channel", "text"), rows, df, totals, TOP_K, removed)
    return found.select(F.col("query").alias("conv_id"), "channel", "key", "score", "rank")


_STOP = ", ".join(f"'{x}'" for x in inverted.STOP_WORDS)


def _library_sql(asks: str, name: str, docs: str = "documents") -> str:
    """The best document of each question by BM25 with library defaults: {name}r (query, doc_id)."""
    return f"""{name}q as (select distinct query, term from (select query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) term from {asks}) where term not in ({_STOP})),
{name}f as (select doc_id, term, count(*) tf from lt where term in (select term from {name}q) group by all), {name}d as (select term, count(*) df from {name}f group by 1),
{name}s as (select query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score from {name}q join {name}f using (term) join {name}d using (term) join ll using (doc_id), lw group by all),
{name}r as (select * from {name}s where score > 0 qualify row_number() over (partition by query order by score desc, doc_id) = 1)"""


_LIBRARY = f"""with lt as (select doc_id, term from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) term from documents) where term not in ({_STOP})),
ll as (select d.doc_id, coalesce(c.dl, 0) dl from documents d left join (select doc_id, count(*) dl from lt group by 1) c using (doc_id)), lw as (select count(*) n, avg(dl) a from ll), """.replace("\\\\", "\\")


@query(_LIBRARY + _library_sql("(select item_id query, text from benchmark)", "b") + " select query item_id, doc_id, score from br")
def bm25_library_top1(spark, sf_dir):
    """Words of two characters or more, without stop words."""
    found = inverted.best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 1, scorer=inverted.LIBRARY)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score")


#: Rules that take the rarer words out of the questions of these tables.
REWRITES = [(r"\b[a-z]*th[a-z]*er[a-z]*\b", "thing"), (r"\b[a-z]*(?:tion|eau|sch)[a-z]*\b", "matter"), (r"\b[a-z]{7,}\b", "something")]


def _gate(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 4).alias("stratum"))
    docs = table(spark, sf_dir, "documents")
    return evaluate.anti_leak_gate(docs, items, "doc_id", "text", "item_id", "text", REWRITES)


_RULES = "text"
for _a, _b in REWRITES:
    _RULES = f"regexp_replace({_RULES}, '{_a}', '{_b}', 'gi')"
_GATE = _LIBRARY + _library_sql("(select item_id query, text from benchmark)", "b") + f""", ev as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
g as (select b.item_id, b.item_id % 4 stratum, text, {_RULES} nu, (row_number() over (order by b.item_id) - 1) % 20 = 0 control, exists (select 1 from br join ev on ev.item_id = br.query and ev.doc_id = br.doc_id where br.query = b.item_id) hit from benchmark b),
again as (select item_id query, nu as text from g where hit and not control and nu <> text), """ + _library_sql("again", "c") + """,
o as (select item_id, stratum, case when control then 'control_group' when not hit then 'clean' when item_id in (select query from again) and not exists (select 1 from cr join ev on ev.item_id = cr.query and ev.doc_id = cr.doc_id where cr.query = g.item_id) then 'rewritten' else 'unrewritable' end outcome, hit initial_hit, text, nu from g),
oo as (select item_id, stratum, outcome, initial_hit, initial_hit and outcome <> 'rewritten' final_hit, case when outcome = 'rewritten' then nu else text end released from o)
"""


@query(_GATE + "select * from oo")
def anti_leak_outcomes(spark, sf_dir):
    """Leaking questions are rewritten and asked again."""
    return _gate(spark, sf_dir)


@query(_GATE + """select case when grouping(oo.stratum) = 1 then 'all' else oo.stratum::varchar end stratum, count(*)::bigint n, count(*) filter (initial_hit)::bigint hits, count(*) filter (outcome = 'rewritten')::bigint rewritten, count(*) filter (outcome = 'unrewritable')::bigint unrewritable, count(*) filter (outcome = 'clean')::bigint clean,
count(*) filter (outcome = 'control_group')::bigint control_n, count(*) filter (outcome = 'control_group' and initial_hit)::bigint control_hits, round(coalesce(avg(initial_hit::int) filter (outcome = 'control_group'), 0), 6) control_rate,
round(coalesce(avg(initial_hit::int) filter (outcome <> 'control_group'), 0), 6) gated_rate, count(*) filter (final_hit)::bigint released_hits, round(avg(final_hit::int), 6) released_rate, round(avg(final_hit::int), 6) <= 0.15 passes from oo group by rollup (oo.stratum)""")
def anti_leak_report(spark, sf_dir):
    """Control and gated rates before, the released rate after, for each stratum and for all."""
    return evaluate.gate_report(_gate(spark, sf_dir))
