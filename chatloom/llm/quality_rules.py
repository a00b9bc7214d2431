"""Line-first cleaning with DataFrame expressions only.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text is rejected.

Defined cases: a null text has no words and no lines (`kept` false, `clean_text`
null); an empty text is the same with an empty `clean_text`; repeated rows give
repeated results; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import documents

# White space and symbols of the contract, and phrases of page furniture.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›"
FURNITURE = (
    "cookie policy", "accept cookies", "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here", "sign up for", "log in to",
    "share on facebook", "share on twitter", "back to top", "skip to content", "powered by wordpress", "page not found",
)
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS_PER_WORD, UPPER_SHARE, NAV_SEPARATORS_PER_WORD, REPEAT_MIN_WORDS = 0.5, 0.7, 0.2, 4
MAX_LOST_SHARE = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit("[" + chars + "]"))


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


#: Holds wherever most letters of a line are capitals: two in a row among its letters, or a single one. Never looks past the line.
SHOUT_HINT = r"\p{Lu}[^\p{L}\n]*+(?:\p{Lu}|\n|\z)"


def line_fails(line: Column, symbols: Column | None = None, separators: Column | None = None, shouts: Column | None = None, phrases: Column | None = None) -> Column:
    """True for a line that punctuation, navigation or boilerplate rules remove; blank lines stay.

    The other columns say that the rule could hold for some line of the document; they only save work.
    """
    yes = F.lit(True)
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    upper = F.regexp_count(line, F.lit(r"\p{Lu}"))
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in FURNITURE:
        furniture = furniture | F.contains(low, F.lit(phrase))
    rule = lambda might, test: F.when(yes if might is None else might, test).otherwise(False)
    return (
        rule(symbols, _count(line, SYMBOLS) > SYMBOLS_PER_WORD * words)
        | rule(shouts, line.rlike(SHOUT_HINT) & (words >= 3) & (letters > 0) & (upper > UPPER_SHARE * letters))
        | (~line.rlike(r"\p{L}") & _has_word(line))
        | rule(separators, (_count(line, SEPARATORS) >= 2) & (_count(line, SEPARATORS) > NAV_SEPARATORS_PER_WORD * words))
        | rule(phrases, furniture)
    )


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, clean_text, n_lines, n_failed_lines, lost_share, kept and the document measures) of every row.

    Repeats after the first of a line with four words or more count as boilerplate.
    Narrow: no exchange, every document is handled where it is read.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("_words", F.filter(F.split(t, BLANK), lambda w: w != "")).withColumn("_lines", F.split(t, "\n"))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn(
        "_win",
        F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    d = d.withColumn("_sorted", F.when(F.col("_twice"), F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get(F.col("_sorted"), k)["h"]
    d = d.withColumn(
        "_starts",
        F.when(F.col("_sorted").isNotNull(), F.array_sort(F.array_compact(F.transform("_sorted", lambda x, k: F.when((at(k + 1) == x["h"]) | ((k > 0) & (at(F.greatest(k - 1, F.lit(0))) == x["h"])), x["i"]))))),
    )
    n = F.size("_starts")
    steps = F.zip_with(F.slice("_starts", 2, n), F.slice("_starts", 1, n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    d = d.withColumn("n_repeat_words", F.when(F.col("_starts").isNotNull() & (n > 0), F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0).cast("long"))
    d = d.withColumn("_full", F.filter("_lines", _has_word))
    d = d.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long")).withColumn("n_symbols", _count(t, SYMBOLS).cast("long"))
    low, phrases = F.lower(t), F.lit(False)
    for phrase in FURNITURE:
        phrases = phrases | F.contains(low, F.lit(phrase))
    d = d.withColumn("_hints", F.array(F.col("n_symbols") > 0, t.rlike(f"[{SEPARATORS}]"), t.rlike(SHOUT_HINT), phrases))
    fails = lambda line: line_fails(line, *(F.get("_hints", F.lit(k)) for k in range(4)))
    long_line = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) >= REPEAT_MIN_WORDS
    # Where lines repeat, sort them to find each one's first position.
    d = d.withColumn("_runs", F.when(F.col("n_dup_lines") > 0, F.array_sort(F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    first = lambda r, k: (k == 0) | (F.get(F.col("_runs"), F.greatest(k - 1, F.lit(0)))["x"] != r["x"])
    d = d.withColumn("_once", F.filter("_runs", lambda r, k: (first(r, k) | ~long_line(r["x"])) & ~fails(r["x"])))
    d = d.withColumn(
        "_kept",
        F.when(F.col("_once").isNull(), F.filter("_lines", lambda x: ~fails(x))).otherwise(
            F.transform(F.array_sort(F.transform("_once", lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x")))), lambda r: r["x"])
        ),
    )
    d = d.withColumn("clean_text", F.when(F.col("text").isNotNull(), F.concat_ws("\n", "_kept")))
    d = d.withColumn("n_lines", F.size("_full").cast("long")).withColumn("n_failed_lines", (F.size("_full") - F.size(F.filter("_kept", _has_word))).cast("long"))
    whole = F.size("_kept") == F.size("_lines")
    kept_chars = F.when(whole, F.col("word_chars")).otherwise(F.length(F.regexp_replace(F.coalesce("clean_text", F.lit("")), BLANK, "")))
    d = d.withColumn("lost_share", F.when(F.col("word_chars") > 0, 1 - kept_chars / F.col("word_chars")).otherwise(F.lit(0.0)))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= MAX_LOST_SHARE))
    return d.drop("_words", "_lines", "_win", "_twice", "_sorted", "_starts", "_full", "_runs", "_once", "_kept", "_hints")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    furniture = " or ".join(f"contains(lower(l), '{p}')" for p in FURNITURE)
    seps = "[|»›]"
    return f"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws, string_split(t, chr(10)) ls from d),
win as (select rid, i, array_to_string(ws[i:i+7], ' ') k from (select rid, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, k) c from win) where c > 1),
rep as (select rid, sum(least(8, coalesce(nx - i, 8))) n from (select rid, i, lead(i) over (partition by rid order by i) nx from hit) group by rid),
lines as (select rid, unnest(ls) l, unnest(range(1, len(ls) + 1)) pos from w),
j as (select rid, l, pos, len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) nw,
  length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) sy, length(regexp_replace(l, '[^\\pL]', '', 'g')) le, length(regexp_replace(l, '[^\\p{{Lu}}]', '', 'g')) up,
  length(l) - length(regexp_replace(l, '{seps}', '', 'g')) se, row_number() over (partition by rid, l order by pos) nth from lines),
g as (select rid, sum(length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g'))) chars from j
  where not ((sy > {SYMBOLS_PER_WORD} * nw) or (nw >= 3 and le > 0 and up > {UPPER_SHARE} * le) or (nw > 0 and le = 0) or (se >= 2 and se > {NAV_SEPARATORS_PER_WORD} * nw) or {furniture})
  and (nw < {REPEAT_MIN_WORDS} or nth = 1) group by rid),
dup as (select rid, count(*) filter (nw > 0) - count(distinct l) filter (nw > 0) n from j group by rid),
m as (select doc_id, rid, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(g.chars, 0) chars
  from w left join rep using (rid) left join dup using (rid) left join g using (rid)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and case when word_chars > 0 then 1 - chars / word_chars::double else 0.0 end <= {MAX_LOST_SHARE}) kept from b
"""


OP5_SQL = _sql()
