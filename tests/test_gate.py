"""The anti-leak gate against its SQL, on short questions and odd rows."""

import duckdb
import pytest

from chatloom.operators import evaluate
from chatloom.plans import catalog, catalog_search  # noqa: F401  registers its queries

DOCS = [(0, "red apple tree house"), (1, "blue lake water house"), (2, "another gathering of weather vanes near the old mill"), (3, "zebra"), (4, "zebra zebra crossing"), (5, None), (6, ""), (7, "Ré èletion, quagmires\tand nothing else"), (8, "the mill house"), (9, "İz"), (10, "ΣΟΦΟΣ.Α")]
ASKED = ["red apple", "blue lake water", "another gathering", "gathering of weather vanes", "athering of weather vanes nea", "zebra", "ebra cross", "èletion, quagmires\tand", "", None, " ", "lake  water", "mill", "Ré èletion, quagmires\tand nothing", "İz", "ΣΟΦΟΣ"]


@pytest.mark.parametrize("asked", [list(enumerate(ASKED * 2)), [(None, "blue lake water"), (0, "zebra"), (1, "mill")], []])
def test_the_gate_equals_its_sql_on_short_questions_and_odd_rows(spark, tmp_path, asked):
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("anti_leak_outcomes", "anti_leak_report"):
        got = catalog.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_holding_looks_at_every_pair_whatever_is_broadcast(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "twofold"), (3, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, "two", 1), (1, "two", 2), (2, "one  two", 1), (3, "", 2), (4, None, 1), (5, "two", 3), (6, "two", 9), (7, "one two", 1)], "item long, text string, doc_id long")
    for most in (0, 100):
        assert sorted(map(tuple, evaluate.holding(docs, pairs, "doc_id", "text", "item", "text", most).collect())) == [(1, 1), (1, 2), (3, 2), (7, 1)]
