import pandas as pd

from chatloom.plans import catalog
from tests.compare import plain

TEXTS = ["ßung x", "  abc　", "ŉab", "ﬁab", "ᾂx", "ab ", "ɤb", "ǆab", "\u0085a\u0085", "", None, "12 !!b"]


def test_capitals_and_ends_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}).to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(catalog.oracle_sql()["text_clean"]).df()
    assert plain(catalog.queries()["text_clean"](spark, str(tmp_path)).toPandas()) == plain(want)
