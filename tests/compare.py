"""Compare a query with its DuckDB counterpart."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def same_rows(spark, query, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    return len(got)
