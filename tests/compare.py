"""Compare a query with its oracle."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c.sql(sql).df()


def same(got, want) -> None:
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def rows(df):
        def one(x):
            if x is None or x is pd.NA or (isinstance(x, float) and x != x):
                return ""
            return str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

        return sorted(tuple(one(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)
