"""Comparison of a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(table):
    columns = sorted(table.column_names)
    cell = lambda v: round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool)) else str(v)
    return columns, sorted((tuple(map(cell, r)) for r in zip(*[table.column(c).to_pylist() for c in columns])), key=repr)


def same(df, sql, d):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert values(df.toArrow()) == values(con.sql(sql).to_arrow_table())
