"""Compares a registered query with its DuckDB twin, as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def twin_rows(sql: str, d: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], [tuple(r[i] for i in order) for r in rel.fetchall()]


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if x != x else x
        if isinstance(x, (list, tuple)):
            return tuple(value(y) for y in x)
        return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


def assert_twin(df, sql: str, d: str) -> int:
    columns, theirs = twin_rows(sql, d)
    assert columns == sorted(df.columns)
    ours = plain([tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()])
    theirs = plain(theirs)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b
    return len(ours)
