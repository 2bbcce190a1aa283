"""Runs a DuckDB twin over the same rows as a Spark query."""

import duckdb


def same_rows(df, sql: str, **tables) -> None:
    """Assert that ``df`` has the rows that ``sql`` gives over ``tables`` (DataFrames or parquet paths)."""
    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.sql(f"CREATE VIEW {name} AS FROM '{t}'")
        else:
            con.register(name, t.toArrow())
    names = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    ours = [tuple(r) for r in df.select(*names).collect()]
    plain = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert plain(ours) == plain(theirs)
