"""A result of Spark beside the result of the same query in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings scrobbles run_metadata artist_profile artist_tags tag_taxonomy".split()


def views(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{root}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}")


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    inner = ", ".join(f'"{c}"' for c in names)
    want = sorted(repr(tuple(map(plain, r))) for r in con.execute(f"select {inner} from ({sql})").fetchall())
    assert got == want
