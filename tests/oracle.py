"""Comparison of registered queries with their SQL."""

import pathlib

import duckdb

SMALL = "/root/testdata/sf0.001"


def views(folder):
    db = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        where = f"{path}/*.parquet" if path.is_dir() else path
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{where}'")
    return db


def plain(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in found)


def differs(spark, db, folder, query, sql):
    frame = query(spark, folder)
    got = plain(frame.columns, [tuple(r) for r in frame.collect()])
    db.execute(sql)
    want = plain([d[0] for d in db.description], db.fetchall())
    return None if got == want else (got[0], want[0], len(got[1]), len(want[1]), [r for r in got[1] if r not in want[1]][:2], [r for r in want[1] if r not in got[1]][:2])
