"""Run checked queries and their SQL side by side: python -m verification.check [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from verification.oracles import ORACLES
from verification.queries import QUERIES
from verification.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    took = f"{time.time() - start:6.2f}s"
    if name not in ORACLES:
        return f"ROWS  {took} {name}: {len(rows)}"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    sql_took = f"{time.time() - start:6.2f}s"
    if sorted(columns) != sorted(frame.columns):
        return f"FAIL  {took} {name}: columns {sorted(frame.columns)} / {sorted(columns)}"
    ours, theirs = canonical(rows, frame.columns), canonical(expected, columns)
    if ours == theirs:
        return f"ok    {took} {sql_took} {name}: {len(rows)} rows"
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    show = "\n   spark only: ".join([""] + sorted(left - right)[:4])
    show += "\n   sql only:   ".join([""] + sorted(right - left)[:4])
    return f"FAIL  {took} {name}: {len(ours)} / {len(theirs)} rows, {sorted(columns)}{show}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or QUERIES:
        try:
            print(compare(spark, con, sf_dir, name), flush=True)
        except Exception as problem:
            print(f"FAIL  {name}: {type(problem).__name__} {str(problem)[:600]}", flush=True)


if __name__ == "__main__":
    main()
