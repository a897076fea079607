"""Compare a registered query with its DuckDB statement on one data folder."""

from __future__ import annotations

import datetime
import decimal
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """'' if equal, else a description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(_cell(v) for v in row) for row in df.select(*columns).collect())
    spent = time.time() - start
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} vs {sorted(theirs_columns)}"
    types = dict(zip(theirs_columns, [str(d[1]) for d in cursor.description]))
    wrong = [
        f"{c}: {t} vs {types[c]}"
        for c, t in df.dtypes
        if t in SPARK_TYPES and SPARK_TYPES[t] != types[c]
    ]
    at = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(_cell(row[i]) for i in at) for row in cursor.fetchall())
    total = sum(mine.values())
    print(f"{name}: {total} rows, {spent:.2f}s", flush=True)
    if wrong:
        return f"types {wrong}"
    if mine != theirs:
        only_mine = list((mine - theirs).items())[:3]
        only_theirs = list((theirs - mine).items())[:3]
        return f"{total} vs {sum(theirs.values())} rows; columns {columns}; spark only {only_mine}; oracle only {only_theirs}"
    return "" if total else "no rows"


def main() -> None:
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from fleetspark.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in names or queries:
        try:
            if name in oracle:
                problem = compare(spark, con, name, queries[name], oracle[name], sf_dir)
            else:
                problem = "" if queries[name](spark, sf_dir).count() else "no rows"
                print(f"{name}: rows only")
        except Exception as error:  # noqa: BLE001 - a report over all queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            bad += 1
            print(f"  DIFF {name}: {problem}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
