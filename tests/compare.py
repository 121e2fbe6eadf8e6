"""Compare every registered query with its DuckDB SQL on given tables.

    python tests/compare.py [sf_dir] [name,name,...]
"""

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return "null" if v is None else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    ours, theirs = canonical(df.columns, df.collect()), canonical(names, cursor.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"\n   spark  {a}\n   duckdb {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark, con, bad = local_session(), connect(sf_dir), 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, query, sqls[name]) if name in sqls else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:300]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {time.time() - start:6.1f}s {name} {found or ''}", flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
