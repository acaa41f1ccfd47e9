"""Run registered queries next to their SQL: ``python tests/check_oracle.py [folder] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return f"{value + 0.0:.6f}"
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
}


def compare(spark, connection, folder, build, sql):
    """Empty string if both sides agree, else what differs."""
    result = build(spark, folder)
    actual = [tuple(r) for r in result.collect()]
    relation = connection.sql(sql)
    expected = relation.fetchall()
    want = {n: KINDS.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    have = dict(result.dtypes)
    if want != have:
        return f"schema: spark {have} sql {want}"
    a, b = _canonical(actual, result.columns), _canonical(expected, relation.columns)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{len(a)} rows vs {len(b)}: spark only {only_a} sql only {only_b}"[:1500]
    return ""


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from lexgrain.session import local_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, connection, folder, queries()[name], oracle_sql()[name])
            else:
                n = queries()[name](spark, folder).count()
                problem = "" if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
