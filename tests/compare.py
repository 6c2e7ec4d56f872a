"""Run registered queries against their SQL and report differences.

    python tests/compare.py <folder> [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if value is not None and type(value).__name__ == "Decimal":
        return repr(float(value))
    return repr(value)


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool"}


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns, types of value and rows, else what differs."""
    con.execute(f"CREATE OR REPLACE VIEW compared AS {sql}")  # the statement has to work as a view
    result = con.execute("SELECT * FROM compared")
    names = [d[0] for d in result.description]
    kinds = {d[0]: DUCK.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = canonical(names, result.fetchall())
    ours = canonical(df.columns, df.collect())
    ours_kinds = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours_kinds != kinds:
        return f"types {[(k, v, kinds[k]) for k, v in ours_kinds.items() if kinds[k] != v]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours[1])} rows differ, first {wrong[0]} ({ours[0]})"
    return None


def main() -> int:
    from weekwise.plans.oracle import ORACLE
    from weekwise.plans.registry import QUERIES
    from weekwise.session import build

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build(master=os.environ.get("COMPARE_MASTER", "local[8]"), shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = difference(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main())
