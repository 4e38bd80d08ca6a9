"""Compare queries with their SQL twins: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kind, words in {
        "int": ("bigint", "hugeint", "integer", "int", "long", "smallint"),
        "float": ("double", "float"),
        "string": ("varchar", "string"),
        "bool": ("boolean",),
        "time": ("timestamp",),
    }.items():
        if any(name.startswith(w) for w in words):
            return kind + (":64" if name in ("bigint", "long") else "")
    return name


def compare(spark, con, name, query, sql, sf_dir):
    """Return ``(ok, message, seconds)``."""
    start = time.time()
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(_plain(r[c]) for c in columns) for r in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return bool(ours), f"{len(ours)} rows, no oracle", seconds
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: _kind(str(d[1])) for d in result.description}
    rows = result.fetchall()
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}", seconds
    mine = {n: _kind(t) for n, t in frame.dtypes}
    wrong = {n: (mine[n], types[n]) for n in columns if mine[n] != types[n]}
    order = [names.index(c) for c in columns]
    theirs = [tuple(_plain(r[i]) for i in order) for r in rows]
    a, b = Counter(ours), Counter(theirs)
    if a == b:
        note = f" TYPES {wrong}" if wrong else ""
        return not wrong, f"{len(ours)} rows{note}", seconds
    only_a, only_b = a - b, b - a
    return (
        False,
        f"{len(ours)} against {len(theirs)} rows; only ours {str(list(only_a)[:3])[:600]}; "
        f"only theirs {str(list(only_b)[:3])[:600]}; {sum(only_a.values())}/{sum(only_b.values())} differ {wrong}",
        seconds,
    )


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from corpusloom.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracle_sql(), 0
    wanted = sys.argv[2:]
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, message, seconds = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, message, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {seconds:6.2f}s {message}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
