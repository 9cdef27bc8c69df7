"""Compare queries with their SQL in DuckDB: python tests/check.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value: object) -> object:
    """A value in a form both engines agree on."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(rows: list, names: list[str]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


def type_of(name: object) -> str:
    """A rough type family, for spotting int against bigint."""
    return {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
            "TIMESTAMP": "timestamp_ntz", "HUGEINT": "hugeint"}.get(str(name), str(name).lower())


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = rows_of(df.collect(), df.columns)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    rel = con.sql(sql)
    want = rows_of(rel.fetchall(), rel.columns)
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    types = {n: type_of(t) for n, t in zip(rel.columns, rel.types)}
    odd = {n: (t, types[n]) for n, t in df.dtypes if t != types[n]}
    if got != want:
        only_got, only_want = set(got) - set(want), set(want) - set(got)
        return False, f"{len(got)} against {len(want)} rows\n  spark {sorted(only_got)[:2]}\n  sql   {sorted(only_want)[:2]}"
    return True, f"{len(got)} rows{'  types ' + str(odd) if odd else ''}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from repoloom.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - begin:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
