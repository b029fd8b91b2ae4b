"""Run registered queries against their SQL twins: python verify_checks.py [folder] [name ...]."""

from __future__ import annotations

import importlib
import math
import sys
import time
import traceback

import duckdb

import checks
from offerlake.session import local_session

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _cell(value: object) -> str:
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return "nan"
        return f"{number:.0f}.000000" if number == int(number) else f"{number:.6f}"
    return str(value)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark_df, con, sql: str) -> str:
    columns = sorted(spark_df.columns)
    mine = sorted(tuple(_cell(r[c]) for c in columns) for r in spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns differ: {columns} / {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(_cell(r[i]) for i in at) for r in cursor.fetchall())
    if mine == theirs:
        return f"ok {len(mine)}"
    only_mine = sorted(set(mine) - set(theirs))[:3]
    only_theirs = sorted(set(theirs) - set(mine))[:3]
    return f"DIFFER rows {len(mine)} / {len(theirs)}\n   {columns}\n   spark {only_mine}\n   sql   {only_theirs}"


def main() -> None:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    modules = [a[1:] for a in args if a.startswith("@")]
    wanted = [a for a in args if not a.startswith("@")]
    if modules:
        for m in modules:
            importlib.import_module(f"checks.{m}")
    else:
        checks.load_all()
    spark, con = local_session("8"), database(folder)
    bad = 0
    for name, build in checks.QUERIES.items():
        if (wanted and name not in wanted) or (modules and not wanted and checks.MODULES[name] not in modules):
            continue
        began = time.time()
        try:
            df = build(spark, folder)
            verdict = compare(df, con, checks.ORACLES[name]) if name in checks.ORACLES else f"rows {df.count()}"
        except Exception as problem:
            verdict = "ERROR " + (str(problem)[:700] if wanted or modules else str(problem)[:300])
            if wanted:
                traceback.print_exc()
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:40s} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
