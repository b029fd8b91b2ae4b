"""Every registered query next to the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.sources.fixtures import AS_OF, VIEWS, DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral types: decimals as doubles, times and nested values as text."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _with_views(text: str) -> str:
    """Prefix the fixture views a text mentions (by name) as common table expressions."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bfx_\w+", body):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    moment = f"TIMESTAMP '{AS_OF}'"
    ctes = ", ".join(
        f"{n} AS ({re.sub(r'[{](\w+)[}]', lambda m: moment if m.group(1) == 'as_of' else m.group(1), VIEWS[n])})"
        for n in needed
    )
    body = text.strip().replace("{as_of}", moment)
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[len('WITH'):]}"
    return f"WITH {ctes} {body}"


def check(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is its independent twin over the same tables."""

    def register(build: Callable[[DriverTables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: plain(build(DriverTables(spark, folder)))
        MODULES[name] = build.__module__.rpartition(".")[2]
        if sql:
            ORACLES[name] = _with_views(sql)
        return build

    return register


def load_all() -> None:
    from checks import browse, catalog, decisions, dimensions, extraction, ledger, matching, runs, serving, standard, streams  # noqa: F401
