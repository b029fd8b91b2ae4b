"""Table readers and keyed sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions import numbers

SCHEMA_CASTS = {
    "number": numbers.seed_number,
    "integer": numbers.seed_integer,
    "boolean": numbers.seed_boolean,
    "timestamp": numbers.seed_timestamp,
    "text": numbers.blank_to_null,
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; filters and columns are pushed into this scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header, read as text under a fixed schema; a UTF-8 byte order mark is dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"')
    first = columns[0]
    return frame.withColumn(first, F.regexp_replace(first, "^﻿", ""))


def cast_seed(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Typed columns from text under ``{column: number|integer|boolean|timestamp|text}``."""
    return df.withColumns({name: SCHEMA_CASTS[kind](F.col(name)) for name, kind in spec.items()})


def read_product_export(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON or JSON-lines product records as one VARIANT column ``record``.

    A document may be a record, an array of records, or an object that wraps
    the array under ``records``, ``rows``, ``results`` or ``data``.  JSON lines
    are read line by line, so a large file is split; a plain document is read whole.
    """
    raw = spark.read.text(path) if lines else spark.read.text(path, wholetext=True)
    docs = raw.select(F.try_parse_json("value").alias("doc"))
    return unwrap_records(docs.filter(F.col("doc").isNotNull()))


def unwrap_records(docs: DataFrame) -> DataFrame:
    """Product records of parsed documents (column ``doc`` of type VARIANT)."""
    array = F.coalesce(
        *[F.try_variant_get("doc", f"$.{name}", "array<variant>") for name in ("records", "rows", "results", "data")],
        F.try_variant_get("doc", "$", "array<variant>"),
        F.array("doc"),
    )
    return docs.select(F.explode(array).alias("record"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "append") -> None:
    """Append-only ledger files, one folder per value of ``by`` (usually the observation date)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def export_snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write every table as CSV under ``folder`` and return the row-count manifest."""
    manifest = None
    for name, df in tables.items():
        flat = df.select(
            [
                F.to_json(f.name).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )
        flat.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        counted = df.sparkSession.read.csv(f"{folder}/{name}", header=True, multiLine=True)
        row = counted.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest
