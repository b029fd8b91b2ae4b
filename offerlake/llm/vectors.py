"""Vector tables as matrix blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, vector: str = "embedding", zero: bool = True, strict: bool = False) -> DataFrame:
    """``(vec_id, v)`` with ``v`` as doubles: rows without null or non-finite components, of the most frequent length.

    Null ids, null and empty vectors take no part; without ``zero``, neither do
    vectors of zeros only.  Of two equally frequent lengths the smaller one counts;
    with ``strict``, usable vectors of several lengths are an error instead.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    c = F.col(vector)
    rows = vectors.select("vec_id", c.cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0").filter(F.forall("v", finite))
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(2)
    if strict and len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths[0]['count']} of {lengths[0]['n']} components, {lengths[1]['count']} of {lengths[1]['n']}")
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``(name, ids, matrix)``: rows dealt evenly into blocks of about ``size``, the ids as int64 and vectors as float64 bytes."""
    count = max(1, -(-rows.count() // size))
    placed = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(count)).cast("int")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        matrix = np.stack(part["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({name: [part[name].iloc[0]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})

    return rows.withColumn(name, placed).groupBy(name).applyInPandas(pack, f"{name} int, ids binary, matrix binary")


def ids_of(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.int64)


def matrix_of(cell: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cell, np.float64).reshape(rows, -1)


def best_of(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query, with their ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)
