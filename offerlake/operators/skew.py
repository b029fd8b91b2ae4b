"""Ordered per-key operations that stay spread when one key holds a large share of all rows.

Previous rows, running sums and row numbers are prefix scans over slices.  A
slice is a fixed function of the leading order column alone (so many days, or
steps of a number's logarithm), so no job has to look at the data before the
plan is built.  Whatever must cross a slice border is one row per key and slice,
made by an aggregate that is combined before the shuffle, and it takes part in
the slice's window as its first row.

The replays cut hot keys by quantiles instead: a key is hot when it has more
than ``1 / max_hot_keys`` of all rows (and more than ``min_rows``).  By
counting, at most ``max_hot_keys`` keys can be hot, so the table of slice bounds
has a fixed size limit and is the only thing broadcast here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.config import SKEW, SkewRules

SLICE = "_slice"
COLD = -1
_BOUNDS = "_bounds"
_CARRY = "_carry"


def hot_limit(df: DataFrame, keys: Sequence[str], rules: SkewRules = SKEW) -> int | None:
    """Row count above which a key of ``df`` is hot, or None when no key is (one-row probe)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    limit = max(rules.min_rows, int((size["rows"] or 0) / rules.max_hot_keys))
    return limit if (size["largest"] or 0) > limit else None


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe join condition against a table whose keys are prefixed ``_h_``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right["_h_" + k]) for k in keys])


def slice_bounds(df: DataFrame, keys: Sequence[str], lead: Column, limit: int, rules: SkewRules = SKEW) -> DataFrame:
    """Approximate quantiles of ``lead`` per hot key (at most ``max_hot_keys`` rows)."""
    steps = [i / rules.slices for i in range(1, rules.slices)] or [0.5]
    counts = df.groupBy(*[F.col(k).alias("_h_" + k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > limit).drop("_n")
    rows = df.join(F.broadcast(hot), same_keys(df, hot, keys), "inner")
    edges = F.percentile_approx(lead, F.array(*[F.lit(s) for s in steps]), F.lit(10 * rules.slices))
    return rows.groupBy(*["_h_" + k for k in keys]).agg(F.array_distinct(edges).alias(_BOUNDS))


def slice_number(lead: Column) -> Column:
    """Slice of a row joined with its key's bounds; ``COLD`` without bounds."""
    return F.when(F.col(_BOUNDS).isNull(), COLD).otherwise(F.size(F.filter(_BOUNDS, lambda b: b < lead)))


def with_slices(df: DataFrame, bounds: DataFrame, keys: Sequence[str], lead: Column, how: str = "left") -> DataFrame:
    """Add ``_slice``; ``how='inner'`` keeps the rows of hot keys only."""
    joined = df.join(F.broadcast(bounds), same_keys(df, bounds, keys), how)
    return joined.withColumn(SLICE, slice_number(lead)).drop(_BOUNDS, *["_h_" + k for k in keys])


def fixed_slice(df: DataFrame, lead: Column, rules: SkewRules = SKEW) -> Column:
    """Slice number of ``lead``, a time or a number, that never falls as ``lead`` rises; nulls come first."""
    kind = df.select(lead.alias("lead")).schema["lead"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        day = F.unix_date(lead.cast("date"))
        number = F.floor(day / rules.slice_days)
    else:
        x = lead.cast("double")
        number = F.signum(x) * F.floor(F.log2(1 + F.abs(x)) * rules.slices_per_octave)
    return F.coalesce(number.cast("bigint"), F.lit(-(2**62))).alias(SLICE)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    rules: SkewRules = SKEW,
) -> DataFrame:
    """Add values of the previous row of the same key (``order`` ascending, its first column leads)."""
    own = {n: f"_own_{n}" for n in values}
    rows = df.withColumns({own[n]: v for n, v in values.items()} | {SLICE: fixed_slice(df, F.col(order[0]), rules)})
    last = F.max_by(F.struct(*own.values()), F.struct(*order)).alias("_last")
    borders = rows.groupBy(*keys, SLICE).agg(last)
    carried = borders.withColumn("_to", F.lead(SLICE).over(Window.partitionBy(*keys).orderBy(SLICE)))
    carried = carried.filter("_to IS NOT NULL").select(*keys, "_last.*", F.col("_to").alias(SLICE), F.lit(0).alias(_CARRY))
    both = rows.withColumn(_CARRY, F.lit(1)).unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, SLICE).orderBy(_CARRY, *order)
    out = both.select(*df.columns, _CARRY, *[F.lag(own[n]).over(frame).alias(n) for n in values])
    return out.filter(F.col(_CARRY) == 1).drop(_CARRY)


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    lead: Column,
    amount: Column,
    alias: str,
    rules: SkewRules = SKEW,
) -> DataFrame:
    """Inclusive running sum per key; ``lead`` must rise with ``order``."""
    rows = df.withColumns({"_amount": amount, SLICE: fixed_slice(df, lead, rules)})
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, SLICE).agg(F.sum("_amount").alias("_sum"))
    carried = sums.withColumn("_amount", F.sum("_sum").over(before)).filter("_amount IS NOT NULL").select(*keys, SLICE, "_amount", F.lit(0).alias(_CARRY))
    both = rows.withColumn(_CARRY, F.lit(1)).unionByName(carried, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, SLICE).orderBy(_CARRY, *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(alias, F.sum("_amount").over(frame)).filter(F.col(_CARRY) == 1).drop("_amount", SLICE, _CARRY)


def with_row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    orders: Mapping[str, tuple[Sequence[Column | str], Column]],
    rules: SkewRules = SKEW,
) -> DataFrame:
    """Number every row of each key under several orders: ``{alias: (order, lead)}``; ``lead`` is numeric and rises with its order.

    The rows before each slice are counted for all orders at once, so ``df`` is
    read twice however many orders there are.
    """
    slices = {alias: f"{SLICE}_{alias}" for alias in orders}
    rows = df.withColumns({slices[a]: fixed_slice(df, lead, rules) for a, (_, lead) in orders.items()})
    each = F.array(*[F.struct(F.lit(a).alias("_of"), F.col(s).alias(SLICE)) for a, s in slices.items()])
    counts = rows.select(*keys, F.inline(each)).groupBy(*keys, "_of", SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys, "_of").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_n").over(before)).filter("_before IS NOT NULL").select(
        *keys, F.lit(0).alias(_CARRY), *[F.when(F.col("_of") == a, F.col(c)).alias(n) for a, s in slices.items() for c, n in ((SLICE, s), ("_before", f"_n_{a}"))]
    )
    # a border row of another order has no slice here, and so no row beside it
    both = rows.withColumns({_CARRY: F.lit(1)} | {f"_n_{a}": F.lit(1).cast("bigint") for a in orders}).unionByName(carried, allowMissingColumns=True)
    for alias, (order, _) in orders.items():
        frame = Window.partitionBy(*keys, slices[alias]).orderBy(_CARRY, *order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(alias, F.sum(f"_n_{alias}").over(frame).cast("int"))
    return both.filter(F.col(_CARRY) == 1).drop(_CARRY, *slices.values(), *[f"_n_{a}" for a in orders])


def with_row_numbers_by_size(
    df: DataFrame,
    keys: Sequence[str],
    orders: Mapping[str, tuple[Sequence[Column | str], Column]],
    size: str,
    rules: SkewRules = SKEW,
) -> DataFrame:
    """``with_row_numbers`` for rows that carry the number of rows of their key (column ``size``).

    Keys of at most ``min_rows`` rows are numbered by plain windows, which share one shuffle; only larger ones are cut.
    """
    few = F.coalesce(F.col(size) <= rules.min_rows, F.lit(True))
    plain = df.filter(few)
    for alias, (order, _) in orders.items():
        plain = plain.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return plain.unionByName(with_row_numbers(df.filter(~few), keys, orders, rules))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate (combined before the shuffle).

    All columns travel in it whichever of them are read later, so several readers of one result share its shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if rest and any(isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) for c in rest):  # these have no order
        best = F.max_by(F.struct(*order, *rest), F.struct(*order))
    else:
        best = F.max(F.struct(*order, *rest))
    picked = df.groupBy(*keys).agg(best.alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def earliest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` per key, as an aggregate (combined before the shuffle)."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, alias: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark cuts to ``k`` per task before the shuffle (WindowGroupLimit)."""
    numbered = df.withColumn(alias, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(alias) <= k)
