"""Keyed merges into projection tables, snapshot differences and set operations.

All policies are order-aware aggregates, so many versions of one key are
combined before the shuffle, and applying the same batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _known(c: str, order: Column) -> Column:
    return F.when(F.col(c).isNotNull(), order)


def merge_latest(
    current: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    order: str,
    policies: Mapping[str, str | tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """Merge ``new`` into ``current``; without a policy a column follows the newest row.

    Policies per column: ``keep_non_null`` (newest known value), ``first`` (oldest
    known value), ``longest`` (longest text), ``map_concat`` (newest entry per map
    key), ``("sticky", states)`` (a listed state is never left).  Older rows
    arriving late never overwrite newer ones.
    """
    policies = policies or {}
    both = current.unionByName(new, allowMissingColumns=True)
    at = F.col(order)
    plain = [c for c in both.columns if c not in keys and c not in policies and c != order]
    aggregates = [F.max(order).alias(order)]
    if plain:
        aggregates.append(F.max_by(F.struct(*plain), at).alias("_latest"))
    maps = [c for c, p in policies.items() if p == "map_concat"]
    for name, policy in policies.items():
        c = F.col(name)
        if policy == "keep_non_null":
            aggregates.append(F.max_by(c, _known(name, at)).alias(name))
        elif policy == "first":
            aggregates.append(F.min_by(c, _known(name, at)).alias(name))
        elif policy == "longest":
            aggregates.append(F.max_by(c, F.when(c.isNotNull(), F.struct(F.length(c), -F.unix_micros(at.cast("timestamp")))) if isinstance(both.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)) else F.when(c.isNotNull(), F.struct(F.length(c), -at))).alias(name))
        elif policy == "map_concat":
            continue
        else:
            _, states = policy
            sticky = F.max_by(c, F.when(c.isin(*states), at))
            aggregates.append(F.coalesce(sticky, F.max_by(c, _known(name, at))).alias(name))
    merged = both.groupBy(*keys).agg(*aggregates)
    if plain:
        merged = merged.select("*", *[F.col("_latest")[c].alias(c) for c in plain]).drop("_latest")
    for name in maps:
        entries = both.select(*keys, order, F.explode(name).alias("_k", "_v"))
        newest = entries.groupBy(*keys, "_k").agg(F.max_by("_v", at).alias("_v"))
        folded = newest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(name))
        merged = merged.join(folded, list(keys), "left")
    return merged.select(*both.columns)


def audit_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(entity_id, action, before_data, after_data)`` of two snapshots; unchanged rows are left out."""
    shape = lambda df, alias: df.select(F.col(key), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(alias))
    both = shape(old, "before_data").join(shape(new, "after_data"), key, "full_outer")
    action = (
        F.when(F.col("before_data").isNull(), "insert")
        .when(F.col("after_data").isNull(), "delete")
        .when(F.col("before_data") != F.col("after_data"), "update")
    )
    rows = both.select(F.col(key).cast("string").alias("entity_id"), action.alias("action"), "before_data", "after_data")
    return rows.filter(F.col("action").isNotNull())


def plan_changes(plans: DataFrame, current: DataFrame) -> DataFrame:
    """first_seen, plan_changed or NULL per plan of a batch, over the nine terms of a plan."""
    terms = [
        "months", "periodic_payment", "down_payment", "admin_fees", "total_published", "total_calculated", "interest_free",
        "starting_from_only", "ends_at",
    ]
    state = current.select("plan_key", F.struct(*terms).alias("_before"))
    rows = plans.join(state, "plan_key", "left")
    label = F.when(F.col("_before").isNull(), "first_seen").when(~F.struct(*terms).eqNullSafe(F.col("_before")), "plan_changed")
    return rows.withColumn("change_type", label).drop("_before")


def mark_unseen(plans: DataFrame, scan: DataFrame, as_of: Column) -> DataFrame:
    """Active plans missing from the latest scan: one more failure, and ended plans become inactive."""
    missing = plans.filter("active").join(scan.select("plan_key").distinct(), "plan_key", "left_anti")
    return missing.withColumns(
        {
            "extraction_status": F.lit("not_seen_in_latest_scan"),
            "consecutive_failures": F.coalesce("consecutive_failures", F.lit(0)) + 1,
            "active": ~F.coalesce(F.col("ends_at") < as_of, F.lit(False)),
        }
    )


def without(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    return rows.join(keys, list(on), "left_anti")


def restrict_to_failed(rows: DataFrame, tasks: DataFrame, url_columns: Sequence[str]) -> DataFrame:
    """Rows whose store failed on any of their URLs."""
    failed = tasks.filter(F.col("status") == "failed").select("store_id", F.col("source_url").alias("_url")).distinct()
    urls = rows.withColumn("_url", F.explode(F.array_distinct(F.array_compact(F.array(*url_columns)))))
    hit = urls.join(failed, ["store_id", "_url"], "left_semi").select("mapping_id").distinct()
    return rows.join(hit, "mapping_id", "left_semi")


def resolve_alias(facts: DataFrame, aliases: DataFrame, column: str = "variant_id") -> DataFrame:
    """Rewrite alias ids to their canonical id."""
    known = aliases.select(F.col("alias_variant_id").alias(column), F.col("canonical_variant_id").alias("_to"))
    return facts.join(known, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def union_candidates(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def set_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b.select(*a.columns))


def set_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))
