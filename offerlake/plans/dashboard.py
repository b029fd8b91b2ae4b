"""One row on the whole system: registry, listings, published offers, the latest run and the matching backlog."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.plans.runs import run_counters

PROVISIONAL = "catalog_provisional"
BACKLOG = ("pending_match", "needs_review")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def registry_counts(stores: DataFrame) -> DataFrame:
    return stores.agg(F.count(F.lit(1)).alias("registry_stores"), F.count_if("active").alias("active_stores"))


def listing_counts(listings: DataFrame) -> DataFrame:
    """Stores and mappings of active listings, and how many have a direct or a verified URL."""
    return listings.filter("active").agg(
        F.count_distinct("store_id").alias("connected_stores"),
        F.count(F.lit(1)).alias("active_mappings"),
        F.count_if(_filled("direct_product_url")).alias("mappings_with_direct_url"),
        F.count_if(F.col("direct_url_status") == "verified").alias("verified_direct_urls"),
    )


def offer_counts(offers: DataFrame) -> DataFrame:
    return offers.agg(
        F.count(F.lit(1)).alias("visible_cash_offers"),
        F.count_distinct("store_id").alias("visible_priced_stores"),
        F.count_distinct("variant_id").alias("visible_priced_products"),
        F.max("observed_at").alias("latest_cash_update"),
    )


def backlog_counts(candidates: DataFrame) -> DataFrame:
    """Shape of the backlog: open candidates by state, by the evidence they carry, and their stores."""
    pending, waiting = F.col("status") == "pending_match", F.col("status").isin(*BACKLOG)
    return candidates.agg(
        F.count(F.lit(1)).alias("discovery_candidates"),
        F.count_if(waiting).alias("review_candidates"),
        F.count_if(pending).alias("pending_match_candidates"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review_candidates"),
        F.count_if(pending & _filled("brand")).alias("pending_match_with_brand"),
        F.count_if(pending & ~_filled("brand")).alias("pending_match_without_brand"),
        F.count_if(waiting & _filled("gtin")).alias("review_with_gtin"),
        F.count_if(waiting & _filled("sku")).alias("review_with_sku"),
        F.count_distinct(F.when(waiting, F.col("store_id"))).alias("review_distinct_stores"),
    )


def latest_run(tasks: DataFrame) -> DataFrame:
    """Counters of the newest run with its tasks per state and its errors per code, both as maps (enumerations, so small)."""
    newest = tasks.agg(F.max("run_id").alias("run_id"))
    rows = tasks.join(newest, "run_id")

    def counted(column: str, name: str) -> DataFrame:
        counts = rows.filter(F.col(column).isNotNull()).groupBy("run_id", column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    empty = F.create_map().cast("map<string,bigint>")
    joined = run_counters(rows).join(counted("status", "task_states"), "run_id").join(counted("error_code", "_errors"), "run_id", "left")
    return joined.select(
        F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_run_status"), F.col("queued").alias("latest_run_queued"),
        F.col("completed").alias("latest_run_completed"), F.col("succeeded").alias("latest_run_succeeded"),
        F.col("failed").alias("latest_run_failed"), F.col("task_states").alias("latest_run_task_states"),
        F.coalesce("_errors", empty).alias("latest_run_error_codes"),
    )


def system_dashboard(
    stores: DataFrame, variants: DataFrame, listings: DataFrame, offers: DataFrame, tasks: DataFrame, candidates: DataFrame
) -> DataFrame:
    """All counts as one row.  Every table is reduced to one row first; without tasks the run's columns are NULL."""
    products = variants.agg(F.count_if(F.col("source_status") != PROVISIONAL).alias("products"))
    parts = [
        products, registry_counts(stores), listing_counts(listings), offer_counts(offers), backlog_counts(candidates), latest_run(tasks),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return functools.reduce(lambda a, b: a.join(b, "_one", "left"), keyed).drop("_one")
