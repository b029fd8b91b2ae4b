"""Store quality metrics and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.functions.scores import clamp, days_before, hours_before, moment

# URL types that count as a correct destination, and task errors that mean a broken link.
PRODUCT_URL_TYPES = ("product", "product_page", "direct_product", "رابط منتج مباشر مكتشف")
BROKEN_LINK_CODES = ("http_404", "http_410", "wrong_page", "product_not_found", "invalid_destination")


def percent_or_null(part: Column, whole: Column) -> Column:
    """Share in percent, clamped to 0..100; NULL without a sample."""
    whole = whole.cast("double")
    return F.when(whole > 0, clamp(part.cast("double") / whole * 100))


def store_evidence(
    stores: DataFrame,
    listings: DataFrame,
    offers: DataFrame,
    tasks: DataFrame,
    reports: DataFrame,
    as_of: str | Column,
    tasks_as_of: str | Column | None = None,
    window_days: int = 90,
) -> DataFrame:
    """One row of counts per store; each input is aggregated by store before any join."""
    at = moment(as_of)
    tasks_at = at if tasks_as_of is None else moment(tasks_as_of)
    direct = F.nullif("direct_product_url", F.lit("")).isNotNull()
    right_place = direct | F.lower(F.coalesce("url_type", F.lit(""))).isin(*PRODUCT_URL_TYPES)
    mapping = listings.groupBy("store_id").agg(
        F.count_if("active").alias("active_mappings"),
        F.count_if(F.col("active") & right_place).alias("correct_destinations"),
    )
    review = F.lower(F.coalesce("review_status", F.lit("")))
    stated = F.lower(F.coalesce("availability", F.lit("")))
    warranted = (
        F.nullif("warranty_type", F.lit("")).isNotNull()
        | F.nullif("warranty_provider", F.lit("")).isNotNull()
        | F.col("warranty_months").isNotNull()
    )
    cash = (
        offers.filter(F.col("cash_price").isNotNull())
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("priced_samples"),
            F.count_if((F.col("anomaly_status") == "clear") & ~review.isin("needs_review", "rejected")).alias("clean_prices"),
            F.count_if(~stated.isin("", "unknown")).alias("clear_availability"),
            F.count_if(warranted).alias("clear_warranty"),
            F.count_if(F.col("last_success_at") >= hours_before(at, 36)).alias("fresh_prices"),
            F.count_if(F.col("consecutive_failures") >= 3).alias("failing_links"),
        )
    )
    health = (
        tasks.filter(F.col("finished_at") >= days_before(tasks_at, window_days))
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("task_samples"),
            F.count_if(F.col("status") == "success").alias("successful_tasks"),
            F.count_if(F.col("error_code").isin(*BROKEN_LINK_CODES)).alias("broken_tasks"),
        )
    )
    acted = F.col("status").isin("confirmed", "resolved")
    quick = (F.col("status") == "resolved") & (F.col("resolved_at") <= F.col("created_at") + F.expr("INTERVAL '72' HOUR"))
    complaints = (
        reports.filter(F.col("created_at") >= days_before(at, window_days))
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("report_count"),
            F.count_if(acted).alias("actionable_reports"),
            F.count_if(quick).alias("resolved_within_72h"),
            F.count_if((F.col("report_type") == "broken_link") & acted).alias("confirmed_broken_links"),
        )
    )
    parts = [mapping, cash, health, complaints]
    counts = [c for p in parts for c in p.columns if c != "store_id"]
    rows = reduce(lambda left, part: left.join(part, "store_id", "left"), parts, stores.select("store_id"))
    return rows.fillna(0, counts)


def store_quality(
    stores: DataFrame,
    listings: DataFrame,
    offers: DataFrame,
    tasks: DataFrame,
    reports: DataFrame,
    as_of: str | Column,
    tasks_as_of: str | Column | None = None,
) -> DataFrame:
    """Separate evidence-based indicators per store; without a sample an indicator is NULL."""
    e = store_evidence(stores, listings, offers, tasks, reports, as_of, tasks_as_of)
    priced, mappings, samples = F.col("priced_samples"), F.col("active_mappings"), F.col("task_samples")
    broken = F.col("failing_links") + F.col("broken_tasks") + F.col("confirmed_broken_links")
    links = mappings + samples
    return e.withColumns(
        {
            "price_accuracy_score": percent_or_null(F.col("clean_prices"), priced),
            "update_regularity_score": percent_or_null(
                F.col("fresh_prices") * 0.55 + F.col("successful_tasks") * 0.45, priced * 0.55 + samples * 0.45
            ),
            "availability_clarity_score": percent_or_null(F.col("clear_availability"), priced),
            "warranty_clarity_score": percent_or_null(F.col("clear_warranty"), priced),
            "correct_destination_score": percent_or_null(F.col("correct_destinations"), mappings),
            "broken_link_rate": F.when(
                links > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), broken.cast("double") / links)), 4)
            ),
            "complaint_response_score": percent_or_null(F.col("resolved_within_72h"), F.col("actionable_reports")),
            "sample_size": F.greatest(priced, mappings, samples, F.col("report_count")),
            "calculated_at": moment(as_of),
        }
    )


def refresh_stale(metrics: DataFrame, fresh: DataFrame, as_of: str | Column, hours: int = 6) -> DataFrame:
    """Stored metrics younger than ``hours`` stay; other stores take their recalculated row."""
    kept = metrics.filter(F.col("calculated_at") >= hours_before(moment(as_of), hours))
    return kept.unionByName(fresh.join(kept.select("store_id"), "store_id", "left_anti"))


def refreshed_store_quality(
    metrics: DataFrame,
    stores: DataFrame,
    listings: DataFrame,
    offers: DataFrame,
    tasks: DataFrame,
    reports: DataFrame,
    as_of: str | Column,
    tasks_as_of: str | Column | None = None,
    hours: int = 6,
) -> DataFrame:
    """Stored metrics, those older than ``hours`` and those missing calculated again.

    Every input is cut to the stale stores before it is grouped, so the work
    follows the stores that are due.  Stored stores that are gone are dropped.
    """
    young = metrics.filter(F.col("calculated_at") >= hours_before(moment(as_of), hours))
    due = stores.join(young.select("store_id"), "store_id", "left_anti")
    stale = due.select("store_id")
    only = lambda df: df.join(stale, "store_id", "left_semi")
    again = store_quality(due, only(listings), only(offers), only(tasks), only(reports), as_of, tasks_as_of)
    kept = young.join(stores.select("store_id"), "store_id", "left_semi")
    return kept.unionByName(again.select(*metrics.columns))


def count_totals(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """One row ``(metric, value)`` per named, optionally filtered, table count."""
    rows = [
        (df if condition is None else df.filter(condition)).agg(
            F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value")
        )
        for name, (df, condition) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def quality_summary(
    variants: DataFrame, stores: DataFrame, listings: DataFrame, offers: DataFrame, plans: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row of totals; each table is read once and reduced to one row before they meet."""
    weak = F.lower(F.coalesce("match_confidence", F.lit(""))).isin("low", "medium", "ambiguous")
    rows = [
        variants.agg(
            F.count_distinct(F.when(F.col("active"), F.col("product_id"))).alias("products"),
            F.count_if("active").alias("variants"),
            F.count_if(F.col("source_status") == "catalog_provisional").alias("provisional_variants"),
        ),
        stores.agg(F.count_if("active").alias("active_stores")),
        listings.agg(
            F.count_if("active").alias("active_mappings"), F.count_if(F.col("active") & weak).alias("weak_mappings")
        ),
        offers.agg(
            F.count_if(F.col("active") & F.col("cash_price").isNotNull()).alias("cash_offers"),
            F.max("last_success_at").alias("latest_cash_update"),
        ),
        plans.agg(
            F.count_if("active").alias("installment_plans"), F.max("last_success_at").alias("latest_installment_update")
        ),
        reviews.agg(
            F.count_if(F.col("status") == "open").alias("open_reviews"),
            F.count_if((F.col("status") == "open") & F.col("severity").isin("high", "critical")).alias("urgent_reviews"),
        ),
    ]
    keyed = [r.withColumn("_one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, key, count)`` of rows breaking a rule; a rule is a condition every row must meet."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def parity(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of source and target tables side by side."""
    rows = [
        source[name]
        .agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("source_rows"))
        .join(target[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("target_rows")), "table_name")
        for name in source
    ]
    out = reduce(lambda a, b: a.unionByName(b), rows)
    return out.withColumn("matches", F.col("source_rows") == F.col("target_rows"))
