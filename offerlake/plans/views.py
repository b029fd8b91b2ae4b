"""Serving views over the current projections.  Every view takes an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.config import PRICING, PricingRules
from offerlake.functions.scores import freshness, minutes_before, moment

# Spellings of a rejected review and of stores that publish no prices.
REJECTED = ("rejected", "مرفوض")
CATALOG_ONLY = ("catalog_only", "نشط/كتالوج فقط", "كتالوج فقط")
NO_ONLINE_SALE = ("no", "لا")

VARIANT_TEXT = ["canonical_name", "section", "product_type", "brand", "model", "variant_name"]


def enrich(offers: DataFrame, variants: DataFrame, stores: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Offers with their variant, store and (optionally) listing; dimension joins are left to Catalyst to size."""
    out = offers.join(variants, "variant_id").join(stores, "store_id")
    return out if listings is None else out.join(listings, ["mapping_id"])


def active_mappings(listings: DataFrame, variants: DataFrame, stores: DataFrame, connectors: DataFrame) -> DataFrame:
    """Listings that are scraped: active listing, variant and store with an enabled connector."""
    return (
        listings.filter("active")
        .join(variants.filter("active").select("variant_id", "canonical_name"), "variant_id")
        .join(stores.filter("active").select("store_id", "store_name"), "store_id")
        .join(connectors.filter("enabled").select("store_id", "requests_per_minute"), "store_id")
    )


def comparable_total() -> Column:
    """Delivered price; NULL while shipping is unknown."""
    cash, shipping = F.col("cash_price"), F.col("shipping_cost")
    return F.coalesce(
        F.col("total_price"), F.when(F.col("free_shipping"), cash), cash + shipping
    )


def final_cost() -> Column:
    """Cost with unknown parts counted as zero, never below zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = F.col("cash_price") + zero("shipping_cost") + zero("mandatory_fees") + zero("card_fees")
    return F.greatest(parts - zero("coupon_discount"), F.lit(0))


def _usable(at: Column, rules: PricingRules) -> Column:
    """Seen recently, extracted, not out of stock, not rejected; never NULL."""
    return (
        F.coalesce(F.col("last_success_at") >= minutes_before(at, rules.stale_minutes), F.lit(False))
        & (F.col("extraction_status") == "success")
        & (F.coalesce(F.col("availability"), F.lit("unknown")) != "out_of_stock")
        & ~F.coalesce(F.col("review_status"), F.lit("")).isin(*REJECTED)
    )


def public_cash_offers(
    offers: DataFrame, variants: DataFrame, stores: DataFrame, as_of: str | Column, rules: PricingRules = PRICING
) -> DataFrame:
    """Visible cash offers with freshness, eligibility, shipping knowledge and delivered total."""
    at = moment(as_of)
    visible = offers.filter(F.col("active") & (F.col("cash_price") >= rules.floor) & (F.col("anomaly_status") != "blocked"))
    named = visible.join(variants.select("variant_id", *VARIANT_TEXT), "variant_id").join(
        stores.select("store_id", "store_name", F.col("base_url").alias("store_base_url")), "store_id"
    )
    known = (
        F.coalesce(F.col("free_shipping"), F.lit(False)) | F.col("shipping_cost").isNotNull() | F.col("total_price").isNotNull()
    )
    eligible = _usable(at, rules) & (F.col("currency") == rules.currency) & (F.col("anomaly_status") == "clear")
    return named.withColumns(
        {
            "computed_freshness": freshness(F.col("last_success_at"), at, rules),
            "eligible_for_ranking": eligible,
            "shipping_cost_known": known,
            "comparable_total": comparable_total(),
        }
    )


def _plan_eligible(at: Column, rules: PricingRules) -> Column:
    total = F.coalesce("total_published", "total_calculated")
    return (
        _usable(at, rules)
        & (F.col("periodic_payment").isNotNull() | total.isNotNull())
        & valid_at(at)
        & ~F.col("starting_from_only")
        & (F.col("completeness") == "complete")
        & F.coalesce(F.col("months") > 0, F.lit(False))
        & F.col("provider_name").isNotNull()
    )


def valid_at(at: Column) -> Column:
    """Inside the plan's validity interval; an open end is unbounded."""
    started = F.coalesce(F.col("starts_at") <= at, F.lit(True))
    return started & F.coalesce(F.col("ends_at") >= at, F.lit(True))


def valid_plans(plans: DataFrame, as_of: str | Column) -> DataFrame:
    return plans.filter(valid_at(moment(as_of)))


def _with_cash_state(plans: DataFrame, offers: DataFrame) -> DataFrame:
    """Plans with the availability and currency of the cash offer they belong to."""
    state = offers.select(F.col("offer_key").alias("cash_offer_key"), "availability", "currency")
    return plans.filter("active").join(state, "cash_offer_key", "left")


def public_installment_offers(
    plans: DataFrame,
    variants: DataFrame,
    stores: DataFrame,
    offers: DataFrame,
    as_of: str | Column,
    rules: PricingRules = PRICING,
) -> DataFrame:
    """Visible instalment plans with freshness, normalised total and eligibility."""
    at = moment(as_of)
    rows = (
        _with_cash_state(plans, offers)
        .join(variants.select("variant_id", *VARIANT_TEXT), "variant_id")
        .join(stores.select("store_id", "store_name"), "store_id")
    )
    return rows.withColumns(
        {
            "computed_freshness": freshness(F.col("last_success_at"), at, rules),
            "normalized_total": F.coalesce("total_published", "total_calculated"),
            "eligible_for_ranking": _plan_eligible(at, rules),
        }
    ).withColumnRenamed("availability", "cash_availability")


def offer_summary(
    variants: DataFrame, offers: DataFrame, plans: DataFrame, as_of: str | Column, rules: PricingRules = PRICING
) -> DataFrame:
    """Lowest prices and offer counts per variant (no floor, no anomaly filter: an inventory view).

    Both rollups aggregate before the join, so the joins see one row per variant.
    """
    at = moment(as_of)
    cash = (
        offers.filter(F.col("cash_price").isNotNull() & F.col("active") & (F.col("currency") == rules.currency) & _usable(at, rules))
        .groupBy("variant_id")
        .agg(
            F.min("cash_price").alias("lowest_cash_price"),
            F.min(comparable_total()).alias("lowest_delivered_total"),
            F.count_distinct("offer_key").alias("cash_offer_count"),
        )
    )
    instalment = (
        _with_cash_state(plans, offers)
        .filter(_plan_eligible(at, rules))
        .groupBy("variant_id")
        .agg(
            F.count_distinct("plan_key").alias("installment_plan_count"),
            F.min("periodic_payment").alias("lowest_periodic_payment"),
        )
    )
    counts = ["cash_offer_count", "installment_plan_count"]
    return (
        variants.select("variant_id", *VARIANT_TEXT)
        .join(cash, "variant_id", "left")
        .join(instalment, "variant_id", "left")
        .fillna(0, counts)
        .withColumn("lowest_cash_total", F.col("lowest_delivered_total"))
    )


def product_rollup(variants: DataFrame, summary: DataFrame) -> DataFrame:
    """Variant summary rolled up to products: lowest of the lows, sum of the counts."""
    active = variants.filter(F.col("active") & F.col("product_id").isNotNull()).select("variant_id", "product_id")
    return (
        active.join(summary, "variant_id", "left")
        .groupBy("product_id")
        .agg(
            F.min("lowest_cash_price").alias("lowest_cash_price"),
            F.min("lowest_delivered_total").alias("lowest_delivered_total"),
            F.sum(F.coalesce("cash_offer_count", F.lit(0))).alias("cash_offer_count"),
            F.sum(F.coalesce("installment_plan_count", F.lit(0))).alias("installment_plan_count"),
        )
    )


def public_products(products: DataFrame, variants: DataFrame, listings: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per product with variant, store and offer counts."""
    active = variants.filter(F.col("active") & F.col("product_id").isNotNull()).select("variant_id", "product_id")
    variant_counts = active.groupBy("product_id").agg(F.count(F.lit(1)).alias("variant_count"))
    stores = (
        active.join(listings.filter("active").select("variant_id", "store_id"), "variant_id")
        .groupBy("product_id")
        .agg(F.count_distinct("store_id").alias("connected_store_count"))
    )
    counts = ["variant_count", "connected_store_count", "cash_offer_count", "installment_plan_count"]
    return (
        products.join(variant_counts, "product_id", "left")
        .join(stores, "product_id", "left")
        .join(product_rollup(variants, summary), "product_id", "left")
        .fillna(0, counts)
    )


def cash_decision_inputs(
    offers: DataFrame, stores: DataFrame, listings: DataFrame, quality: DataFrame | None = None, on: str = "mapping_id"
) -> DataFrame:
    """Priced offers that are not blocked, with their cost, listing evidence and store quality.

    ``on`` names the key that offers and listings share; where both are already
    grouped by it (``offer_key`` of a projection), the join needs no shuffle.
    Stores and their quality have one row per registered store and are broadcast, or every offer would be shuffled by its store.
    """
    rows = (
        offers.filter(F.col("active") & F.col("cash_price").isNotNull() & (F.col("anomaly_status") != "blocked"))
        .join(F.broadcast(stores.select("store_id", "store_name")), "store_id")
        .join(listings.select(on, "store_sku", "direct_url_status"), on)
        .withColumn("final_cost", final_cost())
    )
    return rows if quality is None else rows.join(F.broadcast(quality), "store_id", "left")


def installment_cost() -> Column:
    """Published or calculated total, else the sum of the parts of a complete plan."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = F.col("periodic_payment") * F.col("months")
    for fee in ("down_payment", "admin_fees", "processing_fees", "insurance_fees", "other_fees", "card_fees", "shipping_cost"):
        parts = parts + zero(fee)
    summed = F.when(
        F.col("periodic_payment").isNotNull() & F.col("months").isNotNull(),
        F.greatest(parts - zero("coupon_discount"), F.lit(0)),
    )
    return F.coalesce(F.col("total_published"), F.col("total_calculated"), summed)


def installment_decision_inputs(plans: DataFrame, stores: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    rows = (
        plans.filter(F.col("active") & (F.col("anomaly_status") != "blocked"))
        .join(stores.select("store_id", "store_name"), "store_id")
        .withColumn("final_installment_cost", installment_cost())
    )
    return rows if quality is None else rows.join(quality, "store_id", "left")


def primary_urls(listings: DataFrame) -> DataFrame:
    """The URL a listing is served under, with its verification status."""
    url = F.coalesce(F.nullif("direct_product_url", F.lit("")), F.col("source_url"))
    status = (
        F.when(F.col("direct_url_status") == "verified", "verified")
        .when(F.col("direct_url_status") == "failed", "broken")
        .otherwise("unverified")
    )
    rows = listings.select("mapping_id", url.alias("url"), status.alias("url_status"))
    return rows.filter(F.trim("url") != "")


def effective_urls(listings: DataFrame) -> DataFrame:
    """The URL a listing is scraped from: verified direct, else preferred direct, else source."""
    direct = F.nullif(F.trim("direct_product_url"), F.lit(""))
    verified = F.col("direct_url_status") == "verified"
    preferred = F.col("prefer_direct") if "prefer_direct" in listings.columns else F.lit(False)
    use_direct = direct.isNotNull() & (verified | F.coalesce(preferred, F.lit(False)))
    return listings.withColumns(
        {
            "effective_source_url": F.when(use_direct, direct).otherwise(F.col("source_url")),
            "effective_url_type": F.when(use_direct, "direct_product").otherwise(F.col("url_type")),
        }
    )


def public_offer_table(offers: DataFrame, stores: DataFrame, listings: DataFrame) -> DataFrame:
    """Comparison table: visible offers of active stores and listings, with their primary URL."""
    urls = primary_urls(listings).select("mapping_id", F.col("url").alias("product_url"))
    return (
        offers.filter(F.col("active") & F.col("cash_price").isNotNull() & (F.col("anomaly_status") != "blocked"))
        .join(stores.filter("active").select("store_id", "store_name"), "store_id")
        .join(listings.filter("active").select("mapping_id"), "mapping_id")
        .join(urls, "mapping_id", "left")
        .withColumns(
            {
                "final_cost": final_cost(),
                "visible": F.col("anomaly_status") != "blocked",
                "rankable": (F.col("anomaly_status") == "clear") & (F.col("match_quality_score") >= 80),
            }
        )
    )


def link_coverage(stores: DataFrame, listings: DataFrame, imports: DataFrame) -> DataFrame:
    """Direct-link coverage per store; the percentage is NULL without active listings."""
    on = F.col("active")
    has_direct = F.nullif("direct_product_url", F.lit("")).isNotNull()
    per_store = listings.groupBy("store_id").agg(
        F.count_if(on).alias("active_mappings"),
        F.count_if(on & has_direct).alias("mappings_with_direct_url"),
        F.count_if(on & (F.col("direct_url_status") == "verified")).alias("verified_direct_urls"),
        F.count_if(on & (F.col("direct_url_status") == "legacy_unverified")).alias("legacy_unverified_urls"),
        F.count_if(on & F.col("direct_url_status").isin("failed", "conflict")).alias("failed_or_conflicting_urls"),
        F.max("direct_url_verified_at").alias("latest_direct_url_verification"),
    )
    runs = imports.groupBy("store_id").agg(F.max("completed_at").alias("latest_catalog_import"))
    counts = [c for c in per_store.columns if c not in ("store_id", "latest_direct_url_verification")]
    percent = F.round(F.try_divide(100.0 * F.col("verified_direct_urls"), F.col("active_mappings")), 2)
    return (
        stores.select("store_id", "store_name")
        .join(per_store, "store_id", "left")
        .join(runs, "store_id", "left")
        .fillna(0, counts)
        .withColumn("verified_direct_url_percent", percent)
    )


def price_capable() -> Column:
    return (
        ~F.coalesce(F.col("registry_status"), F.lit("")).isin(*CATALOG_ONLY)
        & ~F.coalesce(F.col("public_price_status"), F.lit("")).isin(*CATALOG_ONLY)
        & ~F.coalesce(F.col("online_purchase"), F.lit("")).isin(*NO_ONLINE_SALE)
    )


def coverage_ledger(stores: DataFrame, listings: DataFrame, cash_offers: DataFrame, discovery: DataFrame) -> DataFrame:
    """Seven-stage funnel of every store, from missing connector to live price."""
    mapping = listings.groupBy("store_id").agg(
        F.count_if("active").alias("active_mappings"),
        F.count_if(F.col("active") & (F.col("direct_url_status") == "verified")).alias("verified_direct_urls"),
    )
    cash = cash_offers.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("visible_cash_offers"),
        F.count_if("eligible_for_ranking").alias("ranked_cash_offers"),
        F.max("last_success_at").alias("latest_cash_success"),
    )
    found = discovery.groupBy("store_id").agg(
        F.bool_or("enabled").alias("discovery_configured"),
        F.max("last_scan_at").alias("latest_catalog_scan"),
        F.max("last_success_at").alias("latest_catalog_success"),
        F.max_by("last_error_code", F.when(F.col("last_error_code").isNotNull(), F.col("updated_at"))).alias(
            "latest_catalog_error"
        ),
    )
    counts = ["active_mappings", "verified_direct_urls", "visible_cash_offers", "ranked_cash_offers"]
    rows = (
        stores.join(mapping, "store_id", "left")
        .join(cash, "store_id", "left")
        .join(found, "store_id", "left")
        .fillna(0, counts)
        .fillna(False, ["discovery_configured"])
        .withColumn("price_capable", price_capable())
    )
    stage = (
        F.when(~F.col("price_capable"), "catalog_only")
        .when(F.col("visible_cash_offers") > 0, "live_price")
        .when(F.col("active_mappings") > 0, "linked_waiting_price")
        .when(F.col("latest_catalog_success").isNotNull(), "discovered_waiting_match")
        .when(F.col("latest_catalog_scan").isNotNull(), "discovery_failed")
        .when(F.col("discovery_configured"), "pending_discovery")
        .otherwise("connector_missing")
    )
    return rows.withColumn("coverage_stage", stage)
