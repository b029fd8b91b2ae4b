"""Serving-view checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from offerlake.plans import views
from offerlake.sources.fixtures import AS_OF, DriverTables

USABLE = """last_success_at >= {as_of} - INTERVAL 1470 MINUTE AND extraction_status = 'success'
  AND availability <> 'out_of_stock' AND COALESCE(review_status, '') <> 'rejected'"""
TOTAL = "COALESCE(total_price, CASE WHEN free_shipping THEN cash_price END, cash_price + shipping_cost)"
PUBLIC = f"""
    pub AS (
      SELECT o.*, v.canonical_name, v.brand, s.store_name, {TOTAL} AS comparable_total,
        CASE WHEN last_success_at IS NULL THEN 'unseen'
             WHEN last_success_at >= {{as_of}} - INTERVAL 735 MINUTE THEN 'fresh'
             WHEN last_success_at >= {{as_of}} - INTERVAL 1470 MINUTE THEN 'late' ELSE 'stale' END AS computed_freshness,
        COALESCE({USABLE} AND anomaly_status = 'clear', false) AS eligible_for_ranking,
        COALESCE(free_shipping, false) OR shipping_cost IS NOT NULL OR total_price IS NOT NULL AS shipping_cost_known
      FROM fx_offers o JOIN fx_variants v ON v.variant_id = o.variant_id JOIN fx_stores s ON s.store_id = o.store_id
      WHERE o.active AND cash_price >= 10 AND anomaly_status <> 'blocked')"""
PLAN_OK = """i.active AND i.last_success_at >= {as_of} - INTERVAL 1470 MINUTE AND i.extraction_status = 'success'
  AND i.periodic_payment IS NOT NULL AND COALESCE(o.availability, 'unknown') <> 'out_of_stock'
  AND (i.starts_at IS NULL OR i.starts_at <= {as_of}) AND (i.ends_at IS NULL OR i.ends_at >= {as_of})
  AND NOT i.starting_from_only AND i.completeness = 'complete' AND i.months > 0 AND i.provider_name IS NOT NULL
  AND COALESCE(i.review_status, '') <> 'rejected'"""
SUMMARY = f"""
    cash AS (
      SELECT variant_id, min(cash_price) AS lowest_cash_price, min({TOTAL}) AS lowest_delivered_total,
        count(DISTINCT offer_key) AS n FROM fx_offers WHERE active AND {USABLE} GROUP BY 1),
    inst AS (
      SELECT i.variant_id, count(DISTINCT i.plan_key) AS n, min(i.periodic_payment) AS low
      FROM fx_plans i LEFT JOIN fx_offers o ON o.offer_key = i.cash_offer_key WHERE {PLAN_OK} GROUP BY 1),
    summ AS (
      SELECT p.variant_id, p.product_id, p.active, p.canonical_name, p.brand, p.model, c.lowest_cash_price,
        c.lowest_delivered_total, COALESCE(c.n, 0) AS cash_offer_count, COALESCE(i.n, 0) AS installment_plan_count,
        i.low AS lowest_periodic_payment
      FROM fx_variants p LEFT JOIN cash c USING (variant_id) LEFT JOIN inst i USING (variant_id))"""


def public_offers(t: DriverTables) -> DataFrame:
    return views.public_cash_offers(t.fx_offers, t.fx_variants, t.fx_stores, AS_OF)


def summary(t: DriverTables) -> DataFrame:
    return views.offer_summary(t.fx_variants, t.fx_offers, t.fx_plans, AS_OF)


def products(t: DriverTables) -> DataFrame:
    return t.fx_variants.groupBy("product_id").agg(F.min("brand").alias("brand"), F.min("model").alias("model"))


@check(
    "public_cash_offers",
    f"""WITH {PUBLIC} SELECT offer_id, variant_id, store_id, canonical_name, store_name, computed_freshness,
      eligible_for_ranking, shipping_cost_known, CAST(comparable_total AS DOUBLE) AS comparable_total FROM pub""",
)
def public_cash_offers(t: DriverTables) -> DataFrame:
    return public_offers(t).select(
        "offer_id", "variant_id", "store_id", "canonical_name", "store_name", "computed_freshness",
        "eligible_for_ranking", "shipping_cost_known", "comparable_total",
    )


@check(
    "public_installment_offers",
    f"""
    SELECT i.plan_id, i.variant_id, CAST(i.total_published AS DOUBLE) AS normalized_total,
      o.availability AS cash_availability,
      CASE WHEN i.last_success_at IS NULL THEN 'unseen' WHEN i.last_success_at >= {{as_of}} - INTERVAL 735 MINUTE THEN 'fresh'
           WHEN i.last_success_at >= {{as_of}} - INTERVAL 1470 MINUTE THEN 'late' ELSE 'stale' END AS computed_freshness,
      COALESCE({PLAN_OK}, false) AS eligible_for_ranking
    FROM fx_plans i JOIN fx_variants USING (variant_id) JOIN fx_stores USING (store_id)
      LEFT JOIN fx_offers o ON o.offer_key = i.cash_offer_key WHERE i.active
    """,
)
def public_installment_offers(t: DriverTables) -> DataFrame:
    rows = views.public_installment_offers(t.fx_plans, t.fx_variants, t.fx_stores, t.fx_offers, AS_OF)
    return rows.select(
        "plan_id", "variant_id", "normalized_total", "cash_availability", "computed_freshness", "eligible_for_ranking"
    )


@check(
    "offer_summary",
    f"""WITH {SUMMARY} SELECT variant_id, canonical_name, CAST(lowest_cash_price AS DOUBLE) AS lowest_cash_price,
      CAST(lowest_delivered_total AS DOUBLE) AS lowest_delivered_total, cash_offer_count, installment_plan_count,
      CAST(lowest_periodic_payment AS DOUBLE) AS lowest_periodic_payment FROM summ""",
)
def offer_summary(t: DriverTables) -> DataFrame:
    return summary(t).select(
        "variant_id", "canonical_name", "lowest_cash_price", "lowest_delivered_total", "cash_offer_count",
        "installment_plan_count", "lowest_periodic_payment",
    )


@check(
    "public_products",
    f"""
    WITH {SUMMARY},
    roll AS (SELECT product_id, count(*) AS vc, min(lowest_cash_price) AS lo, min(lowest_delivered_total) AS ld,
        sum(cash_offer_count) AS cc, sum(installment_plan_count) AS ic FROM summ WHERE active GROUP BY 1),
    conn AS (SELECT v.product_id, count(DISTINCT m.store_id) AS sc FROM fx_variants v
        JOIN fx_listings m ON m.variant_id = v.variant_id AND m.active WHERE v.active GROUP BY 1)
    SELECT p.product_id, min(p.brand) AS brand, min(p.model) AS model, COALESCE(any_value(vc), 0) AS variant_count,
      COALESCE(any_value(sc), 0) AS connected_store_count, CAST(any_value(lo) AS DOUBLE) AS lowest_cash_price,
      CAST(any_value(ld) AS DOUBLE) AS lowest_delivered_total, CAST(COALESCE(any_value(cc), 0) AS BIGINT) AS cash_offer_count,
      CAST(COALESCE(any_value(ic), 0) AS BIGINT) AS installment_plan_count
    FROM fx_variants p LEFT JOIN roll USING (product_id) LEFT JOIN conn USING (product_id) GROUP BY 1
    """,
)
def public_products(t: DriverTables) -> DataFrame:
    return views.public_products(products(t), t.fx_variants, t.fx_listings, summary(t))


@check(
    "cash_decision_inputs",
    """
    SELECT o.offer_id, o.variant_id, s.store_name, m.store_sku,
      CAST(GREATEST(cash_price + COALESCE(shipping_cost,0) + COALESCE(mandatory_fees,0) + COALESCE(card_fees,0)
        - COALESCE(coupon_discount,0), 0) AS DOUBLE) AS final_cost
    FROM fx_offers o JOIN fx_stores s USING (store_id) JOIN fx_listings m USING (mapping_id)
    WHERE o.active AND anomaly_status <> 'blocked'
    """,
)
def cash_decision_inputs(t: DriverTables) -> DataFrame:
    rows = views.cash_decision_inputs(t.fx_offers, t.fx_stores, t.fx_listings)
    return rows.select("offer_id", "variant_id", "store_name", "store_sku", "final_cost")


INSTALMENT_COST = """COALESCE(total_published, GREATEST(COALESCE(down_payment,0) + periodic_payment * months
  + COALESCE(admin_fees,0) + COALESCE(shipping_cost,0) - COALESCE(coupon_discount,0), 0))"""


@check(
    "installment_decision_inputs",
    """
    SELECT plan_id, store_name, CAST(COALESCE(total_published, CASE WHEN months IS NOT NULL THEN
      GREATEST(COALESCE(down_payment,0) + periodic_payment * months + COALESCE(admin_fees,0) + COALESCE(shipping_cost,0)
        - COALESCE(coupon_discount,0), 0) END) AS DOUBLE) AS final_installment_cost
    FROM fx_plans p JOIN fx_stores s USING (store_id) WHERE p.active AND anomaly_status <> 'blocked'
    """,
)
def installment_decision_inputs(t: DriverTables) -> DataFrame:
    return views.installment_decision_inputs(t.fx_plans, t.fx_stores).select(
        "plan_id", "store_name", "final_installment_cost"
    )


@check(
    "public_offer_table",
    """
    SELECT o.variant_id, o.offer_id, o.mapping_id, s.store_name,
      COALESCE(NULLIF(l.direct_product_url, ''), l.source_url) AS product_url,
      CAST(GREATEST(cash_price + COALESCE(shipping_cost,0) + COALESCE(mandatory_fees,0) + COALESCE(card_fees,0)
        - COALESCE(coupon_discount,0), 0) AS DOUBLE) AS final_cost,
      true AS visible, anomaly_status = 'clear' AND match_quality_score >= 80 AS rankable
    FROM fx_offers o JOIN fx_stores s ON s.store_id = o.store_id AND s.active
      JOIN fx_listings l ON l.mapping_id = o.mapping_id AND l.active
    WHERE o.active AND anomaly_status <> 'blocked'
    """,
)
def public_offer_table(t: DriverTables) -> DataFrame:
    return views.public_offer_table(t.fx_offers, t.fx_stores, t.fx_listings).select(
        "variant_id", "offer_id", "mapping_id", "store_name", "product_url", "final_cost", "visible", "rankable"
    )


@check(
    "direct_link_coverage",
    """
    WITH m AS (
      SELECT store_id, count(*) FILTER (active) AS a, count(*) FILTER (active AND NULLIF(direct_product_url, '') IS NOT NULL) AS d,
        count(*) FILTER (active AND direct_url_status = 'verified') AS v,
        count(*) FILTER (active AND direct_url_status = 'legacy_unverified') AS l,
        count(*) FILTER (active AND direct_url_status IN ('failed', 'conflict')) AS f,
        max(direct_url_verified_at) AS latest FROM fx_listings GROUP BY 1),
    r AS (SELECT store_id, max(last_success_at) AS latest_import FROM fx_discovery GROUP BY 1)
    SELECT s.store_id, s.store_name, COALESCE(a, 0) AS active_mappings, COALESCE(d, 0) AS mappings_with_direct_url,
      COALESCE(v, 0) AS verified_direct_urls, COALESCE(l, 0) AS legacy_unverified_urls,
      COALESCE(f, 0) AS failed_or_conflicting_urls, round(100.0 * v / NULLIF(a, 0), 2) AS verified_direct_url_percent,
      strftime(latest, '%Y-%m-%d %H:%M:%S') AS latest_direct_url_verification,
      strftime(latest_import, '%Y-%m-%d %H:%M:%S') AS latest_catalog_import
    FROM fx_stores s LEFT JOIN m USING (store_id) LEFT JOIN r USING (store_id)
    """,
)
def direct_link_coverage(t: DriverTables) -> DataFrame:
    imports = t.fx_discovery.withColumnRenamed("last_success_at", "completed_at")
    return views.link_coverage(t.fx_stores, t.fx_listings, imports)


@check(
    "coverage_ledger",
    f"""
    WITH {PUBLIC},
    m AS (SELECT store_id, count(*) FILTER (active) AS a,
        count(*) FILTER (active AND direct_url_status = 'verified') AS v FROM fx_listings GROUP BY 1),
    c AS (SELECT store_id, count(*) AS n, count(*) FILTER (eligible_for_ranking) AS r FROM pub GROUP BY 1),
    d AS (SELECT store_id, bool_or(enabled) AS conf, max(last_scan_at) AS scan, max(last_success_at) AS ok,
        (array_agg(last_error_code ORDER BY updated_at DESC) FILTER (last_error_code IS NOT NULL))[1] AS err
        FROM fx_discovery GROUP BY 1)
    SELECT s.store_id, COALESCE(a, 0) AS active_mappings, COALESCE(n, 0) AS visible_cash_offers,
      COALESCE(r, 0) AS ranked_cash_offers, err AS latest_catalog_error,
      registry_status <> 'catalog_only' AND public_price_status <> 'catalog_only' AND online_purchase <> 'no' AS price_capable,
      CASE WHEN registry_status = 'catalog_only' OR public_price_status = 'catalog_only' OR online_purchase = 'no'
             THEN 'catalog_only'
           WHEN n > 0 THEN 'live_price' WHEN a > 0 THEN 'linked_waiting_price' WHEN ok IS NOT NULL THEN 'discovered_waiting_match'
           WHEN scan IS NOT NULL THEN 'discovery_failed' WHEN conf THEN 'pending_discovery' ELSE 'connector_missing' END
        AS coverage_stage
    FROM fx_stores s LEFT JOIN m USING (store_id) LEFT JOIN c USING (store_id) LEFT JOIN d USING (store_id)
    """,
)
def coverage_ledger(t: DriverTables) -> DataFrame:
    rows = views.coverage_ledger(t.fx_stores, t.fx_listings, public_offers(t), t.fx_discovery)
    return rows.select(
        "store_id", "active_mappings", "visible_cash_offers", "ranked_cash_offers", "latest_catalog_error",
        "price_capable", "coverage_stage",
    )


@check(
    "active_mappings",
    """
    SELECT l.mapping_id, l.variant_id, v.canonical_name, s.store_name, s.requests_per_minute
    FROM fx_listings l JOIN fx_variants v ON v.variant_id = l.variant_id AND v.active
      JOIN fx_stores s ON s.store_id = l.store_id AND s.active AND s.enabled WHERE l.active
    """,
)
def active_mappings(t: DriverTables) -> DataFrame:
    stores = t.fx_stores
    connectors = stores.select("store_id", "enabled", "requests_per_minute")
    rows = views.active_mappings(t.fx_listings, t.fx_variants, stores, connectors)
    return rows.select("mapping_id", "variant_id", "canonical_name", "store_name", "requests_per_minute")


@check(
    "enriched_offers",
    """
    SELECT o.offer_id, v.canonical_name, s.store_name, l.url_type FROM fx_offers o JOIN fx_variants v USING (variant_id)
      JOIN fx_stores s USING (store_id) JOIN fx_listings l USING (mapping_id)
    """,
)
def enriched_offers(t: DriverTables) -> DataFrame:
    listings = t.fx_listings.select("mapping_id", "url_type")
    stores = t.fx_stores.select("store_id", "store_name")
    variants = t.fx_variants.select("variant_id", "canonical_name")
    rows = views.enrich(t.fx_offers, variants, stores, listings)
    return rows.select("offer_id", "canonical_name", "store_name", "url_type")


@check(
    "valid_plans",
    """
    SELECT plan_id, variant_id FROM fx_plans
    WHERE (starts_at IS NULL OR starts_at <= {as_of}) AND (ends_at IS NULL OR ends_at >= {as_of})
    """,
)
def valid_plans(t: DriverTables) -> DataFrame:
    return views.valid_plans(t.fx_plans, AS_OF).select("plan_id", "variant_id")


@check(
    "primary_urls",
    """
    SELECT mapping_id, COALESCE(NULLIF(direct_product_url, ''), source_url) AS url,
      CASE direct_url_status WHEN 'verified' THEN 'verified' WHEN 'failed' THEN 'broken' ELSE 'unverified' END AS url_status
    FROM fx_listings
    """,
)
def primary_urls(t: DriverTables) -> DataFrame:
    return views.primary_urls(t.fx_listings)


@check(
    "effective_urls",
    """
    SELECT mapping_id, CASE WHEN direct_url_status = 'verified' AND NULLIF(direct_product_url, '') IS NOT NULL
        THEN direct_product_url ELSE source_url END AS effective_source_url,
      CASE WHEN direct_url_status = 'verified' AND NULLIF(direct_product_url, '') IS NOT NULL
        THEN 'direct_product' ELSE url_type END AS effective_url_type
    FROM fx_listings
    """,
)
def effective_urls(t: DriverTables) -> DataFrame:
    return views.effective_urls(t.fx_listings).select("mapping_id", "effective_source_url", "effective_url_type")
