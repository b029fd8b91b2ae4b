"""Price-comparison views over the driver's star schema.

Every view is one SQL text that both Spark and the checking database run, so
the meaning of a column is written once.  ``{name}`` refers to another view or
to a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators.skew import latest_per
from offerlake.sources.tables import load

# The moment every check looks from (the ledger ends in late 2001, the event stream in January 2024).
AS_OF = "2001-06-15 00:00:00"
STREAM_AS_OF = "2024-01-31 00:00:00"

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
)

VIEWS = {
    "fx_stores": """
        SELECT s.s_suppkey AS store_id, s.s_name AS store_name, n.n_name AS country,
          concat('https://shop', CAST(s.s_suppkey AS STRING), '.example.com') AS base_url,
          (s.s_acctbal > 0) AS active,
          CASE WHEN s.s_suppkey % 7 = 0 THEN 'catalog_only' ELSE 'active' END AS registry_status,
          CASE WHEN s.s_suppkey % 11 = 0 THEN 'catalog_only' ELSE 'public' END AS public_price_status,
          CASE WHEN s.s_suppkey % 13 = 0 THEN 'no' ELSE 'yes' END AS online_purchase,
          CAST(6 + s.s_suppkey % 5 AS INT) AS requests_per_minute,
          (s.s_suppkey % 3 = 0) AS store_verified,
          (s.s_suppkey % 9 <> 0) AS enabled
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    "fx_variants": """
        SELECT p_partkey AS variant_id, concat(p_brand, '|', p_name) AS product_id,
          concat(p_brand, ' ', p_name, ' ', CAST(p_size AS STRING), 'GB') AS canonical_name,
          p_type AS section, p_type AS category_id, split_part(p_name, ' ', 2) AS product_type,
          p_brand AS brand, p_name AS model, concat(p_name, ' ', CAST(p_size AS STRING), 'GB') AS variant_name,
          CAST(p_size AS INT) AS storage_gb, CAST(4 * (1 + p_partkey % 4) AS INT) AS ram_gb,
          split_part(p_name, ' ', 1) AS color,
          concat('MX', CAST(10000 + p_partkey AS STRING)) AS manufacturer_sku,
          CAST(6220000000000 + p_partkey AS STRING) AS gtin,
          (p_partkey % 17 <> 0) AS active,
          CASE WHEN p_partkey % 23 = 0 THEN 'catalog_provisional' ELSE 'catalog' END AS source_status,
          CAST(p_retailprice AS DECIMAL(18,2)) AS list_price
        FROM {part}""",
    "fx_observations": """
        SELECT l_orderkey * 10 + l_linenumber AS obs_id, l_partkey AS variant_id, l_suppkey AS store_id,
          concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING), '|STORE') AS offer_key,
          l_shipdate AS observed_at, 'EGP' AS currency,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS cash_price,
          CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_extendedprice + l_partkey % 700 - 100 AS DECIMAL(18,2)) END AS old_price,
          CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(l_tax * 1000 AS DECIMAL(18,2)) END AS shipping_cost,
          CAST(l_discount * 1000 AS DECIMAL(18,2)) AS coupon_discount,
          CASE WHEN l_linenumber % 5 = 0 THEN (l_orderkey % 3 = 0) END AS free_shipping,
          CASE WHEN l_returnflag = 'N' THEN 'available' WHEN l_returnflag = 'A' THEN 'limited'
               WHEN l_linestatus = 'F' THEN 'out_of_stock' ELSE 'unknown' END AS availability,
          CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'high' ELSE 'medium' END
            AS match_confidence,
          CASE WHEN l_quantity > 40 THEN concat('SAVE', CAST(CAST(l_quantity AS INT) AS STRING)) END AS coupon_code,
          CASE WHEN l_orderkey % 3 = 0 THEN 'official' WHEN l_orderkey % 3 = 1 THEN 'store' END AS warranty_type,
          CASE WHEN l_orderkey % 4 = 0 THEN 'Maker Care' END AS warranty_provider,
          CASE WHEN l_orderkey % 5 < 2 THEN 12 WHEN l_orderkey % 5 = 2 THEN 6 END AS warranty_months
        FROM {lineitem}""",
    "fx_ranked_observations": """
        SELECT o.*, row_number() OVER (PARTITION BY offer_key ORDER BY observed_at DESC, obs_id DESC) AS rn
        FROM {fx_observations} o""",
    "fx_offers": """
        SELECT obs_id, obs_id * 100000 + store_id AS offer_id, offer_key, variant_id, store_id,
          concat('M', offer_key) AS mapping_id,
          currency, cash_price, old_price, shipping_cost, free_shipping, coupon_discount, coupon_code,
          CASE WHEN COALESCE(free_shipping, shipping_cost = 0) THEN cash_price
               WHEN shipping_cost IS NOT NULL THEN cash_price + shipping_cost END AS total_price,
          CASE WHEN obs_id % 7 = 0 THEN CAST(25.5 AS DECIMAL(18,2)) END AS mandatory_fees,
          CASE WHEN obs_id % 6 = 0 THEN CAST(12.25 AS DECIMAL(18,2)) END AS card_fees,
          availability, match_confidence, warranty_type, warranty_provider, warranty_months, observed_at,
          CASE WHEN obs_id % 29 = 0 THEN NULL
               ELSE {as_of} - INTERVAL '1' MINUTE * CAST(obs_id % 2000 AS INT) END AS last_success_at,
          CASE WHEN obs_id % 31 = 0 THEN 'timeout' ELSE 'success' END AS extraction_status,
          CASE WHEN obs_id % 37 = 0 THEN 'rejected' WHEN obs_id % 19 = 0 THEN 'needs_review' END AS review_status,
          CASE WHEN obs_id % 41 = 0 THEN 'blocked' WHEN obs_id % 8 = 0 THEN 'review' ELSE 'clear' END
            AS anomaly_status,
          (obs_id % 43 <> 0) AS active,
          CAST(obs_id % 5 AS INT) AS consecutive_failures,
          CASE match_confidence WHEN 'high' THEN 95 WHEN 'medium' THEN 72 ELSE 38 END AS match_quality_score,
          (obs_id % 10 = 0) AS pickup_available,
          CASE WHEN obs_id % 4 > 0 THEN CAST(obs_id % 4 AS INT) END AS min_delivery_days,
          CASE WHEN obs_id % 4 > 1 THEN CAST(obs_id % 9 AS INT) END AS max_delivery_days,
          (obs_id % 3 = 0) AS store_verified, (obs_id % 5 = 0) AS seller_verified,
          concat('https://shop', CAST(store_id AS STRING), '.example.com/products/item-',
                 CAST(variant_id AS STRING)) AS source_url
        FROM {fx_ranked_observations} WHERE rn = 1""",
    "fx_listings": """
        SELECT mapping_id, variant_id, store_id, offer_key, source_url,
          CASE WHEN obs_id % 3 = 0 THEN NULL WHEN obs_id % 17 = 0 THEN ''
               ELSE concat(source_url, '?v=', CAST(obs_id % 7 AS STRING)) END AS direct_product_url,
          CASE obs_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'failed' WHEN 2 THEN 'conflict'
               WHEN 3 THEN 'legacy_unverified' ELSE 'verified' END AS direct_url_status,
          CASE WHEN obs_id % 4 = 0 THEN 'product' ELSE 'search' END AS url_type,
          (obs_id % 13 <> 0) AS active, match_confidence,
          CASE WHEN obs_id % 6 = 0 THEN NULL ELSE concat('ST', CAST(obs_id % 1000 AS STRING)) END AS store_sku,
          observed_at AS direct_url_verified_at
        FROM {fx_offers}""",
    "fx_plans": """
        SELECT l_orderkey * 10 + l_linenumber AS plan_id,
          concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING), '|', CAST(l_linenumber AS STRING))
            AS plan_key,
          l_partkey AS variant_id, l_suppkey AS store_id,
          concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING), '|STORE') AS cash_offer_key,
          l_shipdate AS observed_at,
          CASE l_linenumber % 4 WHEN 0 THEN 'Valu' WHEN 1 THEN 'valu' WHEN 2 THEN 'CIB' END AS provider_name,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(6 * (1 + l_linenumber % 3) AS INT) END AS months,
          CAST(floor(l_extendedprice / 10) AS DECIMAL(18,2)) AS periodic_payment,
          CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax * 10000 AS DECIMAL(18,2)) END AS down_payment,
          CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_discount * 1000 AS DECIMAL(18,2)) END AS admin_fees,
          CAST(NULL AS DECIMAL(18,2)) AS processing_fees, CAST(NULL AS DECIMAL(18,2)) AS insurance_fees,
          CAST(NULL AS DECIMAL(18,2)) AS other_fees, CAST(NULL AS DECIMAL(18,2)) AS card_fees,
          CASE WHEN l_linenumber % 5 = 0 THEN CAST(50 AS DECIMAL(18,2)) END AS shipping_cost,
          CASE WHEN l_linenumber % 6 = 0 THEN CAST(20 AS DECIMAL(18,2)) END AS coupon_discount,
          CASE WHEN l_orderkey % 4 = 0 THEN CAST(floor(l_extendedprice * (0.4 + l_tax * 20)) AS DECIMAL(18,2)) END
            AS total_published,
          CAST(NULL AS DECIMAL(18,2)) AS total_calculated,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS cash_price_at_observation,
          CASE WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_orderkey % 9 = 0 THEN 'review' ELSE 'clear' END
            AS anomaly_status,
          (l_orderkey % 23 <> 0) AS active, 'success' AS extraction_status,
          (l_orderkey % 7 = 0) AS starting_from_only,
          CASE WHEN l_orderkey % 7 = 0 THEN 'starting_from_only' WHEN l_linenumber = 7 THEN 'partial'
               ELSE 'complete' END AS completeness,
          CASE WHEN l_orderkey % 3 = 0 THEN true WHEN l_orderkey % 3 = 1 THEN false END AS interest_free,
          CASE WHEN l_orderkey % 5 = 0 THEN {as_of} - INTERVAL '1' DAY * CAST(l_orderkey % 60 AS INT) END AS starts_at,
          CASE WHEN l_orderkey % 5 = 1 THEN {as_of} + INTERVAL '1' DAY * CAST(l_orderkey % 60 - 20 AS INT) END AS ends_at,
          CASE WHEN l_orderkey % 29 = 0 THEN NULL
               ELSE {as_of} - INTERVAL '1' MINUTE * CAST(l_orderkey % 2000 AS INT) END AS last_success_at,
          CASE WHEN l_orderkey % 37 = 0 THEN 'rejected' END AS review_status
        FROM {lineitem}""",
    "fx_price_stream": """
        SELECT event_id AS obs_id, user_id AS offer_key, user_id % 20 AS variant_id, user_id AS store_id,
          ts AS observed_at, CAST(value AS DECIMAL(18,2)) AS cash_price,
          CASE event_type WHEN 'error' THEN 'out_of_stock' WHEN 'signup' THEN 'limited' ELSE 'available' END
            AS availability
        FROM {events}""",
    "fx_coarse_stream": """
        SELECT obs_id, offer_key, variant_id, store_id, observed_at,
          CAST(floor(cash_price / 100) * 100 AS DECIMAL(18,2)) AS cash_price, availability
        FROM {fx_price_stream}""",
    "fx_tasks": """
        SELECT event_id AS task_id, user_id % 100 AS store_id, CAST(floor(event_id / 500) AS BIGINT) AS run_id,
          ts AS finished_at,
          CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'success' END AS status,
          CASE WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'http_404' WHEN value < 30 THEN 'timeout'
               ELSE 'price_not_found' END END AS error_code
        FROM {events}""",
    "fx_reports": """
        SELECT o_orderkey AS report_id, o_custkey AS offer_id, o_orderkey % 100 AS store_id, o_orderdate AS created_at,
          CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'confirmed' END AS status,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 150 AS INT) END
            AS resolved_at,
          CASE WHEN o_orderpriority LIKE '1%' THEN 'broken_link' ELSE 'wrong_price' END AS report_type,
          CASE WHEN o_orderkey % 6 = 0 THEN 'critical' WHEN o_orderkey % 6 < 3 THEN 'high' ELSE 'low' END AS severity
        FROM {orders}""",
    "fx_discovery": """
        SELECT c_custkey AS source_id, c_custkey % 120 AS store_id,
          concat('https://shop', CAST(c_custkey % 120 AS STRING), '.example.com/sitemap-',
                 CAST(c_custkey AS STRING), '.xml') AS source_url,
          (c_custkey % 4 <> 0) AS enabled,
          {as_of} + INTERVAL '1' MINUTE * CAST(c_custkey % 900 - 450 AS INT) AS next_scan_at,
          CASE WHEN c_custkey % 3 > 0 THEN {as_of} - INTERVAL '1' HOUR * CAST(c_custkey % 50 AS INT) END AS last_scan_at,
          CASE WHEN c_custkey % 3 = 1 THEN {as_of} - INTERVAL '1' HOUR * CAST(c_custkey % 70 AS INT) END
            AS last_success_at,
          CASE WHEN c_custkey % 5 = 0 THEN 'timeout' WHEN c_custkey % 5 = 1 THEN 'http_403' END AS last_error_code,
          {as_of} - INTERVAL '1' MINUTE * CAST(c_custkey AS INT) AS updated_at
        FROM {customer}""",
    "fx_items": """
        SELECT l_orderkey * 10 + l_linenumber AS item_id, l_suppkey AS store_id, p.p_partkey AS true_variant,
          CASE l_linenumber WHEN 1 THEN concat('Buy ', p.p_brand, ' ', p.p_name, ' ', CAST(p.p_size AS STRING), 'GB')
               WHEN 2 THEN concat(p.p_name, ' ', CAST(p.p_size AS STRING), ' GB by ', p.p_brand)
               ELSE concat(p.p_brand, ' ', p.p_name) END AS title,
          CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE p.p_brand END AS brand,
          CASE WHEN l_linenumber = 3 THEN concat('mx-', CAST(10000 + p.p_partkey AS STRING)) END AS sku,
          CASE WHEN l_linenumber = 5 THEN CAST(6220000000000 + p.p_partkey AS STRING)
               WHEN l_linenumber = 6 THEN '12345' END AS gtin,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS price, 'EGP' AS currency,
          CASE WHEN l_returnflag = 'A' THEN 'out_of_stock' ELSE 'available' END AS availability,
          concat('https://shop', CAST(l_suppkey AS STRING), '.example.com/products/',
                 CASE WHEN l_linenumber = 4 THEN concat('mx', CAST(10000 + p.p_partkey AS STRING), '-')
                      ELSE 'item-' END,
                 CAST(p.p_partkey % 500 AS STRING)) AS normalized_url,
          CASE WHEN l_linenumber % 2 = 0 THEN 'jsonld_offer' ELSE 'sitemap_product_url' END AS source_method,
          l_shipdate AS last_seen_at
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


def references(text: str) -> list[str]:
    """View names a text needs, dependencies first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in _NAME.findall(body):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(text)
    return found


class DriverTables:
    """Driver tables and fixture views of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, given: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.given = spark, folder, given or {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.given:
            return self.given[name]
        return self.sql(VIEWS[name]) if name in VIEWS else load(self.spark, self.folder, name)

    def picked_by_aggregate(self) -> DriverTables:
        """These tables with the newest observation of an offer picked by an aggregate.

        Offers and listings are views over it; a query that reads them several times shuffles the ledger once.
        """
        obs = self.fx_observations.filter("offer_key IS NOT NULL")
        newest = latest_per(obs, ["offer_key"], ["observed_at", "obs_id"]).withColumn("rn", F.lit(1))
        return DriverTables(self.spark, self.folder, {"fx_ranked_observations": newest})

    def sql(self, text: str) -> DataFrame:
        names = set(_NAME.findall(text)) - {"as_of"}
        body = text.replace("{as_of}", f"CAST('{AS_OF}' AS TIMESTAMP_NTZ)")
        return self.spark.sql(body, **{n: getattr(self, n) for n in names})
