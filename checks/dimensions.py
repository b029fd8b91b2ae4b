"""Catalogue dimensions, comparison documents, directories and refreshes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.browse import public_offers
from checks.decisions import QUALITY
from checks.serving import INSTALMENT_COST, PLAN_OK, PUBLIC
from offerlake.operators import matching
from offerlake.plans import browse, dimensions, views
from offerlake.plans import quality as dq
from offerlake.session import checkpoint_folder
from offerlake.sources.fixtures import AS_OF, STREAM_AS_OF, DriverTables

#: The catalogue with phones, editions, missing sections, types and brands, and types named like their section.
CATALOGUE = """
    raw AS (SELECT variant_id, canonical_name, color, ram_gb, storage_gb, source_status,
      CASE WHEN variant_id % 11 <> 0 THEN section END AS section,
      CASE WHEN variant_id % 13 = 0 THEN NULL WHEN variant_id % 17 = 0 THEN CASE WHEN variant_id % 11 <> 0 THEN fx_variants.section END WHEN variant_id % 5 = 0 THEN 'Smart Phone' ELSE product_type END AS product_type,
      CASE WHEN variant_id % 7 <> 0 THEN brand END AS brand,
      CASE WHEN variant_id % 19 = 0 THEN NULL WHEN variant_id % 3 = 0 THEN concat(model, ' Pro Max 5G') ELSE model END AS model FROM fx_variants),"""
DESCRIBED = f"""{CATALOGUE}
    filled AS (SELECT * REPLACE (COALESCE(section, 'غير مصنف') AS section, COALESCE(product_type, section, 'غير مصنف') AS product_type,
      COALESCE(brand, 'غير محدد') AS brand, COALESCE(model, canonical_name) AS model) FROM raw),
    k AS (SELECT *, 'CAT-' || upper(left(sha256('root|' || lower(section)), 16)) AS root_id, 'CAT-' || upper(left(sha256('leaf|' || lower(section) || '|' || lower(product_type)), 16)) AS category_id,
      'BRD-' || upper(left(sha256(lower(brand)), 16)) AS brand_id,
      CASE WHEN lower(product_type) LIKE '%phone%' THEN regexp_replace(model, '(?i)\\s+(pro max|pro|plus|ultra|max|mini|air|lite|se)\\b.*$', '') ELSE model END AS family FROM filled),
    d AS (SELECT *, 'FAM-' || upper(left(sha256(lower(concat_ws('|', category_id, brand_id, family))), 18)) AS family_id,
      'PRD-' || upper(left(sha256(lower(concat_ws('|', category_id, brand_id, model))), 18)) AS product_key FROM k)"""
TREE = f"""{DESCRIBED},
    tree AS (SELECT root_id AS category_id, CAST(NULL AS VARCHAR) AS parent_id, 'section:' || lower(arg_max(section, variant_id)) AS source_key, arg_max(section, variant_id) AS name, 1 AS level FROM d GROUP BY 1
      UNION ALL SELECT category_id, max(CASE WHEN product_type <> section THEN root_id END), 'type:' || lower(arg_max(section, variant_id)) || ':' || lower(arg_max(product_type, variant_id)),
        arg_max(product_type, variant_id), max(CASE WHEN product_type <> section THEN 2 ELSE 1 END) FROM d GROUP BY 1)"""


def catalogue(t: DriverTables) -> DataFrame:
    v, n = t.fx_variants, F.col("variant_id")
    return dimensions.described(
        v.withColumns(
            {
                "section": F.when(n % 11 != 0, F.col("section")),
                "product_type": F.when(n % 13 == 0, F.lit(None)).when(n % 17 == 0, F.when(n % 11 != 0, F.col("section"))).when(n % 5 == 0, "Smart Phone").otherwise(F.col("product_type")),
                "brand": F.when(n % 7 != 0, F.col("brand")),
                "model": F.when(n % 19 == 0, F.lit(None)).when(n % 3 == 0, F.concat("model", F.lit(" Pro Max 5G"))).otherwise(F.col("model")),
            }
        )
    )


@check("dimension_categories", f"WITH {TREE.strip()} SELECT * FROM tree")
def dimension_categories(t: DriverTables) -> DataFrame:
    return dimensions.categories(catalogue(t))


@check(
    "dimension_category_closure",
    f"""WITH {TREE.strip()} SELECT category_id AS ancestor_id, category_id, 0 AS distance FROM tree
        UNION ALL SELECT parent_id, category_id, 1 FROM tree WHERE parent_id IS NOT NULL""",
)
def dimension_category_closure(t: DriverTables) -> DataFrame:
    return dimensions.closure(dimensions.categories(catalogue(t)).select("category_id", "parent_id"))


@check("dimension_brands", f"WITH {DESCRIBED.strip()} SELECT brand_id, arg_max(brand, variant_id) AS name, lower(arg_max(brand, variant_id)) AS normalized_name FROM d GROUP BY 1")
def dimension_brands(t: DriverTables) -> DataFrame:
    return dimensions.brands(catalogue(t))


@check(
    "dimension_families",
    f"WITH {DESCRIBED.strip()} SELECT family_id, category_id, brand_id, arg_max(family, variant_id) AS name, lower(arg_max(family, variant_id)) AS normalized_name FROM d GROUP BY 1, 2, 3",
)
def dimension_families(t: DriverTables) -> DataFrame:
    return dimensions.families(catalogue(t))


@check(
    "dimension_product_rows",
    f"""WITH {DESCRIBED.strip()} SELECT product_key, arg_max(family_id, variant_id) AS family_id, category_id, brand_id, concat(arg_max(brand, variant_id), ' ', arg_max(model, variant_id)) AS name,
        arg_max(model, variant_id) AS model, arg_max(source_status, variant_id) AS source_status FROM d GROUP BY product_key, category_id, brand_id""",
)
def dimension_product_rows(t: DriverTables) -> DataFrame:
    return dimensions.products(catalogue(t))


@check(
    "dimension_attribute_values",
    f"""
    WITH {DESCRIBED.strip()}, a AS (
      SELECT variant_id, category_id, 'ram_gb' AS code, NULL AS value_text, CAST(ram_gb AS DOUBLE) AS value_number, 'GB' AS unit FROM d
      UNION ALL SELECT variant_id, category_id, 'storage_gb', NULL, storage_gb, 'GB' FROM d UNION ALL SELECT variant_id, category_id, 'color', color, NULL, NULL FROM d)
    SELECT variant_id, 'ATR-' || upper(left(sha256(lower(category_id || '|' || code)), 18)) AS attribute_id, code, value_text, value_number, lower(value_text) AS normalized_text, unit FROM a
    WHERE value_text IS NOT NULL OR value_number IS NOT NULL
    """,
)
def dimension_attribute_values(t: DriverTables) -> DataFrame:
    return dimensions.attribute_values(catalogue(t))


@check(
    "comparison_documents",
    f"""
    WITH {PUBLIC}, o AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY NOT eligible_for_ranking,
      COALESCE(comparable_total, cash_price), cash_price, CASE computed_freshness WHEN 'fresh' THEN 0 WHEN 'late' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END,
      CASE availability WHEN 'available' THEN 0 WHEN 'limited' THEN 1 WHEN 'preorder' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END, store_name, offer_id) AS rank FROM pub),
    p AS (SELECT i.*, s.store_name, row_number() OVER (PARTITION BY i.variant_id ORDER BY NOT COALESCE({PLAN_OK}, false),
      CASE WHEN i.last_success_at IS NULL THEN 3 WHEN i.last_success_at >= {{as_of}} - INTERVAL 735 MINUTE THEN 0
        WHEN i.last_success_at >= {{as_of}} - INTERVAL 1470 MINUTE THEN 1 ELSE 2 END,
      i.starting_from_only, i.total_published NULLS LAST, i.periodic_payment, i.months NULLS LAST, s.store_name, i.plan_id) AS rank
      FROM fx_plans i JOIN fx_stores s USING (store_id) LEFT JOIN fx_offers o ON o.offer_key = i.cash_offer_key WHERE i.active)
    SELECT variant_id, 'offer' AS kind, rank, offer_id AS entry_id, store_name, NULL AS provider_name, CAST(cash_price AS DOUBLE) AS amount, NULL AS months FROM o
    UNION ALL SELECT variant_id, 'plan', rank, plan_id, store_name, provider_name, CAST(periodic_payment AS DOUBLE), months FROM p
    """,
)
def comparison_documents(t: DriverTables) -> DataFrame:
    ranked = browse.rank_offers(public_offers(t))
    plans = browse.rank_visible_plans(views.public_installment_offers(t.fx_plans, t.fx_variants, t.fx_stores, t.fx_offers, AS_OF))
    name = f"comparisons_{uuid.uuid4().hex}"
    table = browse.write_comparisons(browse.comparison_entries(ranked, plans), name, f"{checkpoint_folder(t.spark)}/{name}", 16)
    return table.select("variant_id", "kind", "rank", "entry_id", "store_name", "provider_name", "amount", "months")


@check(
    "alternative_costs",
    f"""
    WITH c AS (SELECT variant_id, min(f) AS low FROM (SELECT o.variant_id, cash_price, CAST(GREATEST(cash_price + COALESCE(shipping_cost,0) + COALESCE(mandatory_fees,0) + COALESCE(card_fees,0)
        - COALESCE(coupon_discount,0), 0) AS DOUBLE) AS f FROM fx_offers o JOIN fx_stores s USING (store_id) JOIN fx_listings m USING (mapping_id) WHERE o.active AND anomaly_status = 'clear')
        WHERE cash_price >= 10 AND f >= 10 GROUP BY 1),
    i AS (SELECT variant_id, min(CAST(COALESCE(total_published, CASE WHEN months IS NOT NULL THEN {INSTALMENT_COST} END) AS DOUBLE)) AS low
      FROM fx_plans p JOIN fx_stores s USING (store_id) WHERE p.active AND anomaly_status <> 'blocked' GROUP BY 1 HAVING low IS NOT NULL)
    SELECT COALESCE(c.variant_id, i.variant_id) AS variant_id, c.low AS lowest_final_cost, i.low AS lowest_installment_total FROM c FULL JOIN i ON c.variant_id = i.variant_id
    """,
)
def alternative_costs(t: DriverTables) -> DataFrame:
    cash = views.cash_decision_inputs(t.fx_offers, t.fx_stores, t.fx_listings)
    return browse.alternative_costs(cash, views.installment_decision_inputs(t.fx_plans, t.fx_stores))


@check(
    "reconcile_resets",
    """
    WITH old AS (SELECT concat_ws('-', obs_id, variant_id, store_id, strftime(observed_at, '%Y%m%d')) AS candidate_id, cash_price, 'EGP' AS currency, availability, CAST(obs_id % 3 AS INT) AS match_version, observed_at FROM fx_observations WHERE obs_id % 5 > 0),
    new AS (SELECT concat_ws('-', obs_id, variant_id, store_id, strftime(observed_at, '%Y%m%d')) AS candidate_id, CASE WHEN obs_id % 7 = 0 THEN cash_price + 1 ELSE cash_price END AS cash_price,
      CASE WHEN obs_id % 11 = 0 THEN 'USD' ELSE 'EGP' END AS currency, availability, observed_at + INTERVAL 1 DAY AS observed_at FROM fx_observations WHERE obs_id % 3 > 0)
    SELECT COALESCE(o.candidate_id, n.candidate_id) AS candidate_id, CAST(COALESCE(n.cash_price, o.cash_price) AS DOUBLE) AS observed_price, COALESCE(n.currency, o.currency) AS currency,
      CASE WHEN o.candidate_id IS NULL OR n.cash_price <> o.cash_price OR n.currency <> o.currency THEN 0 ELSE o.match_version END AS match_version,
      CASE WHEN n.cash_price <> o.cash_price OR n.currency <> o.currency THEN NULL ELSE strftime(o.observed_at, '%Y-%m-%d %H:%M:%S') END AS checked_at,
      strftime(COALESCE(n.observed_at, o.observed_at), '%Y-%m-%d %H:%M:%S') AS last_seen_at
    FROM old o FULL JOIN new n ON n.candidate_id = o.candidate_id
    """,
)
def reconcile_resets(t: DriverTables) -> DataFrame:
    n, price = F.col("obs_id"), F.col("cash_price")
    common = [F.concat_ws("-", "obs_id", "variant_id", "store_id", F.date_format("observed_at", "yyyyMMdd")).alias("candidate_id"), F.concat(F.lit("https://shop.example.com/p/"), F.col("variant_id")).alias("normalized_url"), F.col("offer_key").alias("title")]
    empty = [F.lit(None).cast("string").alias(c) for c in ("brand", "sku", "gtin")]
    old = t.fx_observations.filter(n % 5 > 0).select(
        *common, *empty, F.lit("EGP").alias("currency"), price.alias("observed_price"), "availability", F.col("observed_at").alias("last_seen_at"), (n % 3).cast("int").alias("match_version"), F.col("observed_at").alias("checked_at")
    )
    new = t.fx_observations.filter(n % 3 > 0).select(
        *common, *empty, F.when(n % 11 == 0, "USD").otherwise("EGP").alias("currency"), F.when(n % 7 == 0, price + 1).otherwise(price).cast("decimal(18,2)").alias("observed_price"), "availability",
        (F.col("observed_at") + F.expr("INTERVAL '1' DAY")).alias("last_seen_at"),
    )
    return matching.merge_candidates(old, new).select("candidate_id", "observed_price", "currency", "match_version", "checked_at", "last_seen_at")


@check(
    "refreshed_store_quality",
    f"""WITH {QUALITY} SELECT q.store_id, CASE WHEN s.active AND s.store_id % 5 > 0 THEN 0 ELSE q.sample_size END AS sample_size,
        CASE WHEN s.active AND s.store_id % 5 > 0 THEN NULL ELSE q.price_accuracy_score END AS price_accuracy_score FROM qual q JOIN fx_stores s USING (store_id)""",
)
def refreshed_store_quality(t: DriverTables) -> DataFrame:
    """Young metrics of active stores, old ones of the others, none of every fifth store."""
    at = F.lit(AS_OF).cast("timestamp_ntz")
    age = F.when(F.col("active"), F.expr("INTERVAL '2' HOUR")).otherwise(F.expr("INTERVAL '9' HOUR"))
    stored = t.fx_stores.filter("store_id % 5 > 0").select("store_id", F.lit(0).cast("bigint").alias("sample_size"), F.lit(None).cast("double").alias("price_accuracy_score"), (at - age).alias("calculated_at"))
    rows = dq.refreshed_store_quality(stored, t.fx_stores, t.fx_listings, t.fx_offers, t.fx_tasks, t.fx_reports, AS_OF, STREAM_AS_OF)
    return rows.select("store_id", "sample_size", "price_accuracy_score")


def _verified(t: DriverTables) -> DataFrame:
    products = t.fx_variants.withColumn("specs", F.create_map(F.lit("السعة"), F.col("storage_gb").cast("string")))
    kind = F.when(F.col("url_type") == "product", "product_feed").when(F.col("direct_url_status") == "verified", "direct_product")
    named = t.fx_variants.select("variant_id", F.concat_ws("-", "brand", "model", F.concat(F.col("storage_gb").cast("string"), F.lit("GB"))).alias("slug"))
    presence = t.fx_listings.join(named, "variant_id").select(
        "variant_id", "store_id", "match_confidence", F.lit("ready").alias("review_status"), kind.alias("link_type"),
        F.concat(F.lit("https://shop.example.com/p/"), F.regexp_replace("slug", "[ #]", "-")).alias("source_url"),
    )
    return matching.verified_presence(presence, products).select("variant_id", "store_id")


DIRECTORY = """
    SELECT {0}, count(DISTINCT variant_id) AS product_count, count(DISTINCT store_id) AS store_count, {1} AS slug
    FROM fx_listings JOIN fx_variants v USING (variant_id) WHERE match_confidence = 'high' AND (url_type = 'product' OR direct_url_status = 'verified') GROUP BY 1, 4"""


@check("store_directory", DIRECTORY.format("store_id", "CAST(store_id AS VARCHAR)"))
def store_directory(t: DriverTables) -> DataFrame:
    return browse.directories(_verified(t), t.fx_variants.select("variant_id"), "store_id")


@check("category_directory", DIRECTORY.format("section", "trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-')"))
def category_directory(t: DriverTables) -> DataFrame:
    return browse.directories(_verified(t), t.fx_variants.select("variant_id", "section"), "section")
