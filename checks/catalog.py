"""Merge, dimension, aggregate and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.decisions import QUALITY, quality
from offerlake.operators import merge
from offerlake.operators.skew import latest_per
from offerlake.plans import quality as dq
from offerlake.plans import runs
from offerlake.sources.fixtures import AS_OF, DriverTables

BORDER = "1999-01-01"


def _halves(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    border = F.lit(BORDER).cast("timestamp_ntz")
    obs = t.fx_observations
    return obs.filter(F.col("observed_at") < border), obs.filter(F.col("observed_at") >= border)


@check(
    "merged_projection",
    """
    SELECT offer_key, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS observed_at, CAST(arg_max(cash_price, t) AS DOUBLE) AS cash_price,
      arg_max(coupon_code, t) FILTER (coupon_code IS NOT NULL) AS coupon_code, arg_min(warranty_type, t) FILTER (warranty_type IS NOT NULL) AS warranty_type,
      COALESCE(arg_max(availability, t) FILTER (availability = 'out_of_stock'), arg_max(availability, t)) AS availability
    FROM (SELECT offer_key, coupon_code, warranty_type, availability, cash_price, observed_at + INTERVAL 1 SECOND * (obs_id % 80000) AS t FROM fx_observations) GROUP BY 1
    """,
)
def merged_projection(t: DriverTables) -> DataFrame:
    shape = lambda df: df.select(
        "offer_key", (F.col("observed_at") + F.make_dt_interval(secs=F.col("obs_id") % 80000)).alias("observed_at"), "cash_price", "coupon_code", "warranty_type", "availability"
    )
    old, new = _halves(t)
    policies = {"coupon_code": "keep_non_null", "warranty_type": "first", "availability": ("sticky", ["out_of_stock"])}
    return merge.merge_latest(shape(old), shape(new), ["offer_key"], "observed_at", policies)


@check(
    "merged_titles",
    """
    WITH l AS (SELECT variant_id, obs_id * 100000 + store_id AS seen, concat(availability, '-', store_id) AS title, availability, warranty_months AS w FROM fx_observations),
    m AS (SELECT variant_id, availability, max(seen) AS v FROM l GROUP BY 1, 2),
    j AS (SELECT variant_id, string_agg(concat(availability, ':', v), ',' ORDER BY availability) AS metadata FROM m GROUP BY 1)
    SELECT variant_id, max(seen) AS seen, length(arg_max(title, (length(title), -seen))) AS title_length, metadata FROM l JOIN j USING (variant_id) GROUP BY variant_id, metadata
    """,
)
def merged_titles(t: DriverTables) -> DataFrame:
    at = F.col("obs_id") * 100000 + F.col("store_id")
    shape = lambda df: df.select(
        "variant_id", at.alias("seen"), F.concat_ws("-", "availability", "store_id").alias("title"), F.create_map("availability", at).alias("metadata")
    )
    old, new = _halves(t)
    rows = merge.merge_latest(shape(old), shape(new), ["variant_id"], "seen", {"title": "longest", "metadata": "map_concat"})
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return rows.select("variant_id", "seen", F.length("title").alias("title_length"), F.array_join(entries, ",").alias("metadata"))


@check(
    "late_rebuild_ignored",
    "SELECT offer_key, obs_id, CAST(cash_price AS DOUBLE) AS cash_price FROM fx_ranked_observations WHERE rn = 1",
)
def late_rebuild_ignored(t: DriverTables) -> DataFrame:
    old, new = (half.select("offer_key", "observed_at", "obs_id", "cash_price") for half in _halves(t))
    newest = latest_per(old.unionByName(new), ["offer_key"], ["observed_at", "obs_id"])
    stale = latest_per(old, ["offer_key"], ["observed_at", "obs_id"])
    both = newest.unionByName(stale).withColumn("at", F.struct("observed_at", "obs_id"))
    return latest_per(both, ["offer_key"], ["at"]).select("offer_key", "obs_id", "cash_price")


@check(
    "audit_trail",
    """
    WITH s AS (SELECT *, concat('{"s_acctbal":', CASE WHEN s_nationkey % 2 = 0 THEN CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) ELSE 'null' END, ',"s_name":"', s_name,
        '","s_nationkey":', s_nationkey, ',"s_suppkey":', s_suppkey, '}') AS j FROM supplier),
    a AS (SELECT s_suppkey AS k, j AS b FROM s WHERE s_nationkey <> 3),
    z AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey = 5 THEN replace(j, 'Supplier#', 'Merchant ') ELSE j END AS b FROM s WHERE s_nationkey <> 4)
    SELECT CAST(k AS VARCHAR) AS entity_id, CASE WHEN a.b IS NULL THEN 'insert' WHEN z.b IS NULL THEN 'delete' ELSE 'update' END AS action,
      a.b AS before_data, z.b AS after_data
    FROM a FULL JOIN z USING (k) WHERE a.b IS DISTINCT FROM z.b
    """,
)
def audit_trail(t: DriverTables) -> DataFrame:
    s = t.supplier.withColumn("s_acctbal", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_acctbal").cast("decimal(18,2)")))
    renamed = F.when(F.col("s_nationkey") == 5, F.replace("s_name", F.lit("Supplier#"), F.lit("Merchant "))).otherwise(F.col("s_name"))
    after = s.filter("s_nationkey <> 4").withColumn("s_name", renamed)
    return merge.audit_diff(s.filter("s_nationkey <> 3"), after, "s_suppkey")


def _plan_states(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    border = F.lit(BORDER).cast("timestamp_ntz")
    plans = t.fx_plans
    return (
        latest_per(plans.filter(F.col("observed_at") < border), ["plan_key"], ["observed_at", "plan_id"]),
        latest_per(plans.filter(F.col("observed_at") >= border), ["plan_key"], ["observed_at", "plan_id"]),
    )


_STATES = """
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_key ORDER BY observed_at DESC, plan_id DESC) AS rn FROM fx_plans WHERE observed_at < TIMESTAMP '1999-01-01') WHERE rn = 1),
    z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_key ORDER BY observed_at DESC, plan_id DESC) AS rn FROM fx_plans WHERE observed_at >= TIMESTAMP '1999-01-01') WHERE rn = 1)"""


@check(
    "plan_changes",
    f"""
    WITH {_STATES} SELECT z.plan_key, CASE WHEN a.plan_key IS NULL THEN 'first_seen'
      WHEN (z.months, z.periodic_payment, z.down_payment, z.admin_fees, z.total_published, z.interest_free, z.starting_from_only, z.ends_at)
        IS DISTINCT FROM (a.months, a.periodic_payment, a.down_payment, a.admin_fees, a.total_published, a.interest_free, a.starting_from_only, a.ends_at)
      THEN 'plan_changed' END AS change_type FROM z LEFT JOIN a USING (plan_key)
    """,
)
def plan_changes(t: DriverTables) -> DataFrame:
    old, new = _plan_states(t)
    return merge.plan_changes(new, old).select("plan_key", "change_type")


@check(
    "unseen_plans",
    f"""
    WITH {_STATES} SELECT plan_key, 'not_seen_in_latest_scan' AS extraction_status, 1 AS consecutive_failures, COALESCE(a.ends_at >= {{as_of}}, true) AS active
    FROM a WHERE a.active AND plan_key NOT IN (SELECT plan_key FROM z)
    """,
)
def unseen_plans(t: DriverTables) -> DataFrame:
    old, new = _plan_states(t)
    rows = merge.mark_unseen(old.withColumn("consecutive_failures", F.lit(0)), new, F.lit(AS_OF).cast("timestamp_ntz"))
    return rows.select("plan_key", "extraction_status", "consecutive_failures", "active")


@check("unmapped_stores", "SELECT store_id FROM fx_stores WHERE store_id NOT IN (SELECT store_id FROM fx_listings WHERE url_type = 'product' AND direct_url_status = 'conflict' AND match_confidence = 'low')")
def unmapped_stores(t: DriverTables) -> DataFrame:
    listed = t.fx_listings.filter("url_type = 'product' AND direct_url_status = 'conflict' AND match_confidence = 'low'")
    return merge.without(t.fx_stores.select("store_id"), listed.select("store_id"), ["store_id"])


@check(
    "failed_run_mappings",
    """
    WITH f AS (SELECT DISTINCT store_id, concat('https://shop', store_id, '.example.com/products/item-', task_id % 2000) AS u FROM fx_tasks WHERE status = 'failed')
    SELECT DISTINCT mapping_id FROM fx_listings l JOIN f ON f.store_id = l.store_id AND (f.u = l.source_url OR f.u = l.direct_product_url)
    """,
)
def failed_run_mappings(t: DriverTables) -> DataFrame:
    url = F.concat(F.lit("https://shop"), F.col("store_id").cast("string"), F.lit(".example.com/products/item-"), (F.col("task_id") % 2000).cast("string"))
    tasks = t.fx_tasks.withColumn("source_url", url)
    return merge.restrict_to_failed(t.fx_listings, tasks, ["source_url", "direct_product_url"]).select("mapping_id")


@check(
    "resolved_aliases",
    """
    WITH a AS (SELECT v.variant_id, min(c.variant_id) AS canon FROM fx_variants v JOIN fx_variants c ON c.canonical_name = v.canonical_name GROUP BY 1)
    SELECT canon AS variant_id, count(*) AS observations FROM fx_observations JOIN a USING (variant_id) GROUP BY 1
    """,
)
def resolved_aliases(t: DriverTables) -> DataFrame:
    named = t.fx_variants.select("variant_id", "canonical_name")
    canonical = named.groupBy("canonical_name").agg(F.min("variant_id").alias("canonical_variant_id"))
    aliases = named.join(canonical, "canonical_name").filter("variant_id <> canonical_variant_id").withColumnRenamed("variant_id", "alias_variant_id")
    return merge.resolve_alias(t.fx_observations, aliases).groupBy("variant_id").agg(F.count(F.lit(1)).alias("observations"))


@check(
    "set_operations",
    """
    WITH a AS (SELECT DISTINCT variant_id, store_id FROM fx_observations WHERE availability = 'available'), b AS (SELECT DISTINCT variant_id, store_id FROM fx_observations WHERE availability = 'limited')
    SELECT 'minus' AS op, variant_id, store_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'common', variant_id, store_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    """,
)
def set_operations(t: DriverTables) -> DataFrame:
    obs = t.fx_observations.select("variant_id", "store_id", "availability")
    a, b = obs.filter("availability = 'available'").drop("availability"), obs.filter("availability = 'limited'").drop("availability")
    minus, common = merge.set_minus(a, b), merge.set_common(a, b)
    return merge.union_candidates(minus.withColumn("op", F.lit("minus")), common.withColumn("op", F.lit("common"))).select("op", "variant_id", "store_id")


@check(
    "same_category_pairs",
    """
    WITH c AS (SELECT DISTINCT CASE WHEN brand = 'Brand#3' THEN NULL ELSE category_id END AS category, brand FROM fx_variants)
    SELECT a.category, a.brand, count(*) AS peers FROM c a JOIN c b ON a.category IS NOT DISTINCT FROM b.category GROUP BY 1, 2
    """,
)
def same_category_pairs(t: DriverTables) -> DataFrame:
    category = F.when(F.col("brand") != "Brand#3", F.col("category_id"))
    brands = t.fx_variants.select(category.alias("category"), "brand").distinct()
    sizes = brands.groupBy("category").agg(F.count(F.lit(1)).alias("peers")).withColumnRenamed("category", "_c")
    return brands.join(sizes, F.col("category").eqNullSafe(F.col("_c"))).select("category", "brand", "peers")


@check(
    "offer_statistics",
    """
    SELECT store_id, availability, count(*) AS offers, CAST(min(cash_price) AS DOUBLE) AS low, CAST(max(cash_price) AS DOUBLE) AS high, CAST(sum(cash_price) AS DOUBLE) AS total,
      count(*) FILTER (anomaly_status = 'clear') AS clear_offers, CAST(min(cash_price) FILTER (anomaly_status = 'clear') AS DOUBLE) AS clear_low,
      count(DISTINCT variant_id) AS variants, count(DISTINCT variant_id) FILTER (anomaly_status = 'review') AS review_variants, bool_or(pickup_available) AS any_pickup
    FROM fx_offers GROUP BY 1, 2
    """,
)
def offer_statistics(t: DriverTables) -> DataFrame:
    clear = F.col("anomaly_status") == "clear"
    return t.fx_offers.groupBy("store_id", "availability").agg(
        F.count(F.lit(1)).alias("offers"), F.min("cash_price").alias("low"), F.max("cash_price").alias("high"), F.sum("cash_price").alias("total"),
        F.count_if(clear).alias("clear_offers"), F.min(F.when(clear, F.col("cash_price"))).alias("clear_low"),
        F.count_distinct("variant_id").alias("variants"), F.count_distinct(F.when(F.col("anomaly_status") == "review", F.col("variant_id"))).alias("review_variants"),
        F.bool_or("pickup_available").alias("any_pickup"),
    )


@check(
    "latest_known_coupon",
    "SELECT variant_id, arg_max(coupon_code, (observed_at, obs_id)) FILTER (coupon_code IS NOT NULL) AS coupon_code FROM fx_observations GROUP BY 1",
)
def latest_known_coupon(t: DriverTables) -> DataFrame:
    order = F.when(F.col("coupon_code").isNotNull(), F.struct("observed_at", "obs_id"))
    return t.fx_observations.groupBy("variant_id").agg(F.max_by("coupon_code", order).alias("coupon_code"))


@check("priced_only", "SELECT variant_id, count(*) AS n FROM fx_offers WHERE anomaly_status = 'review' GROUP BY 1 HAVING min(cash_price) IS NOT NULL AND count(*) > 3")
def priced_only(t: DriverTables) -> DataFrame:
    grouped = t.fx_offers.filter("anomaly_status = 'review'").groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.min("cash_price").alias("low"))
    return grouped.filter("low IS NOT NULL AND n > 3").drop("low")


@check(
    "latest_variant_per_product",
    "SELECT product_id, max(variant_id) AS variant_id FROM fx_variants GROUP BY 1",
)
def latest_variant_per_product(t: DriverTables) -> DataFrame:
    return latest_per(t.fx_variants.select("product_id", "variant_id"), ["product_id"], ["variant_id"])


@check(
    "data_quality_summary",
    """
    SELECT (SELECT count(DISTINCT product_id) FROM fx_variants WHERE active) AS products, (SELECT count(*) FROM fx_variants WHERE active) AS variants,
      (SELECT count(*) FROM fx_variants WHERE source_status = 'catalog_provisional') AS provisional_variants, (SELECT count(*) FROM fx_stores WHERE active) AS active_stores,
      (SELECT count(*) FROM fx_listings WHERE active) AS active_mappings, (SELECT count(*) FROM fx_listings WHERE active AND match_confidence IN ('low', 'medium')) AS weak_mappings,
      (SELECT count(*) FROM fx_offers WHERE active) AS cash_offers, (SELECT strftime(max(last_success_at), '%Y-%m-%d %H:%M:%S') FROM fx_offers) AS latest_cash_update,
      (SELECT count(*) FROM fx_plans WHERE active) AS installment_plans, (SELECT strftime(max(last_success_at), '%Y-%m-%d %H:%M:%S') FROM fx_plans) AS latest_installment_update,
      (SELECT count(*) FROM fx_reports WHERE status = 'open') AS open_reviews, (SELECT count(*) FROM fx_reports WHERE status = 'open' AND severity IN ('high', 'critical')) AS urgent_reviews
    """,
)
def data_quality_summary(t: DriverTables) -> DataFrame:
    return dq.quality_summary(t.fx_variants, t.fx_stores, t.fx_listings, t.fx_offers, t.fx_plans, t.fx_reports)


@check(
    "rule_violations",
    """
    SELECT offer_id AS key, 'fresh' AS rule FROM fx_offers WHERE last_success_at IS NULL UNION ALL SELECT offer_id, 'cheap' FROM fx_offers WHERE cash_price >= 50000
    """,
)
def rule_violations(t: DriverTables) -> DataFrame:
    rules = {"price": F.col("cash_price") > 0, "fresh": F.col("last_success_at").isNotNull(), "cheap": F.col("cash_price") < 50000}
    return dq.violations(t.fx_offers, "offer_id", rules)


@check("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: DriverTables) -> DataFrame:
    return dq.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@check("orphan_events", "SELECT event_id, user_id AS store_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def orphan_events(t: DriverTables) -> DataFrame:
    return dq.orphans(t.events.select("event_id", F.col("user_id").alias("store_id")), t.fx_stores, "store_id")


@check(
    "table_parity",
    """
    SELECT 'offers' AS table_name, (SELECT count(*) FROM fx_observations) AS source_rows, (SELECT count(*) FROM fx_offers) AS target_rows, false AS matches
    UNION ALL SELECT 'variants', (SELECT count(*) FROM part), (SELECT count(*) FROM fx_variants), true
    """,
)
def table_parity(t: DriverTables) -> DataFrame:
    return dq.parity({"offers": t.fx_observations, "variants": t.part}, {"offers": t.fx_offers, "variants": t.fx_variants})


@check(
    "count_totals",
    "SELECT 'stores' AS metric, count(*) AS value FROM fx_stores UNION ALL SELECT 'active stores', count(*) FROM fx_stores WHERE active UNION ALL SELECT 'events', count(*) FROM events",
)
def count_totals(t: DriverTables) -> DataFrame:
    return dq.count_totals({"stores": (t.fx_stores, None), "active stores": (t.fx_stores, F.col("active")), "events": (t.events, None)})


@check(
    "refreshed_quality",
    f"WITH {QUALITY} SELECT q.store_id, CASE WHEN s.active THEN 0 ELSE q.sample_size END AS sample_size FROM qual q JOIN fx_stores s USING (store_id)",
)
def refreshed_quality(t: DriverTables) -> DataFrame:
    fresh = quality(t).select("store_id", "sample_size", "calculated_at")
    at = F.lit(AS_OF).cast("timestamp_ntz")
    age = F.when(F.col("active"), F.expr("INTERVAL '2' HOUR")).otherwise(F.expr("INTERVAL '9' HOUR"))
    stored = t.fx_stores.select("store_id", F.lit(0).cast("bigint").alias("sample_size"), (at - age).alias("calculated_at"))
    return dq.refresh_stale(stored, fresh, AS_OF, 6).select("store_id", "sample_size")


@check(
    "dimension_products",
    """
    SELECT DISTINCT concat('PR-', upper(substr(sha256(lower(concat_ws('|', brand, model, section))), 1, 20))) AS product_id,
      concat('BR-', upper(substr(sha256(lower(brand)), 1, 20))) AS brand_id, concat('CAT-', upper(substr(sha256(lower(section)), 1, 20))) AS category_id, model FROM fx_variants
    """,
)
def dimension_products(t: DriverTables) -> DataFrame:
    return runs.build_dimensions(t.fx_variants)["products"]


@check(
    "dimension_attributes",
    """
    SELECT variant_id, unnest(['storage_gb', 'ram_gb', 'color']) AS attribute, unnest([storage_gb::VARCHAR, ram_gb::VARCHAR, color]) AS value FROM fx_variants
    """,
)
def dimension_attributes(t: DriverTables) -> DataFrame:
    return runs.build_dimensions(t.fx_variants)["attributes"]


@check(
    "dimension_identifiers",
    "SELECT variant_id, unnest(['gtin', 'manufacturer_sku']) AS kind, unnest([gtin, manufacturer_sku]) AS value FROM fx_variants",
)
def dimension_identifiers(t: DriverTables) -> DataFrame:
    return runs.build_dimensions(t.fx_variants)["identifiers"]


@check(
    "catalog_presence",
    """
    SELECT l.mapping_id, v.canonical_name, s.store_name, CAST(o.cash_price AS DOUBLE) AS cash_price, COALESCE(p.n, 0) AS plan_count
    FROM fx_listings l JOIN fx_variants v USING (variant_id) LEFT JOIN fx_stores s ON s.store_id = l.store_id
      LEFT JOIN fx_offers o ON o.variant_id = l.variant_id AND o.store_id = l.store_id
      LEFT JOIN (SELECT variant_id, store_id, count(*) AS n FROM fx_plans GROUP BY 1, 2) p ON p.variant_id = l.variant_id AND p.store_id = l.store_id
    """,
)
def catalog_presence(t: DriverTables) -> DataFrame:
    source = lambda df: df.withColumnRenamed("store_id", "source_id")
    rows = runs.build_catalog(
        t.fx_variants.select("variant_id", "canonical_name"), source(t.fx_listings.select("mapping_id", "variant_id", "store_id")),
        source(t.fx_offers.select("variant_id", "store_id", "cash_price")), source(t.fx_plans.select("variant_id", "store_id")), source(t.fx_stores.select("store_id", "store_name")),
    )
    return rows.select("mapping_id", "canonical_name", "store_name", "cash_price", "plan_count")


@check("star_schema_scan", "SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def star_schema_scan(t: DriverTables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
