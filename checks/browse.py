"""Facet, directory, pagination, search and grouping checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.matching import TRI
from checks.serving import PLAN_OK, PUBLIC, SUMMARY, public_offers, summary
from offerlake.functions import specs as spec_columns
from offerlake.operators import standardize
from offerlake.plans import browse, search, views
from offerlake.sources.fixtures import AS_OF, DriverTables

SHOWN = "source_status <> 'catalog_provisional'"


@check("section_facets", f"SELECT section, count(*) AS variant_count FROM fx_variants WHERE {SHOWN} GROUP BY 1")
def section_facets(t: DriverTables) -> DataFrame:
    return browse.facets(t.fx_variants, "section")


@check("model_facets", f"SELECT model, count(*) AS variant_count FROM fx_variants WHERE {SHOWN} AND section = 'ECONOMY' AND brand = 'Brand#1' GROUP BY 1")
def model_facets(t: DriverTables) -> DataFrame:
    return browse.facets(t.fx_variants, "model", {"section": "ECONOMY", "brand": "Brand#1"})


@check("brand_summary", "SELECT brand, count(*) AS variants, count(DISTINCT model) AS models FROM fx_variants GROUP BY 1")
def brand_summary(t: DriverTables) -> DataFrame:
    return browse.brand_summary(t.fx_variants)


@check("spec_dimensions", "SELECT DISTINCT color AS name, CASE color WHEN 'red' THEN 0 WHEN 'blue' THEN 1 ELSE 2 END AS position FROM fx_variants")
def spec_dimensions(t: DriverTables) -> DataFrame:
    rows = t.fx_variants.select(F.create_map("color", F.lit("1")).alias("specs"))
    return browse.spec_dimensions(rows, ["red", "blue"])


@check(
    "ranked_offers",
    f"""
    WITH {PUBLIC} SELECT offer_id, variant_id, row_number() OVER (PARTITION BY variant_id ORDER BY NOT eligible_for_ranking,
      COALESCE(comparable_total, cash_price), cash_price, CASE computed_freshness WHEN 'fresh' THEN 0 WHEN 'late' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END,
      CASE availability WHEN 'available' THEN 0 WHEN 'limited' THEN 1 WHEN 'preorder' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END, store_name, offer_id) AS offer_rank FROM pub
    """,
)
def ranked_offers(t: DriverTables) -> DataFrame:
    return browse.rank_offers(public_offers(t)).select("offer_id", "variant_id", "offer_rank")


@check(
    "ranked_visible_plans",
    f"""
    SELECT i.plan_id, i.variant_id, row_number() OVER (PARTITION BY i.variant_id ORDER BY NOT COALESCE({PLAN_OK}, false),
      CASE WHEN i.last_success_at IS NULL THEN 3 WHEN i.last_success_at >= {{as_of}} - INTERVAL 735 MINUTE THEN 0
        WHEN i.last_success_at >= {{as_of}} - INTERVAL 1470 MINUTE THEN 1 ELSE 2 END,
      i.starting_from_only, i.total_published NULLS LAST, i.periodic_payment, i.months NULLS LAST, s.store_name, i.plan_id) AS plan_rank
    FROM fx_plans i JOIN fx_stores s USING (store_id) LEFT JOIN fx_offers o ON o.offer_key = i.cash_offer_key WHERE i.active
    """,
)
def ranked_visible_plans(t: DriverTables) -> DataFrame:
    plans = views.public_installment_offers(t.fx_plans, t.fx_variants, t.fx_stores, t.fx_offers, AS_OF)
    return browse.rank_visible_plans(plans).select("plan_id", "variant_id", "plan_rank")


@check("top_offers", "SELECT offer_key, CAST(cash_price AS DOUBLE) AS cash_price FROM fx_offers ORDER BY fx_offers.cash_price, offer_key LIMIT 50")
def top_offers(t: DriverTables) -> DataFrame:
    return browse.top_k(t.fx_offers, ["cash_price", "offer_key"], 50).select("offer_key", "cash_price")


@check(
    "top_offers_per_store",
    """
    SELECT store_id, offer_key, rank FROM (SELECT store_id, offer_key, row_number() OVER (PARTITION BY store_id ORDER BY cash_price, offer_key) AS rank FROM fx_offers)
    WHERE rank <= 5
    """,
)
def top_offers_per_store(t: DriverTables) -> DataFrame:
    return browse.top_k(t.fx_offers, ["cash_price", "offer_key"], 5, ["store_id"]).select("store_id", "offer_key", "rank")


@check(
    "offer_page",
    """
    SELECT offer_key, (SELECT count(*) FROM fx_offers) AS total, true AS has_more FROM fx_offers ORDER BY offer_key LIMIT 24 OFFSET 48
    """,
)
def offer_page(t: DriverTables) -> DataFrame:
    return browse.page(t.fx_offers, ["offer_key"], 24, 48).select("offer_key", "total", "has_more")


@check("keyset_page", "SELECT offer_key FROM fx_offers WHERE offer_key > '5' ORDER BY 1 LIMIT 100")
def keyset_page(t: DriverTables) -> DataFrame:
    return browse.next_batch(t.fx_offers.select("offer_key"), "offer_key", "5", 100)


@check(
    "earliest_due_sources",
    """
    SELECT DISTINCT ON (store_id) store_id, source_id, source_url FROM fx_discovery WHERE enabled AND next_scan_at <= {as_of}
    ORDER BY store_id, next_scan_at, source_id
    """,
)
def earliest_due_sources(t: DriverTables) -> DataFrame:
    return browse.earliest_due(t.fx_discovery, F.lit(AS_OF).cast("timestamp_ntz")).select("store_id", "source_id", "source_url")


@check("first_seen_offers", "SELECT variant_id, store_id, min(obs_id) AS obs_id FROM fx_observations GROUP BY 1, 2")
def first_seen_offers(t: DriverTables) -> DataFrame:
    rows = t.fx_observations.select("variant_id", "store_id", "obs_id")
    return browse.first_seen(rows, ["variant_id", "store_id"], ["obs_id"])


@check(
    "priced_directory",
    f"""
    WITH {PUBLIC}, o AS (SELECT variant_id, min(cash_price) AS a, min(cash_price) FILTER (eligible_for_ranking) AS b,
        min(COALESCE(comparable_total, cash_price)) FILTER (eligible_for_ranking) AS c, min(comparable_total) FILTER (eligible_for_ranking) AS d,
        count(*) AS n, count(*) FILTER (eligible_for_ranking) AS k FROM pub GROUP BY 1)
    SELECT variant_id, CAST(a AS DOUBLE) AS lowest_cash_price, CAST(b AS DOUBLE) AS lowest_confirmed_cash_price, CAST(c AS DOUBLE) AS lowest_final_cost,
      CAST(d AS DOUBLE) AS lowest_delivered_total, n AS cash_offer_count, k AS confirmed_cash_offer_count, n - k AS review_cash_offer_count,
      k = 0 AND n > 0 AS cash_price_review_required
    FROM o JOIN fx_variants v USING (variant_id) WHERE v.active AND {SHOWN}
    """,
)
def priced_directory(t: DriverTables) -> DataFrame:
    rows = browse.priced_directory(public_offers(t), t.fx_variants)
    return rows.drop("canonical_name", "section", "product_type", "brand", "model", "variant_name")


@check(
    "priced_directory_page",
    f"""
    WITH {PUBLIC}, o AS (SELECT variant_id, min(cash_price) AS a, min(COALESCE(comparable_total, cash_price)) FILTER (eligible_for_ranking) AS c,
        count(*) FILTER (eligible_for_ranking) AS k FROM pub GROUP BY 1),
    r AS (SELECT variant_id, v.canonical_name, k, c, a FROM o JOIN fx_variants v USING (variant_id) WHERE v.active AND {SHOWN} AND lower(v.canonical_name) LIKE '%ring%')
    SELECT variant_id, canonical_name, k AS confirmed_cash_offer_count, (SELECT count(*) FROM r) AS total FROM r
    ORDER BY k DESC, COALESCE(c, a), canonical_name, variant_id LIMIT 24
    """,
)
def priced_directory_page(t: DriverTables) -> DataFrame:
    rows = browse.priced_directory(public_offers(t), t.fx_variants, query="Ring")
    return browse.page(rows, browse.directory_order(), 24).select("variant_id", "canonical_name", "confirmed_cash_offer_count", "total")


@check(
    "priced_plan_directory",
    f"""
    WITH p AS (SELECT i.*, COALESCE({PLAN_OK}, false) AS ok FROM fx_plans i LEFT JOIN fx_offers o ON o.offer_key = i.cash_offer_key WHERE i.active),
    g AS (SELECT variant_id, count(*) AS n, count(*) FILTER (ok) AS k, min(periodic_payment) FILTER (ok) AS a, min(total_published) FILTER (ok) AS b,
        min(periodic_payment) AS c, min(total_published) AS d FROM p GROUP BY 1)
    SELECT variant_id, n AS installment_plan_count, k AS confirmed_installment_plan_count, n - k AS review_installment_plan_count,
      CAST(a AS DOUBLE) AS lowest_periodic_payment, CAST(b AS DOUBLE) AS lowest_installment_total, CAST(c AS DOUBLE) AS lowest_visible_periodic_payment,
      CAST(d AS DOUBLE) AS lowest_visible_installment_total, k = 0 AND n > 0 AS installment_price_review_required
    FROM g JOIN fx_variants v USING (variant_id) WHERE v.active AND {SHOWN}
    """,
)
def priced_plan_directory(t: DriverTables) -> DataFrame:
    plans = views.public_installment_offers(t.fx_plans, t.fx_variants, t.fx_stores, t.fx_offers, AS_OF)
    rows = browse.priced_plan_directory(plans, t.fx_variants)
    return rows.drop("canonical_name", "section", "product_type", "brand", "model", "variant_name")


@check(
    "variant_listing",
    f"""
    WITH {SUMMARY} SELECT variant_id, s.canonical_name, CAST(lowest_cash_price AS DOUBLE) AS lowest_cash_price, cash_offer_count
    FROM summ s JOIN fx_variants v USING (variant_id) WHERE {SHOWN} AND v.section = 'STANDARD'
    """,
)
def variant_listing(t: DriverTables) -> DataFrame:
    rows = browse.list_variants(t.fx_variants, summary(t), {"section": "STANDARD"})
    return rows.select("variant_id", "canonical_name", "lowest_cash_price", "cash_offer_count")


@check(
    "materialized_comparisons",
    f"""
    WITH {PUBLIC}, r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY NOT eligible_for_ranking,
      COALESCE(comparable_total, cash_price), cash_price, CASE computed_freshness WHEN 'fresh' THEN 0 WHEN 'late' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END,
      CASE availability WHEN 'available' THEN 0 WHEN 'limited' THEN 1 WHEN 'preorder' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END, store_name, offer_id) AS offer_rank FROM pub)
    SELECT variant_id, offer_rank, offer_id, store_name, CAST(comparable_total AS DOUBLE) AS comparable_total FROM r
    """,
)
def materialized_comparisons(t: DriverTables) -> DataFrame:
    ranked = browse.rank_offers(public_offers(t))
    return browse.materialize_comparisons(ranked).select("variant_id", "offer_rank", "offer_id", "store_name", "comparable_total")


@check(
    "model_groups",
    """
    SELECT concat(trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')), '|', model) AS model_key, arg_min(variant_id, (variant_name, variant_id)) AS representative_id,
      min(brand) AS brand, min(section) AS section, count(*) AS variant_count FROM fx_variants GROUP BY 1
    """,
)
def model_groups(t: DriverTables) -> DataFrame:
    return browse.model_groups(t.fx_variants)


def _leaves(t: DriverTables) -> DataFrame:
    """Taxonomy leaves from the catalogue itself: one open leaf per type, one leaf per colour of gears."""
    v = t.fx_variants.select("section", F.col("product_type").alias("type"), "color").distinct()
    narrow = v.filter("type = 'gear'").select("section", "type", F.col("color").alias("subtype"), F.concat_ws("/", "section", "type", "color").alias("leaf"), F.lit(0).alias("position"))
    wide = v.select("section", "type").distinct().filter("type <> 'bolt'")
    return narrow.unionByName(wide.select("section", "type", F.lit(None).cast("string").alias("subtype"), F.concat_ws("/", "section", "type").alias("leaf"), F.lit(1).alias("position")))


@check(
    "taxonomy_leaves",
    """
    SELECT variant_id, CASE product_type WHEN 'gear' THEN concat_ws('/', section, product_type, color) WHEN 'bolt' THEN NULL ELSE concat_ws('/', section, product_type) END AS leaf
    FROM fx_variants
    """,
)
def taxonomy_leaves(t: DriverTables) -> DataFrame:
    return browse.assign_taxonomy(t.fx_variants.withColumn("subtype", F.col("color")), _leaves(t))


@check(
    "taxonomy_counts",
    """
    SELECT CASE product_type WHEN 'gear' THEN concat_ws('/', section, product_type, color) ELSE concat_ws('/', section, product_type) END AS leaf, count(*) AS product_count
    FROM fx_variants WHERE product_type <> 'bolt' GROUP BY 1
    """,
)
def taxonomy_counts(t: DriverTables) -> DataFrame:
    return browse.taxonomy_counts(taxonomy_leaves(t))


@check(
    "brand_directory",
    """
    SELECT brand, count(DISTINCT variant_id) AS product_count, count(DISTINCT store_id) AS store_count, replace(lower(brand), '#', '-') AS slug
    FROM fx_listings JOIN fx_variants v USING (variant_id) WHERE match_confidence = 'high' GROUP BY 1, 4
    """,
)
def brand_directory(t: DriverTables) -> DataFrame:
    verified = t.fx_listings.filter("match_confidence = 'high'")
    return browse.directories(verified, t.fx_variants.select("variant_id", "brand"), "brand")


@check(
    "basic_search",
    f"""
    WITH v AS (SELECT variant_id, canonical_name, {TRI.format('canonical_name')} AS g FROM fx_variants WHERE {SHOWN} AND
        (lower(canonical_name) LIKE '%blue gear%' OR model LIKE '%blue gear%')),
    q AS (SELECT {TRI.format("'blue gear'")} AS h)
    SELECT variant_id, canonical_name, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS relevance FROM v, q
    ORDER BY 3 DESC, canonical_name, variant_id LIMIT 20
    """,
)
def basic_search(t: DriverTables) -> DataFrame:
    rows = search.search(t.fx_variants, "Blue  GEAR")
    return rows.select("variant_id", "canonical_name", F.round("relevance", 6).alias("relevance"))


@check(
    "smart_search",
    f"""
    WITH q AS (SELECT DISTINCT model AS query_id, model AS key, {TRI.format('model')} AS h FROM fx_variants),
    live AS (SELECT variant_id, canonical_name, lower(canonical_name) AS name, lower(concat_ws(' ', canonical_name, brand, model, variant_name, manufacturer_sku, gtin,
        concat(ram_gb, ' gb ram'), concat(storage_gb, ' gb storage'))) AS doc FROM fx_variants WHERE {SHOWN} AND active),
    g AS (SELECT *, {TRI.format('doc')} AS dg, {TRI.format('name')} AS ng FROM live),
    s AS (SELECT query_id, variant_id, canonical_name, contains(doc, key) AS has,
        len(list_intersect(dg, h)) / (len(dg) + len(h) - len(list_intersect(dg, h))) AS ds,
        len(list_intersect(ng, h)) / (len(ng) + len(h) - len(list_intersect(ng, h))) AS ns FROM g, q),
    r AS (SELECT *, GREATEST(ds, ns) AS score FROM s WHERE has OR ds > 0.12 OR ns > 0.18),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_name, variant_id) AS rank FROM r)
    SELECT query_id, rank, variant_id, round(score, 6) AS search_score, CASE WHEN rank = 1 AND score >= 0.25 THEN canonical_name END AS suggestion FROM k WHERE rank <= 10
    """,
)
def smart_search(t: DriverTables) -> DataFrame:
    queries = t.fx_variants.select(F.col("model").alias("query_id"), F.col("model").alias("query")).distinct()
    variants = standardize.with_search_documents(t.fx_variants)
    aliases = t.fx_variants.filter("active AND source_status <> 'catalog_provisional'").select("variant_id", F.lower("canonical_name").alias("normalized_alias"))
    rows = search.smart_search(queries, variants, aliases, 10)
    return rows.select("query_id", "rank", "variant_id", F.round("search_score", 6).alias("search_score"), "suggestion")


@check(
    "token_search",
    f"""
    WITH q AS (SELECT DISTINCT color || ' ' || substr(product_type, 2) AS query_id, color AS a, substr(product_type, 2) AS b FROM fx_variants),
    d AS (SELECT variant_id, canonical_name, lower(concat_ws(' ', brand, model, canonical_name, variant_name)) AS t FROM fx_variants WHERE {SHOWN}),
    r AS (SELECT query_id, variant_id, canonical_name, row_number() OVER (PARTITION BY query_id ORDER BY canonical_name, variant_id) AS rank
      FROM q, d WHERE contains(t, a) AND contains(t, b))
    SELECT query_id, rank, variant_id, canonical_name FROM r WHERE rank <= 16
    """,
)
def token_search(t: DriverTables) -> DataFrame:
    q = t.fx_variants.select(F.concat_ws(" ", "color", F.expr("substr(product_type, 2)")).alias("query_id")).distinct()
    return search.token_search(q.withColumn("query", F.col("query_id")), t.fx_variants)


def _spec_variants(t: DriverTables) -> DataFrame:
    published = F.create_map(F.lit("type"), F.col("product_type"))
    return t.fx_variants.withColumn("specs", spec_columns.spec_map(published, F.col("ram_gb"), F.col("storage_gb"), F.col("color")))


def _costs(t: DriverTables) -> DataFrame:
    return t.fx_offers.groupBy("variant_id").agg(
        F.min("cash_price").alias("lowest_final_cost"), F.count_distinct("store_id").alias("confirmed_store_count")
    )


@check(
    "product_alternatives",
    """
    WITH c AS (SELECT variant_id, CAST(min(cash_price) AS DOUBLE) AS price FROM fx_offers GROUP BY 1),
    v AS (SELECT *, [product_type, ram_gb::VARCHAR, storage_gb::VARCHAR, color] AS s FROM fx_variants JOIN c USING (variant_id)),
    req AS (SELECT brand, arg_min(variant_id, (price, variant_id)) AS variant_id FROM v GROUP BY 1),
    p AS (SELECT a.variant_id, b.variant_id AS alternative_id, a.price AS ap, b.price - a.price AS gap, a.brand = b.brand AS sb, a.model = b.model AS sm,
        list_sum([CASE WHEN a.s[i] = b.s[i] THEN 1.0::DOUBLE WHEN contains(a.s[i], b.s[i]) OR contains(b.s[i], a.s[i]) THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END FOR i IN [1, 2, 3, 4]]) / 4 AS sim
      FROM v a JOIN req r ON r.variant_id = a.variant_id JOIN v b ON b.category_id = a.category_id AND b.variant_id <> a.variant_id AND b.active),
    k AS (SELECT *, round(sim * 100 - abs(gap) / GREATEST(ap, 1) * 30, 6) AS rank_score FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY rank_score DESC, alternative_id) AS alternative_rank FROM k)
    SELECT variant_id, alternative_id, round(sim * 100, 2) AS similarity_score, round(gap, 2) AS price_gap, alternative_rank,
      CASE WHEN gap < 0 AND sim >= 0.45 THEN 'cheaper_similar' WHEN gap > 0 AND gap <= GREATEST(ap * 0.12, 1500) AND sim >= 0.55 THEN 'small_upgrade'
        WHEN NOT sb AND sim >= 0.5 THEN 'same_budget_other_brand' WHEN sb AND sm THEN 'different_capacity' ELSE 'similar' END AS alternative_type
    FROM r WHERE alternative_rank <= 12
    """,
)
def product_alternatives(t: DriverTables) -> DataFrame:
    costs = _costs(t)
    named = t.fx_variants.join(costs, "variant_id")
    requested = named.groupBy("brand").agg(F.min_by("variant_id", F.struct("lowest_final_cost", "variant_id")).alias("variant_id"))
    rows = browse.alternatives(requested, _spec_variants(t), costs)
    return rows.select(
        "variant_id", "alternative_id", "similarity_score", F.round("price_gap", 2).alias("price_gap"), "alternative_rank", "alternative_type"
    )


@check(
    "compared_products",
    """
    WITH c AS (SELECT variant_id, CAST(min(cash_price) AS DOUBLE) AS p, count(DISTINCT store_id) AS n FROM fx_offers GROUP BY 1),
    v AS (SELECT variant_id, p, n FROM fx_variants LEFT JOIN c USING (variant_id) WHERE variant_id IN (3, 11, 42))
    SELECT variant_id, round((1 - p / (SELECT max(p) FROM v)) * 45 + 35 + LEAST(n / 4, 1) * 20, 2) AS value_score FROM v
    """,
)
def compared_products(t: DriverTables) -> DataFrame:
    return browse.compare(_spec_variants(t), _costs(t), [3, 11, 42, 3]).select("variant_id", "value_score")


@check(
    "comparison_differences",
    """
    WITH v AS (SELECT variant_id, unnest(['type', 'RAM', 'التخزين', 'اللون']) AS name, unnest([product_type, ram_gb::VARCHAR, storage_gb::VARCHAR, color]) AS x
        FROM fx_variants WHERE variant_id IN (3, 11)),
    m AS (SELECT name, max(x) FILTER (variant_id = 3) AS "3", max(x) FILTER (variant_id = 11) AS "11" FROM v GROUP BY 1)
    SELECT * FROM m WHERE "3" IS DISTINCT FROM "11"
    """,
)
def comparison_differences(t: DriverTables) -> DataFrame:
    return browse.matrix_diff(browse.comparison_matrix(_spec_variants(t), [3, 11]))


@check(
    "offer_documents",
    """
    WITH o AS (SELECT variant_id, min(cash_price) AS lo, max(cash_price) AS hi, count(*) AS n FROM fx_offers GROUP BY 1)
    SELECT variant_id, concat('{"@type":"Product","name":"', brand, ' ', model, '","sku":"', variant_id, '","brand":"', brand, '"',
      CASE WHEN n > 0 THEN concat(',"offers":{"@type":"', CASE WHEN n > 1 THEN 'AggregateOffer' ELSE 'Offer' END, '","priceCurrency":"EGP","lowPrice":', lo, ',"highPrice":', hi, ',"offerCount":', n, '}') ELSE '' END, '}') AS document
    FROM fx_variants LEFT JOIN o USING (variant_id)
    """,
)
def offer_documents(t: DriverTables) -> DataFrame:
    return browse.offer_documents(t.fx_offers, t.fx_variants)
