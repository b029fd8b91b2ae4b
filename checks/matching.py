"""Matching and entity-resolution checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.standard import with_publishable
from offerlake.config import MATCHING
from offerlake.functions import ids
from offerlake.operators import matching
from offerlake.sources.fixtures import DriverTables

LIVE = "active AND source_status <> 'catalog_provisional'"


def items(t: DriverTables) -> DataFrame:
    """Items under an id that is unique (an order may hold one line number twice)."""
    return t.fx_items.withColumn("item_id", F.concat_ws("-", "item_id", "true_variant", "store_id", F.unix_date(F.to_date("last_seen_at"))))


ITEM_ID = "concat_ws('-', item_id, true_variant, store_id, date_diff('day', DATE '1970-01-01', last_seen_at::DATE))"


@check(
    "variant_keys",
    f"""
    SELECT variant_id, 'gtin' AS kind, gtin AS key FROM fx_variants WHERE {LIVE}
    UNION ALL SELECT variant_id, 'sku', lower(manufacturer_sku) FROM fx_variants WHERE {LIVE}
    UNION ALL SELECT variant_id, 'brand', regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g') FROM fx_variants WHERE {LIVE}
    UNION ALL SELECT variant_id, 'model_anchor', x FROM (SELECT DISTINCT variant_id, unnest(string_split(model, ' ')) AS x
      FROM fx_variants WHERE {LIVE}) WHERE length(x) >= 5
    """,
)
def variant_keys(t: DriverTables) -> DataFrame:
    return matching.variant_keys(t.fx_variants)


EXACT = f"""
    live AS (SELECT * FROM fx_variants WHERE {LIVE}),
    it AS (SELECT {ITEM_ID} AS iid, * FROM fx_items),
    hit AS (SELECT iid, v.variant_id, 200.0 AS score, 'catalog_exact_gtin' AS method FROM it JOIN live v ON v.gtin = it.gtin
      UNION ALL SELECT iid, v.variant_id, 185.0, 'catalog_exact_manufacturer_sku' FROM it
        JOIN live v ON lower(v.manufacturer_sku) = replace(it.sku, '-', ''))"""


@check("exact_matches", f"WITH {EXACT} SELECT iid AS item_id, variant_id, score, method FROM hit")
def exact_matches(t: DriverTables) -> DataFrame:
    return matching.match_exact(items(t), matching.variant_keys(t.fx_variants))


@check(
    "sku_in_text_matches",
    f"""WITH {EXACT} SELECT iid AS item_id, v.variant_id, 175.0 AS score, 'catalog_url_manufacturer_sku' AS method
        FROM it JOIN live v ON v.variant_id = it.true_variant WHERE normalized_url LIKE '%/mx%'""",
)
def sku_in_text_matches(t: DriverTables) -> DataFrame:
    return matching.match_sku_in_text(items(t), matching.variant_keys(t.fx_variants), matching.idle_codes(t.fx_variants))


@check("brand_model_matches")
def brand_model_matches(t: DriverTables) -> DataFrame:
    return matching.match_brand_model(items(t), t.fx_variants)


@check("deterministic_cascade")
def deterministic_cascade(t: DriverTables) -> DataFrame:
    return matching.match_cascade(items(t), t.fx_variants)


GATE = "CAST(floor(item_id / 10) AS BIGINT) % 5"


@check(
    "fuzzy_gate",
    f"""
    WITH live AS (SELECT * FROM fx_variants WHERE {LIVE}), anchor AS (SELECT DISTINCT unnest(string_split(model, ' ')) AS x FROM live)
    SELECT {ITEM_ID} AS item_id FROM fx_items i JOIN fx_variants v ON v.variant_id = i.true_variant
    WHERE CASE {GATE} WHEN 0 THEN i.gtin <> '' OR i.sku <> '' WHEN 1 THEN v.brand IN (SELECT brand FROM live)
      WHEN 2 THEN i.true_variant IN (SELECT variant_id FROM fx_variants m JOIN anchor ON length(x) >= 5 AND contains(concat(' ', m.model, ' '), concat(' ', x, ' ')))
      WHEN 3 THEN false ELSE true END
    """,
)
def fuzzy_gate(t: DriverTables) -> DataFrame:
    """Items that keep one kind of evidence each: codes, the brand, the model, none, everything."""
    named = t.fx_variants.select(F.col("variant_id").alias("true_variant"), F.col("brand").alias("_brand"), F.col("model").alias("_model"))
    kind = F.expr(GATE)
    bare = lambda c: F.when((kind == 0) | (kind == 4), F.col(c))
    title = (
        F.when(kind == 0, "Thing on sale")
        .when(kind == 1, F.concat(F.lit("Thing by "), "_brand"))
        .when(kind == 2, F.concat(F.lit("On sale: "), "_model"))
        .when(kind == 3, "Some things")
        .otherwise(F.col("title"))
    )
    rows = t.fx_items.join(named, "true_variant").withColumns(
        {
            "title": title, "gtin": bare("gtin"), "sku": bare("sku"), "_id": F.col("item_id"),
            "normalized_url": F.when(kind == 4, F.col("normalized_url")).otherwise("https://shop.example.com/x"),
        }
    )
    unique = F.concat_ws("-", "_id", "true_variant", "store_id", F.unix_date(F.to_date("last_seen_at")))
    return matching.gate_fuzzy(rows.withColumn("item_id", unique), matching.variant_keys(t.fx_variants)).select("item_id")


@check(
    "contained_codes",
    f"""WITH {EXACT} SELECT iid AS item_id, v.variant_id, lower(v.manufacturer_sku) AS key
        FROM it JOIN live v ON v.variant_id = it.true_variant WHERE normalized_url LIKE '%/mx%'""",
)
def contained_codes(t: DriverTables) -> DataFrame:
    return matching.match_contained(items(t), matching.variant_keys(t.fx_variants), idle=matching.idle_codes(t.fx_variants))


TRI = r"""list_distinct(flatten([[substr(concat('  ', w, ' '), i, 3) FOR i IN range(1, length(w) + 2)]
    FOR w IN string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ') IF w <> '']))"""


@check(
    "trigram_similarity_join",
    f"""
    WITH l AS (SELECT DISTINCT concat(model, ' by ', brand) AS left_text FROM fx_variants),
    r AS (SELECT DISTINCT concat(brand, ' ', model) AS right_text FROM fx_variants),
    lg AS (SELECT left_text, {TRI.format('left_text')} AS g FROM l), rg AS (SELECT right_text, {TRI.format('right_text')} AS h FROM r),
    s AS (SELECT left_text, right_text, len(list_intersect(g, h)) AS c, len(g) AS a, len(h) AS b FROM lg, rg)
    SELECT left_text, right_text, round(c / (a + b - c), 6) AS similarity FROM s WHERE c / (a + b - c) >= 0.18
    """,
)
def trigram_similarity_join(t: DriverTables) -> DataFrame:
    left = t.fx_variants.select(F.concat_ws(" by ", "model", "brand").alias("text"))
    right = t.fx_variants.select(F.concat_ws(" ", "brand", "model").alias("text"))
    rows = matching.similarity_join(left, right, MATCHING.fuzzy_threshold)
    return rows.withColumn("similarity", F.round("similarity", 6))


@check(
    "fuzzy_candidates",
    f"""
    WITH l AS (SELECT product_id AS item_id, min(concat(model, ' by ', brand)) AS title, max(gtin) AS gtin FROM fx_variants GROUP BY 1),
    r AS (SELECT product_id AS variant_id, min(concat(brand, ' ', model)) AS name, max(gtin) AS vg FROM fx_variants GROUP BY 1),
    lg AS (SELECT *, {TRI.format('title')} AS g FROM l), rg AS (SELECT *, {TRI.format('name')} AS h FROM r),
    s AS (SELECT item_id, variant_id, gtin = vg AS same, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS sim FROM lg, rg),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN same THEN 0 ELSE 2 END, sim DESC, variant_id) AS rank
        FROM s WHERE same OR sim >= 0.5)
    SELECT item_id, variant_id, rank, round(sim, 6) AS similarity FROM k WHERE rank <= 12
    """,
)
def fuzzy_candidates(t: DriverTables) -> DataFrame:
    products = t.fx_variants.groupBy("product_id").agg(
        F.min("brand").alias("brand"), F.min("model").alias("model"), F.max("gtin").alias("gtin")
    )
    left = products.select(F.col("product_id").alias("item_id"), F.concat_ws(" by ", "model", "brand").alias("title"), "gtin", F.lit(None).cast("string").alias("sku"))
    right = products.select(
        F.col("product_id").alias("variant_id"), F.concat_ws(" ", "brand", "model").alias("canonical_name"), "gtin",
        F.lit(None).cast("string").alias("manufacturer_sku"),
    )
    rows = matching.fuzzy_candidates(left, right, 12, 0.5)
    return rows.select("item_id", "variant_id", "rank", F.round("similarity", 6).alias("similarity"))


def _pairs(t: DriverTables) -> DataFrame:
    target = t.fx_variants.select(*[F.col(c).alias("t_" + c) for c in matching.TARGET_FIELDS if c in t.fx_variants.columns])
    return items(t).join(target, F.col("true_variant") == F.col("t_variant_id"))


@check("pair_scores")
def pair_scores(t: DriverTables) -> DataFrame:
    return matching.score_pairs(_pairs(t)).select("item_id", "t_variant_id", "score")


@check(
    "pair_conflicts",
    f"""
    SELECT {ITEM_ID} AS item_id, variant_id AS t_variant_id, (i.gtin IS NOT NULL AND length(i.gtin) < 13) AS conflict
    FROM fx_items i JOIN fx_variants v ON v.variant_id = i.true_variant
    """,
)
def pair_conflicts(t: DriverTables) -> DataFrame:
    rows = matching.score_pairs(_pairs(t), ratios=False)
    return rows.select("item_id", "t_variant_id", (F.col("score") == -1000).alias("conflict"))


@check("chosen_candidates")
def chosen_candidates(t: DriverTables) -> DataFrame:
    scored = matching.score_pairs(_pairs(t)).withColumn("url", F.col("normalized_url"))
    rows = matching.choose_best(scored, "t_variant_id")
    return rows.select("t_variant_id", "score", "ambiguous", F.col("winner.url").alias("winner_url"))


@check(
    "match_decisions",
    """
    WITH d AS (SELECT variant_id, max(match_quality_score) + 20 AS best_score, min(match_quality_score) + 20 AS runner_up_score
      FROM fx_offers GROUP BY 1)
    SELECT *, CASE WHEN best_score >= 95 AND best_score - runner_up_score >= 8 THEN 'auto_matched' WHEN best_score >= 70 THEN 'needs_review'
      ELSE 'pending_match' END AS decision FROM d
    """,
)
def match_decisions(t: DriverTables) -> DataFrame:
    scored = t.fx_offers.groupBy("variant_id").agg(
        (F.max("match_quality_score") + 20).alias("best_score"), (F.min("match_quality_score") + 20).alias("runner_up_score")
    )
    return matching.decide_match(scored)


CLUSTERS = f"""
    it AS (SELECT {ITEM_ID} AS iid, *, CASE WHEN length(gtin) = 13 THEN concat('gtin:', gtin)
        WHEN brand IS NOT NULL AND sku IS NOT NULL THEN concat('mpn:', regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'), ':', replace(sku, '-', ''))
        ELSE concat('store_url:', store_id, ':', normalized_url) END AS identity_key,
        availability <> 'out_of_stock' AND (COALESCE(length(gtin) = 13, false) OR (brand IS NOT NULL AND sku IS NOT NULL)
          OR source_method = 'jsonld_offer') AS publishable FROM fx_items),
    cl AS (SELECT identity_key, CASE split_part(identity_key, ':', 1) WHEN 'gtin' THEN 100 WHEN 'mpn' THEN 90 ELSE 60 END AS strength,
        count(*) AS evidence_count, count(DISTINCT store_id) AS evidence_store_count, count(*) FILTER (price >= 10) AS priced_evidence_count,
        count(*) FILTER (publishable) AS publishable_count, count(DISTINCT store_id) FILTER (publishable) AS publishable_store_count,
        arg_max(title, (length(title), title)) AS canonical_title,
        arg_min(brand, (last_seen_at, iid)) FILTER (brand IS NOT NULL) AS brand,
        arg_min(sku, (last_seen_at, iid)) FILTER (sku IS NOT NULL) AS sku, arg_min(gtin, (last_seen_at, iid)) FILTER (gtin IS NOT NULL) AS gtin
      FROM it GROUP BY 1)"""


def clusters(t: DriverTables) -> DataFrame:
    rows = with_publishable(items(t))
    key = ids.identity_key(F.col("gtin"), F.col("brand"), F.col("sku"), F.col("store_id"), F.col("normalized_url"))
    rows = rows.withColumn("identity_key", key).withColumn("strength", ids.identity_strength(F.col("identity_key")))
    return matching.build_clusters(rows)


@check(
    "identity_clusters",
    f"""WITH {CLUSTERS} SELECT identity_key, strength AS identity_strength, evidence_count, evidence_store_count, priced_evidence_count,
      publishable_count, publishable_store_count, canonical_title, brand, sku, gtin,
      CASE WHEN strength >= 90 AND publishable_store_count >= 2 THEN 'cross_store_verified' WHEN publishable_count >= 1 THEN 'source_verified'
        ELSE 'candidate' END AS status FROM cl""",
)
def identity_clusters(t: DriverTables) -> DataFrame:
    return clusters(t).drop("entity_id", "last_seen_at")


@check(
    "resolved_clusters",
    f"""
    WITH {CLUSTERS}, live AS (SELECT * FROM fx_variants WHERE {LIVE})
    SELECT identity_key, COALESCE(g.variant_id::VARCHAR, m.variant_id::VARCHAR,
        CASE WHEN publishable_count >= 1 THEN concat('VAR-', upper(substr(sha256(identity_key), 1, 20))) END) AS resolved_variant_id,
      CASE WHEN g.variant_id IS NOT NULL THEN 'gtin' WHEN m.variant_id IS NOT NULL THEN 'brand_sku'
        WHEN publishable_count >= 1 THEN 'new' ELSE 'unresolved' END AS resolution
    FROM cl LEFT JOIN live g ON g.gtin = cl.gtin
      LEFT JOIN live m ON m.brand = cl.brand AND lower(m.manufacturer_sku) = replace(cl.sku, '-', '')
    """,
)
def resolved_clusters(t: DriverTables) -> DataFrame:
    rows = matching.resolve_clusters(clusters(t), t.fx_variants)
    return rows.select("identity_key", "resolved_variant_id", "resolution")


@check(
    "promoted_provisional",
    """
    SELECT o.variant_id, count(DISTINCT o.store_id) AS store_count FROM fx_offers o JOIN fx_variants v USING (variant_id)
    WHERE v.source_status = 'catalog_provisional' GROUP BY 1 HAVING count(DISTINCT o.store_id) >= 2
    """,
)
def promoted_provisional(t: DriverTables) -> DataFrame:
    provisional = t.fx_variants.filter("source_status = 'catalog_provisional'").select("variant_id")
    return matching.promote_provisional(t.fx_offers.join(provisional, "variant_id", "left_semi"))


@check(
    "promoted_mappings",
    f"""
    WITH m AS (SELECT {ITEM_ID} AS item_id, true_variant AS variant_id, store_id, normalized_url FROM fx_items),
    a AS (SELECT variant_id, store_id, min(mapping_id) AS mapping_id FROM fx_listings WHERE active GROUP BY 1, 2)
    SELECT m.item_id, CASE WHEN a.mapping_id IS NULL THEN 'mapping_created' ELSE 'mapping_repaired' END AS action,
      COALESCE(a.mapping_id, concat('MAP-', upper(substr(sha256(concat_ws('|', m.variant_id, m.store_id, normalized_url)), 1, 20)))) AS mapping_id
    FROM m LEFT JOIN a USING (variant_id, store_id)
    """,
)
def promoted_mappings(t: DriverTables) -> DataFrame:
    matches = items(t).select("item_id", F.col("true_variant").alias("variant_id"), "store_id", "normalized_url")
    return matching.promote_mappings(matches, t.fx_listings).select("item_id", "action", "mapping_id")


@check(
    "url_ownership_conflicts",
    """
    WITH l AS (SELECT store_id, concat('https://shop', store_id, '.example.com/products/item-', variant_id % 500) AS url, variant_id FROM fx_listings WHERE active),
    m AS (SELECT DISTINCT true_variant AS variant_id, store_id, normalized_url FROM fx_items)
    SELECT m.store_id, normalized_url, m.variant_id, count(DISTINCT l.variant_id) AS owner_count, min(l.variant_id) AS first_owner
    FROM m JOIN l ON l.store_id = m.store_id AND l.url = normalized_url AND l.variant_id <> m.variant_id GROUP BY 1, 2, 3
    """,
)
def url_ownership_conflicts(t: DriverTables) -> DataFrame:
    url = F.concat(
        F.lit("https://shop"), F.col("store_id").cast("string"), F.lit(".example.com/products/item-"), (F.col("variant_id") % 500).cast("string")
    )
    listings = t.fx_listings.withColumn("source_url", url)
    matches = t.fx_items.select(F.col("true_variant").alias("variant_id"), "store_id", "normalized_url").distinct()
    return matching.url_conflicts(matches, listings)


IMPORT = """CASE WHEN obs_id % 11 = 0 THEN 'rejected' WHEN obs_id % 5 = 0 THEN 'mapping_created' WHEN obs_id % 7 = 0 THEN 'mapping_repaired'
    WHEN obs_id % 13 = 0 THEN 'pending_match' ELSE 'accepted' END"""


@check(
    "import_run_summary",
    f"""
    WITH i AS (SELECT store_id AS import_id, shipping_cost AS observed_price, {IMPORT} AS s FROM fx_observations)
    SELECT import_id, count(*) AS rows_received, count(*) FILTER (s <> 'rejected') AS rows_accepted, count(*) FILTER (s = 'rejected') AS rows_rejected,
      count(*) FILTER (s LIKE 'mapping%') AS rows_matched, count(*) FILTER (s = 'mapping_created') AS mappings_created,
      count(*) FILTER (s = 'mapping_repaired') AS mappings_repaired, count(observed_price) AS prices_observed,
      count(*) FILTER (s = 'pending_match') AS review_count,
      CASE WHEN count(*) FILTER (s = 'pending_match') > 0 THEN 'completed_with_review' ELSE 'completed' END AS status FROM i GROUP BY 1
    """,
)
def import_run_summary(t: DriverTables) -> DataFrame:
    rows = t.fx_observations.select(
        F.col("store_id").alias("import_id"), F.col("shipping_cost").alias("observed_price"), F.expr(IMPORT).alias("validation_status")
    )
    return matching.import_summary(rows)


@check(
    "reconcile_queue",
    """
    SELECT candidate_id FROM (SELECT obs_id * 100000 + variant_id AS candidate_id, CASE WHEN obs_id % 3 > 0 THEN obs_id % 4 END AS v FROM fx_observations)
    WHERE COALESCE(v, 0) < 2 AND candidate_id > 5000000000 ORDER BY 1 LIMIT 500
    """,
)
def reconcile_queue(t: DriverTables) -> DataFrame:
    rows = t.fx_observations.select(
        (F.col("obs_id") * 100000 + F.col("variant_id")).alias("candidate_id"),
        F.when(F.col("obs_id") % 3 > 0, F.col("obs_id") % 4).alias("match_version"),
    )
    return matching.due_for_reconcile(rows, 2, 5000000000, 500).select("candidate_id")


@check(
    "hydration_queue",
    """
    WITH c AS (SELECT DISTINCT store_id, normalized_url FROM fx_items),
    k AS (SELECT store_id, normalized_url, max(price) AS observed_price, max(last_seen_at) AS last_seen_at, max(source_method) AS source_method
      FROM fx_items WHERE last_seen_at < TIMESTAMP '1998-01-01' GROUP BY 1, 2),
    t AS (SELECT c.store_id, c.normalized_url, k.last_seen_at, CASE WHEN k.store_id IS NULL THEN 0 WHEN source_method LIKE 'sitemap%' THEN 1 ELSE 2 END AS tier
      FROM c LEFT JOIN k USING (store_id, normalized_url)),
    r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY tier, last_seen_at NULLS FIRST, normalized_url) AS position FROM t WHERE tier < 2)
    SELECT store_id, normalized_url, tier, position FROM r WHERE position <= 25
    """,
)
def hydration_queue(t: DriverTables) -> DataFrame:
    seen = t.fx_items.filter(F.col("last_seen_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    known = seen.groupBy("store_id", "normalized_url").agg(
        F.max("price").alias("observed_price"), F.max("last_seen_at").alias("last_seen_at"), F.max("source_method").alias("source_method")
    )
    return matching.hydration_queue(t.fx_items, known, 25)


@check(
    "verified_presence",
    """
    SELECT mapping_id FROM fx_listings JOIN fx_variants v USING (variant_id) WHERE match_confidence = 'high' AND
      (url_type = 'product' OR direct_url_status = 'verified')
    """,
)
def verified_presence(t: DriverTables) -> DataFrame:
    products = t.fx_variants.withColumn("specs", F.create_map(F.lit("السعة"), F.col("storage_gb").cast("string")))
    kind = F.when(F.col("url_type") == "product", "product_feed").when(F.col("direct_url_status") == "verified", "direct_product")
    named = t.fx_variants.select("variant_id", F.concat_ws("-", "brand", "model", F.concat(F.col("storage_gb").cast("string"), F.lit("GB"))).alias("slug"))
    presence = t.fx_listings.join(named, "variant_id").select(
        "mapping_id", "variant_id", "match_confidence", F.lit("ready").alias("review_status"), kind.alias("link_type"),
        F.concat(F.lit("https://shop.example.com/p/"), F.regexp_replace("slug", "[ #]", "-")).alias("source_url"),
    )
    return matching.verified_presence(presence, products).select("mapping_id")
