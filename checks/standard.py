"""Column-expression checks over real texts, URLs and derived titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from offerlake.config import SCHEDULE
from offerlake.functions import ids, numbers, specs, text, urls
from offerlake.operators import standardize
from offerlake.sources.fixtures import AS_OF, DriverTables
from offerlake.sources.tables import cast_seed

NORM = r"""trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_.+/-]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@check(
    "normalized_text",
    f"WITH n AS (SELECT doc_id, {NORM} AS t FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM n",
)
def normalized_text(t: DriverTables) -> DataFrame:
    rows = t.documents.withColumn("t", text.normalized_text(F.col("text")))
    return rows.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@check(
    "text_tokens",
    f"""WITH n AS (SELECT doc_id, {NORM} AS t FROM documents)
      SELECT doc_id, len(list_distinct([x FOR x IN string_split(t, ' ') IF length(x) > 1])) AS n_tokens FROM n""",
)
def text_tokens(t: DriverTables) -> DataFrame:
    tokens = text.tokens(text.normalized_text(F.col("text")))
    return t.documents.select("doc_id", F.size(tokens).alias("n_tokens"))


PRICE_TEXT = """
    pt AS (SELECT obs_id, variant_id, cash_price, CASE obs_id % 4
        WHEN 0 THEN concat('EGP ', regexp_replace(CAST(cash_price AS VARCHAR), '^(\\d+)(\\d{3})\\.', '\\1,\\2.'))
        WHEN 1 THEN concat(CAST(CAST(floor(cash_price) AS BIGINT) AS VARCHAR), ' LE')
        WHEN 2 THEN concat('USD ', regexp_replace(CAST(cash_price AS VARCHAR), '^(\\d+)(\\d{3})\\.', '\\1.\\2,'))
        ELSE 'no price' END AS price_text FROM fx_observations)"""


def _price_texts(t: DriverTables) -> DataFrame:
    price = F.col("cash_price").cast("string")
    kind = F.col("obs_id") % 4
    return t.fx_observations.withColumn(
        "price_text",
        F.when(kind == 0, F.concat(F.lit("EGP "), F.regexp_replace(price, r"^(\d+)(\d{3})\.", "$1,$2.")))
        .when(kind == 1, F.concat(F.floor("cash_price").cast("string"), F.lit(" LE")))
        .when(kind == 2, F.concat(F.lit("USD "), F.regexp_replace(price, r"^(\d+)(\d{3})\.", "$1.$2,")))
        .otherwise("no price"),
    )


@check(
    "parsed_prices",
    f"""WITH {PRICE_TEXT} SELECT obs_id, variant_id, CASE obs_id % 4 WHEN 0 THEN CAST(cash_price AS DOUBLE)
          WHEN 1 THEN CAST(floor(cash_price) AS DOUBLE) WHEN 2 THEN CAST(cash_price AS DOUBLE) END AS price,
          CASE obs_id % 4 WHEN 2 THEN 'USD' ELSE 'EGP' END AS currency_code FROM pt""",
)
def parsed_prices(t: DriverTables) -> DataFrame:
    rows = standardize.standardize_prices(_price_texts(t), "price_text", "price_text")
    return rows.select("obs_id", "variant_id", "price", "currency_code")


@check(
    "availability_classes",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'out_of_stock' WHEN 'click' THEN 'limited' WHEN 'view' THEN 'preorder'
      WHEN 'purchase' THEN 'available' ELSE 'unknown' END AS availability_class FROM events
    """,
)
def availability_classes(t: DriverTables) -> DataFrame:
    raw = (
        F.when(F.col("event_type") == "error", "https://schema.org/OutOfStock")
        .when(F.col("event_type") == "click", "Limited: only few left, available")
        .when(F.col("event_type") == "view", "PRE-ORDER / preorder now")
        .when(F.col("event_type") == "purchase", "In Stock!")
        .otherwise(F.col("event_type"))
    )
    return t.events.select("event_id", numbers.availability_class(raw).alias("availability_class"))


URL = r"""regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\?([^#]*))?', ['s', 'h', 'p', 'qq', 'q'])"""


@check(
    "normalized_urls",
    rf"""
    WITH u AS (SELECT page_id, url, {URL} AS x FROM pages),
    p AS (SELECT page_id, url, x.s AS s, lower(x.h) AS h, rtrim(regexp_replace(x.p, '/+', '/', 'g'), '/') AS p, x.q AS q FROM u),
    k AS (SELECT *, list_sort([e FOR e IN string_split(q, '&') IF e <> '' AND NOT starts_with(e, 'utm_')
            AND NOT (split_part(e, '=', 1) IN ('ref', 'source', 'gclid', 'fbclid'))]) AS kept FROM p)
    SELECT page_id, concat(s, '://', h, CASE WHEN p = '' THEN '/' ELSE p END, CASE WHEN q = '' THEN '' ELSE '?' || q END) AS normalized_url,
      concat(s, '://', h, CASE WHEN p = '' THEN '/' ELSE p END,
        CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END) AS canonical_url,
      regexp_replace(h, '^www\.', '') AS host
    FROM k
    """,
)
def normalized_urls(t: DriverTables) -> DataFrame:
    rows = standardize.standardize_urls(t.pages, "url")
    return rows.select("page_id", "normalized_url", "canonical_url", "host")


@check(
    "allowed_hosts",
    r"""
    SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), '(^|\.)example\.(com|org)$')
    """,
)
def allowed_hosts(t: DriverTables) -> DataFrame:
    return standardize.filter_allowed_hosts(t.pages, "url", ["example.com", "www.example.org"]).select("page_id")


@check(
    "slug_titles",
    r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(
        list_last(string_split(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/')),
        '\.(html?|aspx?|php)$', '', 'i'), '[-_+\s]+', ' ', 'g')) AS slug_title FROM pages
    """,
)
def slug_titles(t: DriverTables) -> DataFrame:
    return t.pages.select("page_id", urls.slug_title(F.col("url")).alias("slug_title"))


ITEM_URL = """concat('https://shop', CAST(store_id AS STRING), '.example.com/', CASE CAST(obs_id % 6 AS INT) WHEN 0 THEN 'products/'
    WHEN 1 THEN 'account/' WHEN 2 THEN 'media/' WHEN 3 THEN 'c/' WHEN 4 THEN 'blog/' ELSE '' END, 'super-phone-',
    CAST(variant_id AS STRING), CASE CAST(obs_id % 6 AS INT) WHEN 2 THEN '.jpg' ELSE '' END)"""


@check(
    "product_urls",
    "SELECT obs_id, variant_id FROM fx_observations WHERE obs_id % 6 NOT IN (1, 2, 4)",
)
def product_urls(t: DriverTables) -> DataFrame:
    rows = t.fx_observations.withColumn("url", F.expr(ITEM_URL))
    return standardize.filter_product_urls(rows, "url").select("obs_id", "variant_id")


@check(
    "capacity_specs",
    """
    SELECT variant_id, CAST(storage_gb AS DOUBLE) AS storage_gb, CAST(ram_gb AS DOUBLE) AS ram_gb,
      concat(CASE WHEN storage_gb % 3 = 0 THEN storage_gb * 1024 ELSE storage_gb END, '.0') AS storage_values,
      concat(ram_gb, '.0') AS ram_values
    FROM (SELECT variant_id, ram_gb, CASE WHEN storage_gb % 3 = 0 THEN storage_gb * 1024 ELSE storage_gb + 100 END AS storage_gb FROM fx_variants)
    """.replace("CASE WHEN storage_gb % 3 = 0 THEN storage_gb * 1024 ELSE storage_gb END, '.0'", "storage_gb, '.0'"),
)
def capacity_specs(t: DriverTables) -> DataFrame:
    size = F.when(F.col("storage_gb") % 3 == 0, F.concat(F.col("storage_gb"), F.lit(" TB"))).otherwise(
        F.concat((F.col("storage_gb") + 100).cast("string"), F.lit("GB"))
    )
    title = F.concat_ws(" ", "model", F.concat(F.lit("RAM "), F.col("ram_gb")), F.lit("-"), size)
    rows = t.fx_variants.withColumn("n", text.normalized_text(title))
    marked = text.normalized_text(F.concat_ws(" ", "model", size, F.concat(F.col("ram_gb").cast("string"), F.lit("GB RAM"))))
    spec = specs.technical_specs(marked)
    shown = lambda c: F.array_join(F.transform(c, lambda v: v.cast("decimal(18,1)").cast("string")), ",")
    return rows.select(
        "variant_id",
        spec["storage_gb"].alias("storage_gb"),
        spec["ram_gb"].alias("ram_gb"),
        shown(specs.storage_values(F.col("n"))).alias("storage_values"),
        shown(specs.ram_values(F.col("n"))).alias("ram_values"),
    )


@check(
    "inferred_specs",
    """
    SELECT variant_id, CASE WHEN variant_id % 2 = 0 THEN concat(storage_gb, ' كجم') END AS load,
      CASE WHEN variant_id % 2 = 0 THEN 'تحميل أمامي' END AS loading, CASE WHEN variant_id % 2 = 1 THEN '4K' END AS resolution,
      CASE WHEN variant_id % 2 = 1 THEN 'QLED' END AS panel, CASE WHEN variant_id % 2 = 1 THEN concat(storage_gb + 20, ' بوصة') END AS screen
    FROM fx_variants
    """,
)
def inferred_specs(t: DriverTables) -> DataFrame:
    title = F.when(
        F.col("variant_id") % 2 == 0, F.concat(F.lit("Washer "), F.col("storage_gb"), F.lit(" kg front load"))
    ).otherwise(F.concat(F.lit("Screen "), F.col("storage_gb") + 20, F.lit(" inch 4K qled")))
    names = {"load": "الحمولة بالكيلوجرام", "loading": "نوع التحميل", "resolution": "الدقة", "panel": "تقنية الشاشة", "screen": "مقاس الشاشة"}
    read = text.let(specs.inferred_specs(title), lambda m: F.struct(*[m[spec].alias(name) for name, spec in names.items()]))
    return t.fx_variants.select("variant_id", read.alias("read")).select("variant_id", "read.*")


@check(
    "ordered_spec_list",
    """
    SELECT variant_id, concat('Size=', storage_gb, ';Brand=', brand, ';Color=', color) AS specs FROM fx_variants
    """,
)
def ordered_spec_list(t: DriverTables) -> DataFrame:
    raw = F.concat_ws(
        " | ", F.concat(F.lit("Brand: "), "brand"), F.concat(F.lit("Color: "), "color"), F.lit("Brand: other"), F.lit("junk"),
        F.concat(F.lit("Size: "), F.col("storage_gb")),
    )
    listed = F.transform(specs.spec_list(raw, ["Size"]), lambda s: F.concat_ws("=", s["name"], s["value"]))
    return t.fx_variants.select("variant_id", F.array_join(listed, ";").alias("specs"))


@check(
    "completed_spec_list",
    """
    SELECT variant_id, concat('Size=', storage_gb, ';السعة باللتر=', ram_gb, ' لتر;Brand=', brand, ';اسم النسخة=', color) AS specs FROM fx_variants
    """,
)
def completed_spec_list(t: DriverTables) -> DataFrame:
    raw = F.concat_ws(
        " | ", F.lit("Size: 0"), F.lit("اسم النسخة: old"), F.concat(F.lit("Brand: "), "brand"), F.concat(F.lit("اسم النسخة: "), "color"),
        F.lit("Brand: other"), F.concat(F.lit("Size: "), F.col("storage_gb")),
    )
    read = specs.inferred_specs(F.concat(F.lit("Kettle "), F.col("ram_gb"), F.lit(" litres")))
    listed = F.transform(specs.spec_list(raw, ["Size", "Weight", "السعة باللتر"], read), lambda s: F.concat_ws("=", s["name"], s["value"]))
    return t.fx_variants.select("variant_id", F.array_join(listed, ";").alias("specs"))


@check(
    "spec_maps",
    """
    SELECT variant_id, CASE WHEN variant_id % 2 = 0 THEN '99' ELSE ram_gb::VARCHAR END AS ram,
      storage_gb::VARCHAR AS storage, color FROM fx_variants
    """,
)
def spec_maps(t: DriverTables) -> DataFrame:
    published = F.when(F.col("variant_id") % 2 == 0, F.create_map(F.lit("RAM"), F.lit("99"), F.lit("x"), F.lit("")))
    m = specs.spec_map(published, F.col("ram_gb"), F.col("storage_gb"), F.col("color"))
    rows = t.fx_variants.withColumn("m", m)
    return rows.select(
        "variant_id", F.col("m")["RAM"].alias("ram"), F.col("m")["التخزين"].alias("storage"), F.col("m")["اللون"].alias("color")
    )


@check(
    "identifier_columns",
    r"""
    SELECT item_id, true_variant, CASE WHEN length(gtin) IN (8, 12, 13, 14) THEN gtin END AS valid_gtin,
      COALESCE(regexp_replace(sku, '[^a-z0-9]', '', 'g'), '') AS compact_sku, COALESCE(sku IS NOT NULL, false) AS distinctive_sku
    FROM fx_items
    """,
)
def identifier_columns(t: DriverTables) -> DataFrame:
    rows = standardize.standardize_ids(t.fx_items, "gtin", "sku")
    return rows.select("item_id", "true_variant", "valid_gtin", "compact_sku", "distinctive_sku")


@check(
    "model_anchors",
    r"""
    SELECT DISTINCT x AS token, length(x) >= 3 AND (length(x) >= 5 OR regexp_matches(x, '\d')) AS distinctive
    FROM (SELECT unnest(string_split(model, ' ')) AS x FROM fx_variants)
    """,
)
def model_anchors(t: DriverTables) -> DataFrame:
    words = t.fx_variants.select(F.explode(F.split("model", " ")).alias("token")).distinct()
    return words.select("token", ids.distinctive_model_token(F.col("token")).alias("distinctive"))


@check(
    "stable_ids",
    """
    SELECT variant_id, concat('BR-', upper(substr(sha256(lower(brand)), 1, 20))) AS brand_id,
      concat('PR-', upper(substr(sha256(concat(lower(brand), '|', lower(model))), 1, 12))) AS product_key FROM fx_variants
    """,
)
def stable_ids(t: DriverTables) -> DataFrame:
    return t.fx_variants.select(
        "variant_id",
        ids.stable_id("BR", F.concat(F.lit("  "), F.col("brand"))).alias("brand_id"),
        ids.stable_id("PR", F.col("brand"), F.col("model"), length=12).alias("product_key"),
    )


@check(
    "family_names",
    "SELECT variant_id, CASE WHEN product_type = 'gear' THEN model ELSE split_part(model, ' ', 1) END AS family FROM fx_variants",
)
def family_names(t: DriverTables) -> DataFrame:
    is_phone = F.col("product_type") != "gear"
    model = F.when(is_phone, F.concat(F.col("color"), F.lit(" Pro  Max 5G"))).otherwise(F.col("model"))
    kind = F.when(is_phone, "smartphone").otherwise("gear")
    return t.fx_variants.select("variant_id", text.family_name(model, kind).alias("family"))


@check(
    "search_documents",
    """
    SELECT variant_id, lower(concat_ws(' ', canonical_name, brand, model, variant_name, manufacturer_sku, gtin,
      concat(ram_gb, ' gb ram'), concat(storage_gb, ' gb storage'))) AS search_document FROM fx_variants
    """,
)
def search_documents(t: DriverTables) -> DataFrame:
    return standardize.with_search_documents(t.fx_variants).select("variant_id", "search_document")


@check(
    "evidence_tokens",
    """
    SELECT variant_id, concat_ws(',', lower(split_part(brand, '#', 1)), split_part(brand, '#', 2), replace(model, ' ', ','), storage_gb, '5') AS tokens
    FROM fx_variants
    """,
)
def evidence_tokens(t: DriverTables) -> DataFrame:
    title = F.concat_ws(" ", "brand", "model", F.concat(F.col("storage_gb").cast("string"), F.lit("GB")), F.lit("5G dual SIM"))
    return t.fx_variants.select("variant_id", text.evidence_tokens(title).alias("tokens"))


@check(
    "display_names",
    "SELECT variant_id, concat_ws(' ', brand, model, concat(storage_gb, 'GB')) AS name FROM fx_variants",
)
def display_names(t: DriverTables) -> DataFrame:
    model = F.concat_ws(" ", F.upper("brand"), "model")
    variant = F.concat_ws(" ", "model", F.concat(F.col("storage_gb").cast("string"), F.lit("GB")))
    return t.fx_variants.select("variant_id", text.display_name(F.col("brand"), model, variant).alias("name"))


@check(
    "slugs_and_clean_text",
    r"""
    SELECT item_id, true_variant, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, title AS clean_text FROM fx_items
    """,
)
def slugs_and_clean_text(t: DriverTables) -> DataFrame:
    dirty = F.concat(F.lit("\t<"), F.col("title"), F.lit(">\n"))
    return t.fx_items.select(
        "item_id", "true_variant", text.slug(dirty).alias("slug"), text.clean_text(dirty).alias("clean_text")
    )


@check(
    "freshness_classes",
    """
    SELECT offer_id, variant_id, CASE WHEN last_success_at IS NULL THEN 'unseen'
        WHEN last_success_at >= {as_of} - INTERVAL 735 MINUTE THEN 'fresh'
        WHEN last_success_at >= {as_of} - INTERVAL 1470 MINUTE THEN 'late' ELSE 'stale' END AS freshness FROM fx_offers
    """,
)
def freshness_classes(t: DriverTables) -> DataFrame:
    return standardize.with_freshness(t.fx_offers, "last_success_at", AS_OF).select("offer_id", "variant_id", "freshness")


@check(
    "match_quality",
    """
    SELECT offer_id, variant_id, CASE match_confidence WHEN 'high' THEN 95.0 WHEN 'medium' THEN 72.0 ELSE 38.0 END AS match_quality FROM fx_offers
    """,
)
def match_quality(t: DriverTables) -> DataFrame:
    rows = standardize.with_match_quality(t.fx_offers, "match_confidence")
    return rows.select("offer_id", "variant_id", "match_quality")


@check(
    "run_slots",
    """
    WITH l AS (SELECT event_id, ts + INTERVAL 2 HOUR AS l FROM events),
    d AS (SELECT event_id, l, date_trunc('day', l) AS m FROM l)
    SELECT event_id, strftime((CASE WHEN hour(l) >= 20 THEN m + INTERVAL 20 HOUR WHEN hour(l) >= 10 THEN m + INTERVAL 10 HOUR
        ELSE m - INTERVAL 4 HOUR END) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS run_slot,
      strftime((CASE WHEN hour(l) < 10 THEN m + INTERVAL 10 HOUR WHEN hour(l) < 20 THEN m + INTERVAL 20 HOUR
        ELSE m + INTERVAL 34 HOUR END) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS next_slot,
      strftime((CASE WHEN l >= m + INTERVAL 150 MINUTE THEN m + INTERVAL 150 MINUTE ELSE m + INTERVAL 150 MINUTE - INTERVAL 1 DAY END)
        - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS catalog_slot
    FROM d
    """,
)
def run_slots(t: DriverTables) -> DataFrame:
    rows = standardize.with_run_slot(t.events, "ts").withColumn("catalog_slot", standardize.catalog_slot(F.col("ts"), SCHEDULE))
    return rows.select("event_id", "run_slot", "next_slot", "catalog_slot")


@check(
    "seed_casts",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value, event_type = 'click' AS flag,
      CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS whole FROM events
    """,
)
def seed_casts(t: DriverTables) -> DataFrame:
    e = t.events
    seed = e.select(
        "event_id",
        F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("value"),
        F.when(F.col("event_type") == "click", " YES ").when(F.col("event_type") == "view", "no").alias("flag"),
        F.when(F.col("event_type") != "error", F.floor("value").cast("string")).alias("whole"),
    )
    return cast_seed(seed, {"value": "number", "flag": "boolean", "whole": "integer"})


@check(
    "bounded_payloads",
    """
    SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 2000 THEN md5(text)
      ELSE md5(concat('{"truncated":true,"sha256":"', sha256(text), '"}')) END AS digest FROM documents
    """,
)
def bounded_payloads(t: DriverTables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(standardize.bounded_payload(F.col("text"), 2000)).alias("digest"))


@check(
    "identity_keys",
    """
    WITH k AS (SELECT item_id, true_variant, CASE WHEN length(gtin) = 13 THEN concat('gtin:', gtin)
        WHEN brand IS NOT NULL AND sku IS NOT NULL THEN concat('mpn:', regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'), ':', replace(sku, '-', ''))
        ELSE concat('store_url:', store_id, ':', normalized_url) END AS identity_key FROM fx_items)
    SELECT item_id, true_variant, identity_key,
      CASE split_part(identity_key, ':', 1) WHEN 'gtin' THEN 100 WHEN 'mpn' THEN 90 ELSE 60 END AS strength,
      concat('CPE-', upper(substr(sha256(identity_key), 1, 20))) AS entity_id FROM k
    """,
)
def identity_keys(t: DriverTables) -> DataFrame:
    key = ids.identity_key(F.col("gtin"), F.col("brand"), F.col("sku"), F.col("store_id"), F.col("normalized_url"))
    rows = t.fx_items.withColumn("identity_key", key)
    return rows.select(
        "item_id", "true_variant", "identity_key",
        ids.identity_strength(F.col("identity_key")).alias("strength"), ids.entity_id(F.col("identity_key")).alias("entity_id"),
    )


@check(
    "candidate_fingerprints",
    r"""
    SELECT item_id, true_variant, CASE WHEN length(gtin) = 13 THEN concat('gtin:', gtin)
        WHEN brand IS NOT NULL AND sku IS NOT NULL
          THEN concat('brand-sku:', substr(sha1(concat(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g'), '|', sku)), 1, 24)) END AS fingerprint
    FROM fx_items
    """,
)
def candidate_fingerprints(t: DriverTables) -> DataFrame:
    mark = ids.candidate_fingerprint(F.col("gtin"), F.col("title"), F.col("brand"), F.col("sku"))
    return t.fx_items.select("item_id", "true_variant", mark.alias("fingerprint"))


@check(
    "publishable_items",
    """
    SELECT item_id, true_variant, availability <> 'out_of_stock' AND (COALESCE(length(gtin) = 13, false)
      OR (brand IS NOT NULL AND sku IS NOT NULL) OR source_method = 'jsonld_offer') AS publishable FROM fx_items
    """,
)
def publishable_items(t: DriverTables) -> DataFrame:
    rows = with_publishable(t.fx_items)
    return rows.select("item_id", "true_variant", "publishable")


def with_publishable(items: DataFrame) -> DataFrame:
    c = F.col
    return items.withColumn(
        "publishable",
        ids.is_publishable(
            status=F.lit("accepted"), url=c("normalized_url"), title=c("title"), price=c("price"), currency=c("currency"),
            availability=c("availability"), origin=F.lit("catalog_discovery"), gtin=c("gtin"), brand=c("brand"), sku=c("sku"),
            method=c("source_method"), price_evidence=F.lit(None).cast("boolean"), signal_count=F.lit(None).cast("int"),
        ),
    )
