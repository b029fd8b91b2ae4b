from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from offerlake.operators import matching as m

BASE_TARGET = {
    "variant_id": "V1", "canonical_name": "Samsung Galaxy S26 Ultra 256GB 12GB Black", "brand": "Samsung", "model": "S26 Ultra",
    "storage_gb": 256.0, "ram_gb": 12.0, "color": "Black", "manufacturer_sku": "SM-S948B", "gtin": "1234567890123",
    "store_sku": None, "title_as_seen": None,
}
BASE_ITEM = {"url": "https://shop.example/product", "price": 50000.0, "sku": "SM-S948B", "gtin": "1234567890123", "brand": None}
SCHEMA = (
    "t_variant_id string, t_canonical_name string, t_brand string, t_model string, t_storage_gb double, t_ram_gb double, t_color string, "
    "t_manufacturer_sku string, t_gtin string, t_store_sku string, t_title_as_seen string, title string, url string, price double, sku string, "
    "gtin string, brand string, mapping_id string"
)


def pair(title, target=None, mapping="M", **item):
    t = {**BASE_TARGET, **(target or {})}
    i = {**BASE_ITEM, **item}
    return (*[t[k] for k in BASE_TARGET], title, i["url"], i["price"], i["sku"], i["gtin"], i["brand"], mapping)


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def scores(spark, *pairs):
    return [r["score"] for r in m.score_pairs(frame(spark, *pairs).coalesce(1)).select("score").collect()]


def test_conflicts(spark):
    good = "Samsung S26 Ultra 256GB 12GB Black"
    got = scores(
        spark, pair(good, gtin="999"), pair(good, target={"store_sku": "STORE-1"}, sku="OTHER"),
        pair("Samsung Galaxy S26 Ultra 512GB 12GB Black"), pair("Samsung Galaxy S26 Ultra 256GB 16GB Black"),
        pair("Samsung Galaxy S26 Ultra 256GB 12GB White"),
    )
    assert got == [-1000.0] * 5


ULTRA = {
    "canonical_name": "Ultra UT40SEL2 40 بوصة / HD LED / Android 14", "brand": "Ultra", "model": "UT40SEL2", "storage_gb": None, "ram_gb": None,
    "color": "", "manufacturer_sku": "UT40SEL2", "gtin": "", "store_sku": "",
}
ULTRA_TITLE = "Ultra 40 Inch Smart TV , HD LED Built-In Receiver - UT40SEL2, With TV Wall Mount"
ULTRA_URL = "https://btech.com/en/p/6b37bfb8-0c91-426a-99e3-00bec04e874e"


def test_structured_offer_wins_with_its_exact_score(spark):
    offer = pair(ULTRA_TITLE, ULTRA, url=ULTRA_URL, price=9508.0, sku="6b37bfb8-0c91-426a-99e3-00bec04e874e", gtin=None)
    meta = pair(ULTRA_TITLE, ULTRA, url=ULTRA_URL, price=None, sku=None, gtin=None)
    got = m.choose_best(m.score_pairs(frame(spark, offer, meta))).first()
    assert got["score"] == 75.953 and got["winner"]["price"] == 9508.0 and not got["ambiguous"]


def test_exact_variant_and_wrong_storage(spark):
    apple = {"canonical_name": "Apple iPhone 17 Pro Max 256GB Blue", "brand": "Apple", "model": "iPhone 17 Pro Max", "ram_gb": None, "color": "Blue", "manufacturer_sku": None, "gtin": None}
    right, wrong = scores(
        spark, pair("Apple iPhone 17 Pro Max 256GB - Blue", apple, sku=None, gtin=None), pair("Apple iPhone 17 Pro Max 128GB Blue", apple, sku=None, gtin=None)
    )
    assert right >= 55 and right > wrong + 20


@pytest.mark.parametrize(
    ("second", "selected"),
    [
        ({"title": "Samsung Galaxy S26 Ultra 256GB 12GB Black Official", "url": "https://shop.example/product-2"}, False),
        ({"title": "Samsung Galaxy S26 Ultra 256GB 12GB Black | B.TECH"}, True),
        ({"title": "Samsung Galaxy S26 Ultra 256GB 12GB Black | B.TECH", "price": 45000.0}, False),
        ({"title": "Samsung Galaxy S26 Ultra 256GB 12GB Black", "url": "https://shop.example/product?variant=1"}, True),
    ],
)
def test_ambiguity(spark, second, selected):
    title = second.pop("title")
    rows = frame(spark, pair("Samsung Galaxy S26 Ultra 256GB 12GB Black"), pair(title, **second))
    got = m.choose_best(m.score_pairs(rows)).first()
    assert (got["winner"] is not None) is selected and got["score"] > 0


VARIANT_SCHEMA = "variant_id string, canonical_name string, brand string, model string, manufacturer_sku string, gtin string, storage_gb double, ram_gb double, color string, source_status string, active boolean"


def variant(vid, **v):
    base = {"canonical_name": "Samsung Galaxy S26 Ultra 256GB Black", "brand": "Samsung", "model": "S26 Ultra", "manufacturer_sku": "SM-S948BZK", "gtin": None, "storage_gb": 256.0, "ram_gb": None, "color": "Black"}
    base.update(v)
    return (vid, *base.values(), "seed_verified", True)


@pytest.mark.parametrize(
    ("catalog", "title", "path", "expected"),
    [
        ([variant("V")], "Samsung Galaxy S26 Ultra 256 GB Black", "products/samsung-galaxy-s26-ultra-256-black", ("V", 150.0)),
        ([variant("V")], "Samsung flagship phone", "p/samsung-sm-s948bzk", ("V", 175.0)),
        ([variant("A"), variant("B", canonical_name="Samsung Galaxy S26 Ultra 256GB Silver", color="Silver")], "Samsung Galaxy S26 Ultra", "products/samsung-galaxy-s26-ultra", None),
        ([variant("V")], "Samsung Galaxy S26 Ultra 256GB Silver", "products/samsung-s26-ultra-256-silver", None),
        ([variant("V", canonical_name="Apple iPhone 15 Pro 256GB Black", brand="Apple", model="iPhone 15 Pro", manufacturer_sku="MTV13")], "iPhone 15 Pro 256GB Black", "products/iphone-15-pro-256-black", ("V", 150.0)),
    ],
)
def test_cascade(spark, catalog, title, path, expected):
    items = spark.createDataFrame(
        [("i", title, "https://shop.example/" + path, None, None, None, None)],
        "item_id string, title string, normalized_url string, brand string, sku string, gtin string, price double",
    )
    got = [(r["variant_id"], r["score"]) for r in m.match_cascade(items, spark.createDataFrame(catalog, VARIANT_SCHEMA)).collect()]
    assert got == ([expected] if expected else [])


def test_brand_model_matches_equal_scoring_every_pair(spark, tables):
    """Brute force on the small fixture: every item against every variant."""
    items = tables.fx_items.withColumn("item_id", F.concat_ws("-", "item_id", "true_variant", "store_id", "last_seen_at")).limit(150).cache()
    variants = tables.fx_variants
    found = m.searchable(F.col("title"), F.col("normalized_url"))
    base = items.withColumn("_s", found)
    target = m.matchable(variants).select(*[F.col(c).alias("t_" + c) for c in m.TARGET_FIELDS if c in variants.columns])
    pairs = base.crossJoin(F.broadcast(target))
    tokens, words = F.split("_s", " "), F.split("t_model", " ")
    compact = F.regexp_replace("_s", "[^a-z0-9]+", "")
    present = (F.size(F.array_except(words, tokens)) == 0) | compact.contains(F.regexp_replace("t_model", "[^a-z0-9]+", ""))
    brand = F.split(F.trim(F.regexp_replace(F.lower("t_brand"), "[^a-z0-9]+", " ")), " ")
    known_brand = (F.lower("brand") == F.lower("t_brand")) | (F.size(F.array_except(F.filter(brand, lambda b: F.length(b) > 1), tokens)) == 0)
    anchored = F.exists(F.array_intersect(words, tokens), lambda w: F.length(w) >= 5)
    scored = m.score_pairs(pairs.filter(present & (known_brand | anchored)).drop("_s"), ratios=False).filter("score > -1000")
    expected = scored.groupBy("item_id").agg(F.count_distinct("t_variant_id").alias("n"), F.min("t_variant_id").alias("v")).filter("n = 1")
    left = sorted((r["item_id"], r["variant_id"]) for r in m.match_brand_model(items, variants).collect())
    assert left == sorted((r["item_id"], r["v"]) for r in expected.collect()) and left


def test_hydration_prefers_unseen_urls(spark):
    c = spark.createDataFrame([(1, "new"), (1, "old")], "store_id int, normalized_url string")
    known = spark.createDataFrame([(1, "old", None, "jsonld_offer", "2020-01-01")], "store_id int, normalized_url string, observed_price double, source_method string, last_seen_at string")
    assert [r["normalized_url"] for r in m.hydration_queue(c, known, 1).collect()] == ["new"]


def test_clusters(spark):
    rows = [("k1", 100, 1, "a", 20.0, True), ("k1", 100, 2, "a longer title", 20.0, True), ("k2", 60, 1, "b", 5.0, False)]
    obs = spark.createDataFrame(rows, "identity_key string, strength int, store_id int, title string, price double, publishable boolean")
    obs = obs.withColumns({"item_id": F.col("title"), "last_seen_at": F.lit("2024-01-01"), **{c: F.lit(None).cast("string") for c in ("brand", "sku", "gtin")}})
    got = {r["identity_key"]: r for r in m.build_clusters(obs).collect()}
    assert got["k1"]["status"] == "cross_store_verified" and got["k1"]["canonical_title"] == "a longer title"
    assert got["k2"]["status"] == "candidate" and got["k2"]["priced_evidence_count"] == 0
