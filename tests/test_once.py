"""Costly expressions of the larger findings are evaluated once, with the same results."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from offerlake.functions import text
from offerlake.operators import extraction, matching


def test_listed_classes_name_their_characters():
    signs = re.compile(text.listed("a-z", "0-9", "+"))
    assert [c for c in map(chr, range(128)) if signs.fullmatch(c)] == sorted("+0123456789abcdefghijklmnopqrstuvwxyz")
    assert not re.compile(text.listed("a-z", out=True)).search("abcxyzأ")


def test_plain_and_other_texts_have_one_normal_form(spark):
    said = [" A\tb--C_d.E+f/g!\x01(x)\n", "", "  ", "É " + "A\tB!", None, "٣ جيجا"]
    rows = spark.createDataFrame([(s,) for s in said], "s string")
    got = [r[0] for r in rows.select(text.normalized_text(F.col("s"))).collect()]
    assert got == ["a b--c_d.e+f/g x", "", "", "é a b", "", "3 جيجا"]
    assert [r[0] for r in rows.select(text.compact_key(F.col("s"))).collect()] == ["abcdefgx", "", "", "ab", "", "3جيجا"]


def test_sizes_of_a_title_are_read_once(spark):
    pairs = spark.createDataFrame([("a", "Red Phone X1 8GB ram 64GB", "Phone X1", "Blue", 64), ("b", "Phone X1 64GB", "Phone X1", "Blue", 64)], "item_id string, title string, t_model string, t_color string, t_storage_gb int")
    scored = matching.score_pairs(pairs, ratios=False)
    assert {r["item_id"]: r["score"] == -1000 for r in scored.collect()} == {"a": True, "b": False}
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_urls_of_candidates_are_made_canonical_once(spark):
    columns = ", ".join(f"{c} string" for c in ("title", "url", "gtin", "brand", "sku", "source_method"))
    said = [("Ring 12", u, None, None, None, "jsonld_offer") for u in ("https://A.shop.example/p/ring-12?gclid=1", "https://evil.test/p/ring-12", "https://a.shop.example/cart", None)]
    rows = extraction.standardize_candidates(spark.createDataFrame(said, columns), F.array(F.lit("shop.example")))
    assert [r["normalized_url"] for r in rows.collect()] == ["https://a.shop.example/p/ring-12"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("utm_") <= 2  # 28 before


def test_entries_of_a_sitemap_are_read_once(spark):
    body = "<urlset><url><loc>https://a.example/p/ring-12</loc></url><url><loc>https://a.example/cart</loc></url><url><x/></url></urlset>"
    rows = extraction.explode_sitemaps(spark.createDataFrame([(1, "https://a.example/s.xml", body)], "page_id int, url string, body string"))
    assert [tuple(r) for r in rows.collect()] == [(1, "product", "https://a.example/p/ring-12", "ring 12")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("?loc(?:") == 1
