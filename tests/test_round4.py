"""Cases of the fourth round of findings."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import checks
from offerlake.functions import urls
from offerlake.llm.topk import ThresholdTopK
from offerlake.operators import extraction, matching

checks.load_all()

VARIANTS = "variant_id long, brand string, model string, manufacturer_sku string, gtin string, active boolean, source_status string"


@pytest.mark.parametrize("how", ["match_sku_in_text", "match_contained"])
def test_a_code_of_an_inactive_variant_is_no_part_of_a_longer_one(spark, how):
    """``mx10000-0`` shows the code of variant 0, which receives nothing, and not that of variant 90000; ``sm-123-456`` shows a joined code."""
    variants = [
        (0, "Acme", "ring", "MX10000", None, False, "catalog"), (506, "Acme", "ring", "MX10506", None, True, "catalog_provisional"),
        (90000, "Acme", "ring", "MX100000", None, True, "catalog"), (95066, "Acme", "ring", "MX105066", None, True, "catalog"),
        (7, "Acme", "ring", "SM123456", None, True, "catalog"),
    ]
    paths = [("a", "mx10000-0"), ("b", "mx10506-6"), ("c", "mx100000-0"), ("d", "sm-123-456")]
    items = spark.createDataFrame([(i, "Thing", "https://shop.example/products/" + p) for i, p in paths], "item_id string, title string, normalized_url string")
    catalog = spark.createDataFrame(variants, VARIANTS)
    found = getattr(matching, how)(items, matching.variant_keys(catalog), idle=matching.idle_codes(catalog))
    assert sorted((r["item_id"], r["variant_id"]) for r in found.collect()) == [("c", 90000), ("d", 7)]


def test_top_k_never_broadcasts_tiles(spark):
    """Chunks of queries repeat for every block of rows: neither side of their join may be collected on the driver."""
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.floor(F.rand(3) * i * 9).cast("double")).alias("v"))
    rows = rows.localCheckpoint()
    found = []
    for sizes in ({}, {"block_rows": 50, "query_rows": 10}, {"block_rows": 50, "query_rows": 10, "tasks": 12}):
        search = ThresholdTopK(k=7, **sizes).search(rows, rows.filter("vec_id % 5 = 0"))
        found.append(sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.collect()))
        plan = search._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan
    vectors = {r["vec_id"]: r["v"] for r in rows.collect()}
    want = []
    for a, x in vectors.items():
        if a % 5 == 0:
            scored = sorted((-int(sum(p * q for p, q in zip(x, y, strict=True))), b) for b, y in vectors.items() if b != a)
            want += [(a, rank, b, -score) for rank, (score, b) in enumerate(scored[:7], 1)]
    assert found == [sorted(want)] * 3


def test_page_titles_leave_the_references_that_their_sql_leaves(spark, tmp_path):
    titles = ["a &quot;b&quot; c", "a&nbsp;&amp; b", "&amp;quot; &amp;amp; &lt;", "&amp", "plain  title", ""]
    rows = [(i, f"<html><title>{x}</title></html>") for i, x in enumerate(titles)] + [(90, None), (91, "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, title FROM ({checks.ORACLES['page_titles']})").fetchall()
    got = [(r["page_id"], r["title"]) for r in checks.QUERIES["page_titles"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and dict(got)[0] == titles[0]
    assert spark.range(1).select(extraction.page_title(F.lit(rows[0][1]))).first()[0] == 'a "b" c'


def test_a_url_is_matched_once(spark):
    """Scheme, host, port, path and query of a URL come from one match (10, 12 and 7 before)."""
    rows = spark.createDataFrame([(" HTTPS://u@Shop.example.com.:443//a//b;c/?utm_source=x&b=%C3%A9#f\n",)], "u string")
    for read, most in ((urls.canonical_url, 1), (urls.import_url, 2), (urls.normalized_url, 1)):
        plan = rows.select(read(F.col("u")).alias("x")).filter("x <> ''")._jdf.queryExecution().analyzed().toString()
        assert 0 < plan.count("://([^/?#]*)") <= most
    row = rows.select(urls.canonical_url(F.col("u")), urls.import_url(F.col("u")), urls.normalized_url(F.col("u"))).first()
    assert list(row) == ["https://shop.example.com./a/b;c?b=%C3%A9", "https://shop.example.com/a/b;c?b=%C3%A9", "https://shop.example.com./a/b;c/?utm_source=x&b=%C3%A9".replace(";c/?", ";c?")]


@pytest.mark.parametrize("query", ["jsonld_offers", "json_feed_candidates", "normalized_imports", "validated_imports"])
def test_fields_of_an_object_are_looked_up_by_name(spark, query):
    """No path below an object is walked by ``variant_get``."""
    plan = checks.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get(" in plan and "$.name" not in plan and "$.price" not in plan and "$.offers" not in plan
