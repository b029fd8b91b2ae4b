"""Inputs beyond the sizes at which a cap or a fixed number of passes would show."""

from __future__ import annotations

import datetime as dt
from html import unescape

import pytest
from pyspark.sql import functions as F

from offerlake.functions import urls
from offerlake.operators import extraction as ex
from offerlake.plans import browse, runs


@pytest.mark.parametrize(
    ("ref", "expected"),
    [
        ("../" * 10 + "z", "/z"), ("../../../../../z", "/a/z"), ("./x/./y", "/a/b/c/d/e/f/x/y"), ("..", "/a/b/c/d/e/"), (".", "/a/b/c/d/e/f/"),
        ("/p/../q", "/q"), ("h?u=/../v", "/a/b/c/d/e/f/h?u=/../v"), ("../.hidden#/../", "/a/b/c/d/e/.hidden#/../"),
    ],
)
def test_dot_segments(spark, ref, expected):
    row = spark.createDataFrame([(ref, "https://shop.example/a/b/c/d/e/f/g")], "ref string, base string")
    assert row.select(urls.absolute_url(F.col("ref"), F.col("base"))).first()[0] == "https://shop.example" + expected


@pytest.mark.parametrize(
    "value",
    ["caf&#233;&nbsp;&#160;&euro;5", "&#xE9;&#X20AC;", "&amp;#65; &#38;lt;", "&nosuch; & plain &;", "a &hearts; b &#1575;&#128512;", "&#0;&#xD800;&#9999999999;", "none", "", None],
)
def test_character_references(spark, value):
    got = spark.createDataFrame([(value,)], "v string").select(ex.unescape(F.col("v"))).first()[0]
    assert got == (None if value is None else unescape(value).replace("\u00a0", " "))


def test_popularity_at_the_edge_of_a_window(spark):
    at = dt.datetime(2024, 1, 31)
    ages = [dt.timedelta(0), dt.timedelta(days=1), dt.timedelta(days=1, microseconds=1), dt.timedelta(days=7), -dt.timedelta(microseconds=1)]
    events = spark.createDataFrame([(1, "view", at - a) for a in ages], "subject_id int, event_type string, ts timestamp")
    got = {r["window_days"]: r["views"] for r in runs.popularity(events, "2024-01-31 00:00:00", (1, 7)).collect()}
    assert got == {1: 2, 7: 4}


def test_work_units_differ_by_every_setting(spark):
    base = {
        "mapping_id": 0, "store_id": 1, "effective_source_url": "u", "effective_url_type": "product", "allowed_hosts": ["a"], "connector_mode": "auto",
        "connector_version": "v1", "respect_robots": True, "browser_required": False, "requests_per_minute": 10, "max_concurrency": 1,
    }
    other = {
        "effective_url_type": "list", "allowed_hosts": ["a", "b"], "connector_mode": "feed", "connector_version": "v2", "respect_robots": False,
        "browser_required": True, "requests_per_minute": 11, "max_concurrency": 2,
    }
    rows = [base, base] + [base | {k: v} for k, v in other.items()]
    kinds = "mapping_id int, store_id int, effective_source_url string, effective_url_type string, allowed_hosts array<string>, connector_mode string, connector_version string, respect_robots boolean, browser_required boolean, requests_per_minute int, max_concurrency int"  # noqa: E501
    got = runs.group_work(spark.createDataFrame([tuple(r.values()) for r in rows], kinds))
    assert sorted(r["mapping_count"] for r in got.collect()) == [1] * len(other) + [2]


def test_plans_of_two_banks_have_two_keys(spark):
    rows = [("o", None, "CIB", "monthly"), ("o", None, "NBE", "monthly"), ("o", None, "CIB", "weekly"), ("o", "Valu", "CIB", "monthly"), ("o", None, None, None)]
    plans = spark.createDataFrame(rows, "offer_key string, provider_name string, bank_or_card string, payment_frequency string")
    plans = plans.withColumns({"months": F.lit(12), "starting_from_only": F.lit(False)})
    found = [r["plan_identity"] for r in ex.with_plan_key(plans).collect()]
    assert len(set(found)) == 5
    assert found[0] == "o|cib|cib|12|monthly|||fixed"
    assert found[-1] == "o|unknown||12||||fixed"


def test_comparisons_keep_every_offer(spark):
    ranked = spark.range(120).select(
        F.lit(1).alias("variant_id"), (F.col("id") + 1).alias("offer_rank"), F.col("id").alias("offer_id"), F.lit("s").alias("store_name"),
        F.lit(1.0).alias("cash_price"), F.lit(1.0).alias("comparable_total"), F.lit("fresh").alias("computed_freshness"),
        F.lit("available").alias("availability"), F.lit(True).alias("eligible_for_ranking"),
    )
    assert browse.materialize_comparisons(ranked).count() == 120


def test_alternatives_are_active_and_may_have_instalments_alone(spark):
    rows = [(1, True), (2, True), (3, False), (4, True), (5, True)]
    variants = spark.createDataFrame(rows, "variant_id int, active boolean").withColumns(
        {"category_id": F.lit(7), "brand": F.lit("b"), "model": F.lit("m"), "specs": F.create_map(F.lit("k"), F.lit("v"))}
    )
    costs = spark.createDataFrame([(1, 100.0, None), (2, 90.0, None), (3, 90.0, None), (4, None, 120.0)], "variant_id int, lowest_final_cost double, lowest_installment_total double")
    requested = spark.createDataFrame([(1,)], "variant_id int")
    got = {r["alternative_id"]: r["price_gap"] for r in browse.alternatives(requested, variants, costs).collect()}
    assert got == {2: -10.0, 4: None}


def test_json_walk_has_no_depth_limit(spark):
    product = '{"@type": "Product", "name": "Deep", "price": "120", "url": "https://s.example/p"}'
    for levels in (0, 9, 20):
        body = '{"a": [' * levels + product + "]}" * levels
        docs = spark.createDataFrame([(1, "https://s.example/", body)], "page_id int, url string, body string")
        assert [r["title"] for r in ex.candidates_from_json(docs).collect()] == ["Deep"], levels
        html = docs.selectExpr("page_id", "url", """concat('<script type="application/ld+json">', body, '</script>') AS html""")
        assert [r["title"] for r in ex.extract_jsonld(html).collect()] == ["Deep"], levels


def test_import_fields_have_no_depth_limit(spark):
    record = '{"a": ' * 20 + '{"title": "Deep", "price": "120"}' + "}" * 20
    rows = spark.createDataFrame([(record,), ('{"title": "Flat", "x": {"title": "no"}}',)], "body string").selectExpr("parse_json(body) AS record")
    assert {r["title"] for r in ex.normalize_import(rows).collect()} == {"Deep", "Flat"}
