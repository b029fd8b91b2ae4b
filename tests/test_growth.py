"""Work that must not grow faster than its input."""

from __future__ import annotations

import pytest

import checks
from offerlake.operators import matching as m
from offerlake.plans import search

checks.load_all()
SMALL = "/root/testdata/sf0.001"

VARIANTS = (
    "variant_id long, canonical_name string, brand string, model string, manufacturer_sku string, gtin string, storage_gb double, ram_gb double, "
    "color string, source_status string, active boolean"
)
ITEMS = "item_id long, title string, normalized_url string, brand string, sku string, gtin string, price double"


def test_texts_that_say_the_same_meet_like_variants_once(spark, monkeypatch):
    """40 variants and 60 texts of one model: what is scored depends on sizes and colours alone, and a code still finds its variant."""
    variants = [(i, "", "Acme", "blue rocket", f"MX{i}", f"62200000000{i:02d}", 64.0 if i < 39 else 128.0, None, "blue", "catalog", True) for i in range(40)]
    items = [(i, "Acme blue rocket 64 GB", f"https://shop.example/{i}", "Acme", None, None, 1.0) for i in range(58)]
    items += [(58, "Acme blue rocket 128 GB", "https://shop.example/58", "Acme", None, None, 1.0)]
    items += [(59, "Acme blue rocket 64 GB", "https://shop.example/59", "Acme", None, "6220000000007", 1.0)]
    scored, real = [], m.score_pairs

    def counted(pairs, *args, **kw):
        scored.append(pairs.count())
        return real(pairs, *args, **kw)

    monkeypatch.setattr(m, "score_pairs", counted)
    found = m.match_brand_model(spark.createDataFrame(items, ITEMS), spark.createDataFrame(variants, VARIANTS))
    assert {(r["item_id"], r["variant_id"]) for r in found.collect()} == {(58, 39), (59, 7)}
    assert 0 < sum(scored) < 10


def test_a_title_is_read_once_for_all_its_specifications(spark):
    plan = checks.QUERIES["inferred_specs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") <= 2


@pytest.mark.parametrize(("query", "most"), [("xml_feed_candidates", 21), ("meta_candidates", 8)])
def test_fields_of_a_page_are_read_once(spark, query, most):
    """Filters and columns that mention a field do not each hold its patterns again (41 and 16 before)."""
    plan = checks.QUERIES[query](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") <= most


def test_variants_alike_to_every_query_are_ranked_by_their_first_k(spark, monkeypatch):
    """300 variants that differ in their code alone: a query ranks ``k`` of them, and the one with its code."""
    rows = [(i, "blue gear", f"blue gear mx{i}", f"mx{i}", None, True, "catalog") for i in range(100, 400)]
    variants = spark.createDataFrame(
        rows, "variant_id int, canonical_name string, search_document string, manufacturer_sku string, gtin string, active boolean, source_status string"
    )
    aliases = spark.createDataFrame([(i, "gear") for i in range(100, 400)], "variant_id int, normalized_alias string")
    queries = spark.createDataFrame([("a", "blue gear"), ("b", "mx317")], "query_id string, query string")
    ranked, real = [], search.top_per

    def counted(df, keys, *args, **kw):
        if keys == ["key"]:
            ranked.append(df.filter("key = 'blue gear'").count())
        return real(df, keys, *args, **kw)

    monkeypatch.setattr(search, "top_per", counted)
    found = {(r["query_id"], r["rank"]): r["variant_id"] for r in search.smart_search(queries, variants, aliases, 3).collect()}
    assert [found["a", i] for i in (1, 2, 3)] == [100, 101, 102] and found["b", 1] == 317
    assert 0 < sum(ranked) < 60
