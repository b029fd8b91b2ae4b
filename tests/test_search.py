"""Similarity join and batch search against brute force at their own thresholds."""

from __future__ import annotations

import random
import re

import pytest

from offerlake.operators import matching
from offerlake.plans import search


def grams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return {p[i : i + 3] for p in (f"  {w} " for w in words) for i in range(len(p) - 2)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def phrases(seed, count, longest):
    deal = random.Random(seed)
    words = ["tv", "a", "x", "lcd", "galaxy", "gala", "laxy", "phone", "phones", "washer", "12", "256", "gb", "smart", "black", "is", "qled"]
    return [" ".join(deal.choices(words, k=deal.randint(1, longest))) for _ in range(count)]


@pytest.mark.parametrize("threshold", [0.12, 0.18, 0.6, 1.0])
def test_similarity_join_equals_brute_force(spark, threshold):
    left, right = phrases(1, 60, 4) + ["", "--"], phrases(2, 90, 9) + ["", "a"]
    rows = matching.similarity_join(*(spark.createDataFrame([(t,) for t in side], "text string") for side in (left, right)), threshold)
    found = {(r.left_text, r.right_text): r.similarity for r in rows.collect()}
    wanted = {(a, b): similarity(a, b) for a in left for b in right if grams(a) and grams(b) and similarity(a, b) >= threshold}
    assert found == pytest.approx(wanted)


def test_smart_search_equals_brute_force(spark):
    queries = sorted(set(phrases(3, 40, 3))) + ["sku7", "alax"]
    names, documents, other = phrases(4, 80, 4), phrases(5, 80, 12), phrases(6, 80, 3)
    rows = [(i, n, d, f"sku{i}", None, i % 9 > 0, "catalog") for i, (n, d) in enumerate(zip(names, documents, strict=True))]
    variants = spark.createDataFrame(
        rows, "variant_id int, canonical_name string, search_document string, manufacturer_sku string, gtin string, active boolean, source_status string"
    )
    aliases = spark.createDataFrame(list(enumerate(other)), "variant_id int, normalized_alias string")
    found = search.smart_search(spark.createDataFrame([(q, q) for q in queries], "query_id string, query string"), variants, aliases, 100)
    got = {(r.query_id, r.variant_id): r.search_score for r in found.collect()}
    wanted = {}
    for q in queries:
        holds = lambda text, least: q in text and grams(q) & grams(text) or similarity(q, text) > least  # noqa: E731, B023
        for i, name, document, sku, _, active, _ in rows:
            scores = [similarity(q, document)] * bool(holds(document, 0.12)) + [similarity(q, other[i])] * bool(holds(other[i], 0.18)) + [1.0] * (q == sku)
            if active and scores:
                wanted[q, i] = max(*scores, similarity(q, name))
    assert got == pytest.approx(wanted)


@pytest.mark.parametrize("k", [2, 12])
def test_fuzzy_candidates_equal_brute_force(spark, k):
    titles, names = phrases(7, 50, 5), phrases(8, 60, 5)
    items = [(i, t, f"g{i}" if i % 7 == 0 else None, f"s{i}" if i % 5 == 0 else None) for i, t in enumerate(titles + titles[:10])]
    variants = [(i, n, f"g{i * 2}" if i % 3 == 0 else None, f"s{i}" if i % 2 else None) for i, n in enumerate(names)]
    found = matching.fuzzy_candidates(
        spark.createDataFrame(items, "item_id int, title string, gtin string, sku string"),
        spark.createDataFrame(variants, "variant_id int, canonical_name string, gtin string, manufacturer_sku string"), k, 0.18,
    )
    got = {(r.item_id, r["rank"]): (r.variant_id, round(r.similarity, 9)) for r in found.collect()}
    wanted = {}
    for i, title, gtin, sku in items:
        ranked = []
        for v, name, code, part in variants:
            alike = similarity(title, name)
            tier = 0 if gtin and gtin == code else 1 if sku and sku == part else 2
            if tier < 2 or alike >= 0.18:
                ranked.append((tier, -(alike if alike >= 0.18 else 0.0), v))
        wanted |= {(i, at): (v, round(-s, 9)) for at, (_, s, v) in enumerate(sorted(ranked)[:k], 1)}
    assert got == wanted
