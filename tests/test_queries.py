"""Contract of the registered queries, and a sample of them against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tests.conftest import SMALL
from verify_checks import compare, database

SAMPLE = (
    "offer_summary", "ledger_change_types", "price_ratio_gate", "market_guard_replay", "price_history", "decision_scores",
    "purchase_decisions", "store_quality", "identity_clusters", "smart_search", "jsonld_offers", "instalment_plans", "stream_change_feed",
)


def test_contract():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert len(queries) > 150 and set(oracles) <= set(queries)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = compare(entry_points.queries()[name](spark, SMALL), database(SMALL), entry_points.oracle_sql()[name])
    assert got.startswith("ok"), got


def test_merge_is_idempotent(tables):
    from offerlake.operators.merge import merge_latest

    obs = tables.fx_observations.select("offer_key", "observed_at", "obs_id", "coupon_code")
    policies = {"coupon_code": "keep_non_null"}
    once = merge_latest(obs, obs.limit(0), ["offer_key"], "observed_at", policies)
    twice = merge_latest(once, obs, ["offer_key"], "observed_at", policies)
    key = lambda df: sorted((r["offer_key"], str(r["observed_at"])) for r in df.collect())
    assert key(once) == key(twice)
