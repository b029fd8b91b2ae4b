from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from offerlake.operators import ledger, replay
from offerlake.plans import decide, history

NOW = datetime(2026, 7, 30, 12)


def test_cash_cost(spark):
    df = spark.createDataFrame(
        [(25000.0, 120.0, 30.0, 50.0, 300.0, None), (25000.0, 0.0, 0.0, 0.0, 0.0, 25250.0), (2.0, 0.0, 0.0, 0.0, 0.0, None)],
        "cash_price double, shipping_cost double, mandatory_fees double, card_fees double, coupon_discount double, total_price double",
    )
    assert [r[0] for r in df.select(decide.cash_final_cost(df)).collect()] == [24900.0, 25250.0, None]


def plans(spark, rows):
    names = (
        "plan_id long, variant_id long, store_id long, provider_name string, months int, periodic_payment double, down_payment double, "
        "admin_fees double, processing_fees double, insurance_fees double, other_fees double, card_fees double, shipping_cost double, "
        "coupon_discount double, total_published double, total_calculated double, anomaly_status string, cash_price_at_observation double"
    )
    return spark.createDataFrame(rows, names)


def test_instalment_cost_and_dedup(spark):
    row = lambda i, months, total=None: (i, 1, 1, "Valu", months, 1000.0, 2000.0, 400.0, 100.0, None, None, 50.0, 100.0, 150.0, total, None, "clear", 13000.0)
    ranked = decide.rank_plans(plans(spark, [row(1, 12), row(2, 12), row(3, None), row(4, 12, 12345.0)])).orderBy("plan_id").collect()
    assert [(r["plan_id"], r["final_installment_cost"]) for r in ranked] == [(1, 14500.0), (4, 12345.0)]
    assert [r["lowest_total"] for r in ranked] == [False, True]


def test_history(spark):
    rows = [
        (1, 1, "a", NOW - timedelta(days=20), 27000.0), (2, 1, "b", NOW - timedelta(days=10), 26000.0),
        (3, 1, "a", NOW - timedelta(days=1), 25000.0),
    ]
    obs = spark.createDataFrame(rows, "obs_id long, variant_id long, store_id string, observed_at timestamp_ntz, cash_price double")
    obs = obs.withColumn("shipping_cost", F.lit(0.0))
    got = history.price_history(obs, str(NOW)).first()
    assert (got["lowest_30d"], got["lowest_90d"], got["highest_90d"]) == (25000, 25000, 27000)
    assert got["change_count"] == 2 and got["trend"] == "declining" and len(got["sparkline"]) == 3
    assert got["store_count"] == 2 and got["sufficient_for_recommendation"]


def test_ranking_prefers_true_cost(spark):
    offers = spark.createDataFrame(
        [(1, "A", 9, 25000.0, 200.0, 0.0, "clear"), (2, "B", 9, 25200.0, 0.0, 300.0, "clear"), (3, "C", 9, 20000.0, 0.0, 0.0, "blocked")],
        "offer_id long, store_id string, variant_id long, cash_price double, shipping_cost double, coupon_discount double, anomaly_status string",
    ).withColumn("availability", F.lit("available"))
    past = spark.createDataFrame([(9, 26000.0, 24900.0, True)], "variant_id long, average_90d double, lowest_90d double, sufficient_for_recommendation boolean")
    rows = decide.mode_orders(decide.score_offers(offers, past, str(NOW))).orderBy("cheapest_rank").collect()
    assert [(r["store_id"], r["final_cost"]) for r in rows] == [("B", 24900.0), ("A", 25200.0)]
    assert rows[0]["price_position"]["tone"] in ("excellent", "good")
    assert all(0 <= r["decision_score"] <= 100 and 0 <= r["safety_score"] <= 100 for r in rows)


def observations(spark, prices):
    rows = [(i, "k", NOW + timedelta(hours=i), p, "available") for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "obs_id long, offer_key string, observed_at timestamp_ntz, cash_price double, availability string")


def test_ledger_keeps_changes_only(spark):
    kept = ledger.compact_ledger(observations(spark, [10000.0, 10000.0, 10500.0])).orderBy("obs_id").collect()
    assert [(r["obs_id"], r["change_type"]) for r in kept] == [(0, "first_seen"), (2, "price_changed")]
    assert ledger.current_offers(observations(spark, [10000.0, 10000.0, 10500.0])).first()["cash_price"] == 10500.0


def test_gate_compares_with_last_accepted_price(spark):
    got = replay.gate_price_ratio(observations(spark, [10000.0, 100.0, 110.0, 9000.0, 50000.0])).orderBy("obs_id").collect()
    assert [r["accepted"] for r in got] == [True, False, False, True, False]
    assert [r["base_price"] for r in got] == [None, 10000.0, 10000.0, 10000.0, 9000.0]


def test_incremental_gate_and_changes(spark):
    current = observations(spark, [10000.0])
    assert [r["accepted"] for r in ledger.gate_against(observations(spark, [100.0]), current).collect()] == [False]
    assert ledger.changes_against(observations(spark, [10000.0]), current).first()["change_type"] is None


def test_weak_match_is_reviewed_in_both_languages(spark):
    df = spark.createDataFrame([("low",), ("منخفضة",), ("عالية",)], "c string")
    verdict = ledger.cash_verdict(F.lit(100.0), F.lit(100.0), F.lit("EGP"), F.col("c"), F.lit("available"))
    assert [r[0]["anomaly_status"] for r in df.select(verdict).collect()] == ["review", "review", "clear"]
