"""Sliced (hot-key) paths must equal the plain ones; every key is hot under these rules."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlake.config import SkewRules
from offerlake.operators import ledger, replay, skew

HOT = SkewRules(max_hot_keys=1000, min_rows=20, slices=7, slice_days=3, slices_per_octave=2)
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def obs(spark):
    dice = random.Random(7)
    rows = []
    for i in range(1500):
        key = 0 if i % 3 else dice.randrange(1, 40)
        price = dice.choice([100.0, 120.0, 150.0, 90.0, 700.0, 4000.0, 9.0, 20.0])
        rows.append((i, key, key, START + timedelta(hours=dice.randrange(0, 24 * 200)), price, 0.0, "EGP", "high", dice.choice(["available", "limited"])))
    return spark.createDataFrame(
        rows,
        "obs_id long, offer_key long, variant_id long, observed_at timestamp_ntz, cash_price double, shipping_cost double, "
        "currency string, match_confidence string, availability string",
    ).cache()


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_previous_across_slices(obs):
    w = Window.partitionBy("offer_key").orderBy("observed_at", "obs_id")
    expected = obs.withColumn("p", F.lag("cash_price").over(w))
    got = skew.with_previous(obs, ["offer_key"], ["observed_at", "obs_id"], {"p": F.col("cash_price")}, HOT)
    key = lambda df: sorted((r[0], r[1] or -1) for r in df.select("obs_id", "p").collect())
    assert key(got) == key(expected)


def test_running_sum_and_rank_across_slices(obs):
    w = Window.partitionBy("offer_key").orderBy("cash_price", "obs_id")
    expected = obs.withColumn("n", F.row_number().over(w))
    got = skew.with_row_numbers(obs, ["offer_key"], {"n": (["cash_price", "obs_id"], F.col("cash_price"))}, HOT)
    assert rows_of(got, "obs_id", "n") == rows_of(expected, "obs_id", "n")


def test_change_labels_across_slices(obs):
    assert rows_of(ledger.with_change_type(obs, rules=HOT).fillna("-"), "obs_id", "change_type") == rows_of(
        ledger.with_change_type(obs).fillna("-"), "obs_id", "change_type"
    )


def _gate_by_hand(prices):
    base, out = None, []
    for p in prices:
        ok = base is None or 0.2 <= p / base <= 5
        out.append((ok, base))
        base = p if ok else base
    return out


def test_gate_walk_matches_a_plain_loop():
    dice = random.Random(3)
    for _ in range(200):
        prices = [dice.choice([1.0, 4.0, 6.0, 30.0, 200.0, 1100.0]) for _ in range(dice.randrange(1, 30))]
        accepted, bases, last = replay._replay_gate(np.array(prices), np.nan, 0.2, 5.0)
        plain = _gate_by_hand(prices)
        assert [bool(a) for a in accepted] == [a for a, _ in plain]
        assert [None if np.isnan(b) else b for b in bases] == [b for _, b in plain]
        assert last == [p for p, (ok, _) in zip(prices, plain) if ok][-1]


def test_gate_across_slices(obs):
    plain = replay.gate_price_ratio(obs).fillna(-1.0)
    sliced = replay.gate_price_ratio(obs, skew=HOT).fillna(-1.0)
    assert rows_of(sliced, "obs_id", "accepted", "base_price") == rows_of(plain, "obs_id", "accepted", "base_price")
    assert any(not r["accepted"] for r in plain.collect())


def test_market_median_across_slices(obs):
    expected = {}
    data = obs.select("obs_id", "variant_id", "observed_at", "cash_price").collect()
    for r in data:
        seen = [
            x["cash_price"] for x in data
            if x["variant_id"] == r["variant_id"] and x["cash_price"] >= 10
            and r["observed_at"] - timedelta(days=30) <= x["observed_at"] < r["observed_at"]
        ]
        expected[r["obs_id"]] = float(np.median(seen)) if seen else None
    for rules in (SkewRules(), HOT):
        got = {r["obs_id"]: r["market_median"] for r in replay.with_market_median(obs, 30, skew=rules).collect()}
        assert got == expected


NO_JOBS = (
    "change_types", "ledger_change_types", "compacted_ledger", "failure_streaks", "price_changes", "ranked_offers", "ranked_visible_plans", "mode_orders", "ranked_plans",
)


def test_building_an_ordered_query_runs_no_job(spark):
    import checks

    checks.load_all()
    context = spark.sparkContext
    context.setJobGroup("building", "plans only")
    for name in NO_JOBS:
        checks.QUERIES[name](spark, "/root/testdata/sf0.001")
    jobs = context.statusTracker().getJobIdsForGroup("building")
    context.setLocalProperty("spark.jobGroup.id", None)
    # each table's footer is read once for its schema; nothing else may run
    readers = {context.statusTracker().getJobInfo(j).jobId for j in jobs}
    assert len(readers) <= 14 * len(NO_JOBS) and not any(len(context.statusTracker().getJobInfo(j).stageIds) > 1 for j in jobs)


def test_slices_never_fall(spark):
    frame = spark.sql("SELECT CAST(id - 500 AS DOUBLE) * abs(id - 500) AS x, timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS t FROM range(1000)")
    for lead in ("x", "t"):
        w = Window.orderBy(lead)
        steps = frame.withColumn("s", skew.fixed_slice(frame, F.col(lead))).withColumn("before", F.lag("s").over(w))
        assert steps.filter("before > s").count() == 0 and steps.select("s").distinct().count() > 5
    assert frame.limit(1).select(skew.fixed_slice(frame, F.lit(None).cast("double"))).first()[0] == -(2**62)


def test_row_numbers_of_several_orders(obs):
    orders = {"n": (["cash_price", "obs_id"], F.col("cash_price")), "m": ([F.col("cash_price").desc(), "obs_id"], -F.col("cash_price"))}
    expected = obs
    for alias, (order, _) in orders.items():
        expected = expected.withColumn(alias, F.row_number().over(Window.partitionBy("offer_key").orderBy(*order)))
    assert rows_of(skew.with_row_numbers(obs, ["offer_key"], orders, HOT), "obs_id", "n", "m") == rows_of(expected, "obs_id", "n", "m")
