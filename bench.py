"""Wall time of the headline queries: one JSON line, median of BENCH_RUNS runs after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

import checks
from offerlake.session import local_session

HEADLINE = (
    "offer_summary", "public_cash_offers", "current_offer_projection", "ledger_change_types", "price_ratio_gate",
    "market_guard_replay", "market_guard_batch", "price_history", "store_quality", "decision_scores", "mode_orders",
    "purchase_decisions", "ranked_plans", "coverage_ledger", "priced_directory", "identity_clusters", "exact_matches",
    "sku_in_text_matches", "smart_search", "popularity_windows", "run_counters", "normalized_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    checks.load_all()
    spark = local_session(cores, int(os.environ.get("BENCH_SHUFFLE", "8")), "bench")

    def run(name: str) -> float:
        began = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timings = {}
    for name in wanted:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
