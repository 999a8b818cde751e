"""Wall time of the headline queries: one JSON line on stdout.

Each query is run to completion into a no-op sink, after one warm-up query that starts the JVM and the readers."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.catalog import QUERIES
from panelweave.session import local_session

HEADLINE = [
    "monthly_returns",
    "filled_asof_month_end",
    "trailing_features",
    "forward_labels",
    "sector_relative",
    "return_fifths",
    "score_ranks",
    "liquidity_features",
    "range_volatility",
    "return_shape",
    "price_position",
    "market_beta",
    "macro_features",
    "feature_medians",
    "final_portfolio",
    "turnover_and_cost",
    "performance_summary",
    "performance_by_fold",
    "variant_comparison",
    "construction_grid",
    "period_evaluation",
    "rebalance_orders",
    "price_source_diff",
    "ledger_upsert",
    "analog_neighbors",
    "analog_statistics",
    "panel_latents",
    "panel_analog_features",
    "rank_model_scores",
    "walk_forward_scores",
    "stream_closed_days",
    "stream_valuation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    QUERIES["latest_price_rows"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
