"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from tapeloom.plans import catalog
from tapeloom.session import local_session

HEADLINES = ("bars", "long_short_spread", "macd", "feature_contract", "training_panel", "triple_barrier_label", "earnings_event_set",
             "asof_join_backward", "insider_ratio_trailing_90d", "information_coefficient", "rolling_information_coefficient", "ic_decay_sweep",
             "weighted_verdict", "strategy_statistics", "cost_sweep", "two_by_two_books", "position_pnl", "spearman_overall")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = catalog.queries()
    queries["bars"](spark, sf_dir).count()      # start the session and the file cache
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
