"""Times the headline queries; prints one JSON line.

``score_events`` is the end-to-end plan (features, scores, policy) without stored intermediates of an
earlier query; the others run as registered, on top of the stored feature table.  An operator that takes less than
``REPEAT_BELOW`` seconds cold runs twice more and counts with the median of its warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from vigil.functions.session import local_session

OPERATORS = [
    "sender_features", "recipient_network", "agent_terminal", "recipient_reputation_asof", "profile_view",
    "sketch_lookup", "campaign_memory", "anomaly_score", "reason_codes", "regret_budget", "policy_outcome",
    "customer_explanation", "mode_timeline", "audit_verify", "drift_report", "roc_auc", "ablation_table",
    "leakage_audit", "case_queue", "validate_events",
]


#: Seconds above which a cold run stands alone, so that the bench ends in time.
REPEAT_BELOW = 10.0


def once(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def run(build) -> tuple[float, float]:
    """(seconds that count, seconds of the cold run)"""
    cold = once(build)
    warm = [once(build), once(build)] if cold < REPEAT_BELOW else [cold]
    return round(statistics.median(warm), 3), round(cold, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "vigil-bench")
    from vigil.plans.fixtures import inputs
    from vigil.plans.registry import QUERIES

    data = inputs(spark, sf_dir)
    times, cold = {}, {}
    # The stages of the plan apart, each on the stored result of the one before.
    stages = {}
    for name in ("events", "features", "sketches", "scored", "decisions"):
        start = time.perf_counter()
        getattr(data, name)
        stages[name] = round(time.perf_counter() - start, 3)
    times["score_events"] = cold["score_events"] = round(sum(stages.values()), 3)
    for name in OPERATORS:
        times[name], cold[name] = run(lambda name=name: QUERIES[name](spark, sf_dir))
    events = data.events.count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "events": events,
        "stages": stages, "cold": cold, "events_scored_per_sec": round(events / times["score_events"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
