"""Time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned and then fully executed into Spark's ``noop`` sink
(every row computed, nothing collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadlens.session import get_session  # noqa: E402

HEADLINE = ("quality_profile", "clean_full", "text_stats", "lexicon_vector", "scaler_apply_lexicon",
            "encode_padded_mask", "labelled_samples", "fusion_forward", "class_report", "roc_auc",
            "best_test_at_best_val", "batch_assignment", "stream_clean_stats")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus, app_name="threadlens-bench",
                        driver_memory=os.environ.get("BENCH_DRIVER_MEM", "4g"))
    # the bench tables hold one row group each; PLANS.md is made with the same setting
    spark.conf.set("threadlens.scanPartitions", str(2 * cpus))
    from threadlens.plans import QUERIES

    names = only or sorted(QUERIES)
    # warm-up: JVM, codegen caches, file listing
    QUERIES["text_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # keep timing the others; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {errors[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    head = [q for q in HEADLINE if q in times]
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec", "value": round(sum(times[q] for q in head), 3),
        "unit": "sec", "queries": times, "all_total_sec": round(sum(times.values()), 3),
        "headline": head, "errors": errors, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
