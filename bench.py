"""Time the headline queries and print one JSON line. BENCH_SF_DIR names the data, BENCH_CPUS the cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.catalog import QUERIES  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINE = [
    "agg_2_latest_per_customer",
    "agg_3_status_counters",
    "agg_6_duplicate_census",
    "agg_13_invoice_totals",
    "win_1_document_dedupe",
    "win_2_identical_file",
    "jn_4_reconcile_keys",
    "jn_5_field_mismatch",
    "jn_6_orphan_objects",
    "jn_10_link_type_aware",
    "jn_13_strict_cascade",
    "jn_16_scored_tiers",
    "jn_18_assignment",
    "jn_20_unique_parent",
    "rul_2_class_from_text",
    "val_1_field_sanity",
    "dml_4b_upsert_result",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["src_1_table_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
