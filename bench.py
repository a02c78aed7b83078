"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of parquet tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerspark.plans import QUERIES
from ledgerspark.session import get_session

HEADLINE = [
    "txn_validate",
    "validation_summary",
    "duplicate_flag",
    "balance_continuity",
    "balance_fill",
    "financial_validation",
    "txn_search",
    "txn_page",
    "dashboard_summary",
    "recent_statements",
    "statement_listing",
    "sheet_validate",
    "voucher_entries",
    "correction_apply",
    "export_financial_summary",
    "words_to_lines",
    "bank_detect",
    "universal_parse",
    "profile_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
