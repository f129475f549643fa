"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyloom.session import local_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "A01_monthly_summary",
    "A02_category_summary",
    "A03b_trend_pivot",
    "A04_budget_vs_actual",
    "A05_tag_summary",
    "A09_top_merchants",
    "A16_net_worth",
    "E01_recategorise",
    "E02_learned_rules",
    "E04_split_overrides",
    "H02_holding_state",
    "J06_collapse_conversions",
    "J07_learned_lookup",
    "J08_latest_balance",
    "L01_section_detect",
    "N01_newest",
    "Q01_transactions",
    "Q04_year_review",
    "Q05_sheet_outgoing",
    "Q11_tax_return",
    "R02_categorize",
    "R04_tags",
    "R07_backfill_with_overrides",
    "R09_normalize",
    "S05_read_paypal_csv",
    "S07_stitch_ing",
    "W02_first_copy",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, app="bench")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    timings = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
