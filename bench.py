"""Times the reports on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioflow import StarTables  # noqa: E402
from folioflow.plans.catalogue import REPORTS, shown  # noqa: E402
from folioflow.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "2"))

# One or two reports of each family; ``--all`` times every one.
HEADLINE = [
    "ledger_detail", "ledger_by_account", "ledger_by_account_partner", "ledger_by_partner", "ledger_combined",
    "ledger_detail_with_balances", "trial_balance", "trial_balance_by_partner", "trial_balance_levels", "journal_audit",
    "journal_audit_labelled", "journal_book_taxes", "journal_book_print_rows", "purchase_lines", "sales_lines_labelled",
    "product_margin", "stock_availability", "inventory_categories", "invoice_detail", "line_amounts", "order_links",
    "sales_pivot", "purchase_pivot", "stock_pivot",
]


def seconds(tables: StarTables, name: str) -> float:
    start = time.perf_counter()
    shown(REPORTS[name](tables)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, memory="12g")
    asked = sys.argv[1:]
    names = list(REPORTS) if asked == ["--all"] else asked or HEADLINE
    tables = StarTables(spark, SF_DIR)
    seconds(tables, "trial_balance_levels")  # warm the JVM
    times = {name: round(min(seconds(tables, name) for _ in range(ROUNDS)), 3) for name in names}
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "report_seconds_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else SF_DIR,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
