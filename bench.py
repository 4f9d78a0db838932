"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to a no-op sink (all columns of all rows are computed) once
to warm up on the same data and then ``BENCH_RUNS`` times; the best counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from ledgerloom.plans import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "inv_header_vs_lines", "line_identity", "running_balance", "bank_header_vs_tx", "stmt_cross_checks",
    "rules_income_statement", "rules_balance_sheet", "document_line_rules", "parse_numbers", "confidence_bands",
    "row_routing", "registry_view", "exact_rows", "measures_by_dim", "synonym_remap", "null_fill_donors",
    "doc_catalog", "exact_dedup", "job_state_fold", "schema_router", "ixbrl_facts", "normalize_tables",
    "table_stitch", "reading_order", "sibling_context", "row_batches", "page_plan", "text_chunks",
    "few_shot_topk", "graph_merge", "vector_topk", "vector_topk_batch", "eval_summary",
]


def run(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(cpus, partitions=int(os.environ.get("BENCH_PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(min(run(spark, name, folder) for _ in range(runs)), 3)
        if "--verbose" in sys.argv:
            print(name, times[name], file=sys.stderr)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))


if __name__ == "__main__":
    main()
