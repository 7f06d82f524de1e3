"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

    python bench.py [--all | query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from scriptorium.plans.registry import QUERIES
from scriptorium.session import local_session

HEADLINES = (
    "find_literal",
    "find_casefold",
    "find_capped",
    "find_each",
    "find_positions",
    "match_summary",
    "info",
    "positions",
    "text_slice",
    "position_lookup",
    "replace_all",
    "replace_first",
    "insert_text",
    "delete_range",
    "diff_bounds",
    "diff",
    "as_of",
    "list_numbers",
    "markdown_pages",
    "table_markdown",
    "style_chain",
    "html_preview",
    "docx_roundtrip",
    "docx_outline",
    "docx_markdown",
    "find_wildcards",
    "edits_in_order",
    "docx_find",
    "docx_formatting",
    "stream_changes",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    # Start the JVM's and the Python workers' machinery before the clock runs.
    spark.range(1000).repartition(8).mapInPandas(lambda batches: batches, "id long").count()
    seconds = {}
    names = list(QUERIES) if sys.argv[1:] == ["--all"] else sys.argv[1:] or HEADLINES
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(directory).removeprefix("sf"),
        "cores": int(os.environ.get("BENCH_CPUS", "8")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
