"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

import loomframe.queries  # noqa: F401  (registers the queries)
from loomframe.registry import QUERIES
from loomframe.session import get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "profile_lineitem", "agg_year_mean", "agg_year_median", "join_inner_1m", "join_left", "join_full", "join_report", "join_multiway_panel", "reshape_wide_to_long", "agg_quantiles",
    "missing_ffill", "missing_linear", "validate_keys", "validate_outlier", "derive_ratio", "url_canon_dedup", "fuzzy_title_pairs", "html_quality", "stream_dedupe",
)


def main() -> None:
    spark = get_session(f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES["join_inner_1m"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # the JVM starts, classes load
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
