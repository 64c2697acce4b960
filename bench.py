"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma separated, default the headline list) select the run.
"""

from __future__ import annotations

import json
import os
import time

from loanpanel.session import build_session
from verification.catalog import QUERIES

HEADLINE = [
    "raw_parse", "impute_median", "dedup_last", "static_master", "panel_join", "master_append",
    "stream_ingest", "macro_wide", "macro_pca", "macro_join", "stratified_sample", "sample_panel",
    "balanced_sample", "loan_summary", "panel_overview", "quarter_dlq", "naive_survival",
    "transition_matrix", "time_gaps", "by_time", "describe_varying", "describe_within",
    "corr_within", "stress_decile", "credit_impact", "exit_analysis", "density_by_outcome",
    "survival_table", "nelson_aalen", "c_index", "cox_fit", "cox_scores", "macro_effect", "rsf_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["quarter_dlq"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
