"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_REPEAT``
how often a query runs (the best run counts; a short warm-up starts the JVM).
"""

import json
import os
import sys
import time

from triarm.plans import all_queries
from triarm.session import build_session
from triarm.sources.scratch import working

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))

HEADLINES = (
    "summary_table",
    "accuracy_scan_grid",
    "canonical_dataset",
    "replicate_splits",
    "prompt_pack",
    "experiment_arms",
    "permutation_test",
    "fdr_bh",
    "spearman_null",
    "meta_replicates",
    "effect_bootstrap",
    "posterior_marginal",
    "posterior_conditional",
    "hdi_summary",
    "describe_datasets",
    "rank_gaps",
    "pca_experiment",
    "results_stream",
)


def main() -> None:
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", master=f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["summary_table"].run(spark, SF_DIR).collect()
    for name in names:
        runs = []
        for _ in range(REPEAT):
            start = time.perf_counter()
            with working(spark):
                # The sink takes every row and column and keeps nothing.
                queries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
