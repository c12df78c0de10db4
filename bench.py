"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("time_bars_1h", "tick_bars_50", "dollar_bars", "cusum_filter", "triple_barrier_labels", "trend_scanning", "num_concurrent_events", "label_weights", "time_decay", "yang_zhang_volatility", "frac_diff_ffd", "corwin_schultz", "trade_lambdas", "chow_breaks", "drawdown_and_time_under_water", "average_active_signals", "purged_k_fold", "weighted_scores")


def main() -> None:
    from pyspark.sql import SparkSession

    from tickloom.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds, errors = {}, {}
    for name in HEADLINE:
        began = time.time()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
        except Exception as e:  # the others are still timed
            errors[name] = str(e).splitlines()[0][:200]
    found = {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(found | ({"errors": errors} if errors else {})))
    spark.stop()
    sys.exit(bool(errors))


if __name__ == "__main__":
    main()
