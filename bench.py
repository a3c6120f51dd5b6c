"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), and
BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "rewrite_instructions",
    "rewrite_nested",
    "variant_draw",
    "first_instruction_steps",
    "episodes_per_instruction_long",
    "pool_merge",
    "prompt_cross",
    "running_success",
    "run_success_rollup",
    "metric_rows",
    "scope_suite_cube",
    "rollout_outcome",
    "first_trials",
    "log_parse",
    "moving_loss",
    "masked_accuracy",
    "action_stats",
    "text_lookup_default",
    "resume_remaining",
    "stable_ordinals",
    "split_parts",
    "enrich_stub",
    "rerequest_rounds",
    "messages_interleaved",
    "parse_json_props",
    "keyed_upsert",
    "shards_merged",
    "shard_assign",
    "jsonl_prefix",
    "shard_roundtrip",
    "stream_success",
    "stream_enrich",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    from varlake.plans import QUERIES

    if names == ["all"]:
        names = list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("varlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's readers, code generator and Python workers outside the measurement.
    QUERIES["variant_draw"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["enrich_stub"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
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
