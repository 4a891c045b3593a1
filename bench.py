"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores. Every query is
run to the end into a no-op sink, after one warm-up query on the same data.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from defectflow.plans.catalog import QUERIES  # noqa: E402
from defectflow.session import local_session  # noqa: E402

HEADLINE = (
    "triage clean_serving clean_training classifier_text hash_embedding cluster_centroids nearest_centroid "
    "action_sequence parse_steps seq2seq_dataset stratified_split describe_steps describe_values cluster_samples "
    "cluster_keywords silhouette_exact silhouette_squared ward_cluster k_sweep_squared rouge_1 rouge_2 rouge_l meteor "
    "bertscore_static critical_step_scores topic_distribution centroid_drift low_confidence apply_corrections "
    "stream_topic_distribution train_and_triage forest_predict triage_classified ward_merges"
).split()
# Queries whose work is one pass over the findings (one per order).
PER_FINDING = ("triage", "clean_serving", "action_sequence", "train_and_triage")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    findings = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    QUERIES["triage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "findings": findings,
        "findings_per_sec": {name: round(findings / seconds[name]) for name in PER_FINDING},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
