"""Time the headline queries and print one JSON line.

Every query runs over its whole tables and is written to Spark's ``noop`` sink,
so all columns of all rows are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from ionloom.plans.catalog import QUERIES
from ionloom.session import get_spark

HEADLINE = [
    "library_precursors",
    "missed_cleavage_digest",
    "digest_per_protease",
    "peptide_to_protein_with_decoys",
    "unique_peptides_sorted",
    "variable_modification_forms",
    "coded_sequences",
    "integer_encoded_peptides",
    "peptide_masses",
    "fragment_ion_ladder",
    "nearest_peak_match_high",
    "nearest_peak_match_low",
    "training_samples",
    "last_spectrum_per_key",
    "new_peptides_for_library",
    "exact_train_test_split",
    "split_per_dataset",
    "outlier_mask_per_language",
    "retention_masked_likelihood",
    "spectral_masked_score",
    "spectrum_blob_round_trip",
    "library_file_round_trip",
    "fasta_scan",
    "batched_retention_scores",
    "library_entries",
    "retention_model_fit",
    "fragment_model_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "ionloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(4 * int(cpus)),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("decoy_sequences")  # start the JVM's compiler and the Python workers
    run("batched_retention_scores") if len(names) > 3 else None
    seconds = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
