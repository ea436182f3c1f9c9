"""Time the headline queries and print one JSON line.

Each query is written to Spark's ``noop`` sink, so every row and column is computed and
nothing is collected.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "line_consensus", "line_agreement", "consensus_majority", "consensus_weighted", "consensus_summary", "accuracy_by_level", "problematic_cases",
    "repetition_consensus", "pairwise_agreement", "cohen_kappa", "fleiss_kappa", "krippendorff_alpha",
    "model_metrics", "classification_report", "reliability_bins", "ece", "brier_balanced", "text_id_dedup",
    "duplicate_report", "fold_assignment", "cv_alignment", "perspectivism", "parse_responses", "tfidf_weights",
    "weighted_sample", "selection_removals", "filter_overview", "design_cells_2x2x2", "factorial_effects",
    "anova_one_way", "lpm_models", "confidence_quantiles", "annotate_job", "training_folds",
]


def main() -> None:
    from accordant.session import local_session
    from workload.catalogue import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g",
                          **{"spark.checkpoint.dir": Path(tempfile.mkdtemp(prefix="bench-")).as_uri()})
    REGISTRY["consensus_levels"].query(spark, sf_dir).collect()  # start-up is not part of a query
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
