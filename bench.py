"""Wall times of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. Every query is run to the end
into the no-op sink, so all result columns are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boardlake.plans import load  # noqa: E402
from boardlake.plans.catalog import QUERIES  # noqa: E402
from boardlake.session import local_session  # noqa: E402

HEADLINE = [
    "d01_kpi_totals", "d01_kpi_by_lot", "c01_listing_join", "f01_listing_page", "b02_search_three_columns",
    "c03_detail_with_evidence", "d19_pilot_acceptance", "d03_column_profile", "d05_category_totals",
    "e03_first_seen_duplicates", "e04_ordered_split", "g01_sha256", "g19_preprocessed_splits", "c16_manifest_comparison",
    "h02_version_manifest", "c08_document_diff", "e09_revision_gaps", "e10_transition_check", "h06_replay_comparison",
    "d11_class_report", "d23_image_auroc", "c12_nearest_neighbours", "i05_gaussian_naive_bayes", "i14_position_gaussians",
    "l01_median_mad_fit", "l04_structural_similarity", "l09_mahalanobis_score", "k05_otsu_threshold", "k12_gaussian_blur",
    "k16_connected_components", "j03_pose_deviation", "m04_tumbling_kpis",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = sys.argv[1:]
    load()
    spark = local_session("bench")
    QUERIES["d01_kpi_totals"].run(spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
