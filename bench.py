"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 to time every registered query. Each query runs once to warm up
and then once for the time; every output row is computed and thrown away.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from foliolens.plans import load_all  # noqa: E402
from foliolens.session import build_session  # noqa: E402

HEADLINE = ["g3_overlap_pairs", "g10_assign_region", "g21_vertical_occupancy", "g24_line_spacing_projection", "g55_artifact_profile",
            "f5_overlap_report", "f7_coalesce_reviews", "f9_overflow_group", "c8_region_contrast", "t12_rewrite_report", "t14_classify_boundary",
            "h1_html_tokens", "e4_drift", "e16_ledger_chain", "m5_path_conflicts", "m6_merge_leaves",
            "g27_artifact_minima", "g16_coalesce_baselines", "g47_perimeter_contact", "c12_visible_ink", "m1_to_leaves", "t17_explicit_break_lint", "g31_ancestor_pairs", "r2_retry_guard_stream"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    queries, _ = load_all()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_ALL"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": pathlib.Path(sf_dir).name, "cpus": cpus}))


if __name__ == "__main__":
    main()
