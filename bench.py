"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Every query runs to the end through a sink that drops the
rows; a first pass over a small query warms the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rasterloom.plans.session import build_session  # noqa: E402
from rasterloom.suite import load  # noqa: E402

HEADLINE = [
    "flagship_equalised_luma", "ordered", "ordered_pico_8", "quantize_no_dithering", "user_palette_nearest_match",
    "chain_fold", "offline_chain_render", "rgba_to_lab", "convolve", "gaussian_blur", "kuwahara", "median_filter",
    "rotate", "fft_bandpass", "histogram_equalization", "clahe", "unique_colours_counts", "median_cut", "k_means",
    "phosphor_decay", "time_median", "slit_scan", "poster_hold", "motion_vectors", "as_of_frame_selection",
    "identical_run_collapse", "pixelsort", "spectral_flux_onset", "tempo_tracker", "preset_similarity_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("rasterloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]

    def run(name: str) -> float:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for name in ("none", "convolve"):
        run(name)
    times = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
