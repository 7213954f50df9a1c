"""Queries against their SQL on the smallest tables.

A spread over the families by default; RASTERLOOM_ALL=1 runs every one.
"""

import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import TABLES, rows_of  # noqa: E402

from rasterloom.suite import load  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SOME = """flagship_equalised_luma levels color_shift ordered_white_noise_1_bit quantize_hsv user_palette_nearest_match
voronoi clahe median_cut k_means hex_pixelate step_time_totals bench_compare error_diffusion_vote motion_analysis_heat
temporal_edge long_exposure_additive chronophotography_average slit_scan poster_hold time_mosaic_stabiliser motion_vectors
vector_grid_blur as_of_frame_selection identical_run_collapse cadence_inference cadence_thinning offline_timeline
pixelsort_rows preset_similarity_report chain_remove_toggle_reorder_replace shared_state_ingest_v1_v2
curve_control_points_parse spectral_flux_onset tempo_tracker idle_gap_reset_session kuwahara bilateral_blur edge_trace
rotate channel_separation camera_shake fft_bandpass fft_cepstrum crc_stripe_reject data_bend_reverb
live_temporal_state streaming_slow_step_flag""".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("RASTERLOOM_ALL") else SOME)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == want_cols
    assert Counter(got) == Counter(want)
