"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import pixel as P
from rasterloom.sources import views as V
from rasterloom.suite import load

SF = "/root/testdata/sf0.001"
QUERIES = load()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", """convolve gaussian_blur kuwahara rotate fft_bandpass clahe slit_scan phosphor_decay
as_of_frame_selection voronoi preset_similarity_report nearest_centroid_vectors quantize_no_dithering pixelsort
motion_vectors tempo_tracker option_modulation bench_compare range_fallback""".split())
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["convolve", "median_filter", "luma_channel_histogram"])
def test_frames_are_exchanged_before_they_are_exploded(spark, name):
    text = plan(QUERIES[name](spark, SF))
    lines = text.splitlines()
    first_explode = next(i for i, t in enumerate(lines) if "Generate" in t)
    assert not any("Exchange" in t for t in lines[:first_explode])


def test_pixel_chains_are_map_only_and_prune_columns(spark):
    df = P.posterize(P.invert(V.channel_carrier(spark, SF)), levels=4)
    text = plan(df)
    assert "Exchange" not in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey"}


def test_filters_reach_the_scan(spark):
    df = V.table(spark, SF, "lineitem").where(F.col("l_quantity") > 40).select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan(df)
