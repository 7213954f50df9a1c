"""Small frames and series against brute force, and the invariants of the operators."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import tables as T
from rasterloom.operators import aggregate as A
from rasterloom.operators import folds as FD
from rasterloom.operators import motion as M
from rasterloom.operators import nearest as N
from rasterloom.operators import ordered as O
from rasterloom.operators import remap as R
from rasterloom.operators import signals as S
from rasterloom.operators import spectral as SP
from rasterloom.operators import stencil as ST
from rasterloom.operators import temporal as TP
from rasterloom.operators import timeline as TL
from rasterloom.plans import chain as CH
from rasterloom.sources import media as MD

PX = "clip_id int, frame int, x int, y int, r int, g int, b int, a int"


def noise(w, h, frames=1, clips=1, seed=1):
    rnd = random.Random(seed)
    return [(c, f, x, y, rnd.randrange(256), rnd.randrange(256), rnd.randrange(256), 255)
            for c in range(clips) for f in range(frames) for y in range(h) for x in range(w)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def image(df, ch="r"):
    r = df.select("x", "y", ch).collect()
    out = np.zeros((max(p.y for p in r) + 1, max(p.x for p in r) + 1))
    for p in r:
        out[p.y, p.x] = p[ch]
    return out


def test_fixed_tables():
    assert T.bayer(2) == [[0.0, 0.5], [0.75, 0.25]]
    assert (np.array(T.bayer(8))[0] * 64).tolist() == [0, 48, 12, 60, 3, 51, 15, 63]
    for name in ("BLUE_NOISE_64X64", "WHITE_NOISE_64X64"):
        assert len(np.unique(np.array(T.threshold_map(name)))) == 4096
    assert T.map_levels("HATCH_2X2") == 2 and T.map_levels("BAYER_4X4") == 16


def test_known_colours(spark):
    df = spark.createDataFrame([(128, 64, 192, 255)], "r int, g int, b int, a int")
    want = min(range(16), key=lambda i: sum((a - b) ** 2 for a, b in zip((128, 64, 192), T.CGA[i])))
    assert tuple(N.nearest_palette(df, T.CGA).first())[:3] == T.CGA[want]
    lab = df.select(*[e.alias(k) for k, e in C.lab("r", "g", "b").items()]).first()
    assert np.allclose(tuple(lab), C.python_lab((128, 64, 192)))


def test_first_candidate_wins_ties(spark):
    df = spark.createDataFrame([(10, 10, 10, 255)], "r int, g int, b int, a int")
    pal = [(20, 10, 10), (0, 10, 10), (10, 20, 10)]
    for algo in ("RGB", "RGB_APPROX"):
        assert N.nearest_palette(df, pal[:1] * 3, algorithm=algo).first()["r"] == 20
    assert N.with_nearest(df, pal, "i").first()["i"] == 0


def test_long_palettes_use_every_colour(spark):
    pal = [(i, 255 - i, (i * 7) % 256) for i in range(200)]
    px = spark.createDataFrame(noise(6, 6), PX)
    got = {tuple(r) for r in N.with_nearest(px, pal, "i").select("r", "g", "b", "i").collect()}
    for r, g, b, i in got:
        assert i == min(range(200), key=lambda k: ((r - pal[k][0]) ** 2 + (g - pal[k][1]) ** 2 + (b - pal[k][2]) ** 2, k))


def test_oversized_palette_is_refused(spark):
    big = spark.range(257).select(F.col("id").cast("int").alias("idx"), *[F.lit(0).alias(c) for c in "rgb"])
    with pytest.raises(ValueError):
        N.palette_rows(big)


# ---- ordered helpers against brute force -------------------------------------------------

@pytest.fixture(scope="module")
def series():
    """One key holds most rows; gaps and equal timestamps included."""
    rnd = random.Random(5)
    out = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 6), rnd.randrange(2000), i, rnd.randrange(9)) for i in range(600)]
    return sorted(out)


def bucketed(spark, series, width=37):
    return spark.createDataFrame(series, "k int, t int, id int, v int").withColumn("b", F.floor(F.col("t") / width))


def by_key(series):
    out = {}
    for r in sorted(series, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_bucketed_rank_and_sum(spark, series):
    d = O.bucketed_rank(bucketed(spark, series), ["k"], "b", ["t", "id"], "pos")
    d = O.bucketed_running_sum(d, ["k"], "b", ["t", "id"], F.col("v"), "run")
    want = {}
    for k, rs in by_key(series).items():
        total = 0
        for i, r in enumerate(rs):
            total += r[3]
            want[r[2]] = (i, total)
    assert {r.id: (r.pos, r.run) for r in d.collect()} == want


@pytest.mark.parametrize("forward", [False, True])
def test_bucketed_neighbour(spark, series, forward):
    d = O.bucketed_neighbour(bucketed(spark, series), ["k"], "b", ["t", "id"], ["id"], forward=forward, prefix="n_")
    want = {}
    for rs in by_key(series).values():
        ids = [r[2] for r in rs]
        for i, me in enumerate(ids):
            j = i + 1 if forward else i - 1
            want[me] = ids[j] if 0 <= j < len(ids) else None
    assert {r.id: r.n_id for r in d.collect()} == want


def test_asof_join(spark, series):
    ticks = [(k, t) for k in range(7) for t in range(-50, 2100, 61)]
    right = spark.createDataFrame(series, "k int, t int, id int, v int")
    got = O.asof_join(spark.createDataFrame(ticks, "k int, tick int"), right, ["k"], left_ts="tick", right_ts="t",
                      payload=["id"], width=37, tie=["id"])
    want, groups = {}, by_key(series)
    for k, tick in ticks:
        if k in groups:
            hit = [r for r in groups[k] if r[1] <= tick]
            want[k, tick] = (hit[-1] if hit else groups[k][0])[2]
    assert {(r.k, r.tick): r.id for r in got.collect()} == want


# ---- temporal ----------------------------------------------------------------------------

def clip(spark, n, seed=3):
    rnd = random.Random(seed)
    vals = [[rnd.randrange(256) for _ in range(3)] for _ in range(n)]
    return vals, spark.createDataFrame([(0, f, 0, 0, *v, 255) for f, v in enumerate(vals)], PX)


def test_ema_of_a_long_clip(spark):
    vals, df = clip(spark, 1500)
    got = {r.frame: r.ema_r for r in TP.with_ema(df, chunk=64).collect()}
    e = None
    for f, v in enumerate(vals):
        assert got[f] is None if e is None else abs(got[f] - e) < 1e-9
        e = v[0] if e is None else 0.9 * e + 0.1 * v[0]


def test_decayed_max_with_unequal_rates(spark):
    vals, df = clip(spark, 900)
    got = {r.frame: (r.r, r.g, r.b) for r in TP.phosphor_decay(df, redDecay=0.3, greenDecay=0.01, blueDecay=0.2, chunk=64).collect()}
    y = [0.0] * 3
    for f, v in enumerate(vals):
        y = [max(x, p * (1 - k)) for x, p, k in zip(v, y, (0.3, 0.01, 0.2))]
        assert got[f] == tuple(math.floor(p + 0.5 + 1e-9) for p in y)


@pytest.mark.parametrize("op", [
    lambda d, c: TP.time_median(d, windowSize=5, chunk=c), lambda d, c: TP.previous(d, chunk=c),
    lambda d, c: A.most_common_recent(d, window=4, chunk=c),
    lambda d, c: TP.chronophotography(d, exposures=3, interval=2, chunk=c),
    lambda d, c: TP.long_exposure(d, mode="SHUTTER", windowSize=6, chunk=c)])
def test_chunk_size_does_not_matter(spark, op):
    df = spark.createDataFrame(noise(2, 2, frames=41), PX)
    assert rows(op(df, 7)) == rows(op(df, 1000))


def test_dark_bright_median_is_the_upper_one(spark):
    frames = [0, 255, 0, 255]
    df = spark.createDataFrame([(0, f, 0, 0, v, v, v, 255) for f, v in enumerate(frames)], PX)
    assert [r.r for r in TP.time_median(df, windowSize=3).orderBy("frame").collect()] == [0, 255, 0, 255]


def test_stop_motion_holds(spark):
    _, df = clip(spark, 10)
    shown = [r.r for r in TP.stop_motion(df, holdFrames=4).orderBy("frame").collect()]
    assert len(set(shown[:4])) == 1 and len(set(shown[4:8])) == 1


def test_flip_dots_respect_the_cap(spark):
    df = spark.createDataFrame([(0, f, x, y, *(3 * [0 if f % 2 else 255]), 255) for f in range(8) for x in range(8) for y in range(8)], PX)
    out = M.flip_dots(df, width=8, height=8, cellSize=2, maxFlipRate=0.25, responseFrames=1)
    assert max(r.flips for r in out.collect()) == 4 and out.count() == 8 * 16


# ---- space --------------------------------------------------------------------------------

SIZE = {"width": 9, "height": 7}


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame(noise(9, 7), PX)
    assert rows(R.flip(R.flip(df, mode="BOTH", **SIZE), mode="BOTH", **SIZE)) == rows(df)


def test_convolution_matches_numpy(spark):
    df = spark.createDataFrame(noise(9, 7), PX)
    src = np.pad(image(df), 1, mode="edge")
    k = np.array(ST.KERNELS["GAUSSIAN_3X3"])
    want = sum(k[i, j] * src[i:i + 7, j:j + 9] for i in range(3) for j in range(3))
    got = image(ST.convolve(df, **SIZE))
    assert np.abs(got - np.floor(want + 0.5 + 1e-9)).max() == 0


def test_stencil_counts_every_tap(spark):
    df = spark.createDataFrame(noise(9, 7), PX)
    out = ST.stencil(df, ST.square(2), [F.count("*").alias("n")], **SIZE)
    assert {r.n for r in out.collect()} == {25} and out.count() == 63


@pytest.mark.parametrize("size", [(8, 8), (6, 5), (1, 3), (256, 256)])
def test_transform_equals_numpy_and_comes_back(spark, size):
    w, h = size
    df = spark.createDataFrame(noise(w, h, frames=2 if w < 9 else 1), PX)
    plane = SP.luma_plane(df).cache()
    spec = SP.forward(plane, width=w, height=h).cache()
    want = {}
    for r in plane.collect():
        want.setdefault(r.frame, np.zeros((SP.padded(h), SP.padded(w))))[r.y, r.x] = r.v
    want = {f: np.fft.fft2(v) for f, v in want.items()}
    got = spec.collect()
    assert len(got) == sum(v.size for v in want.values())
    assert all(abs(want[r.frame][r.ky, r.kx] - complex(r.re, r.im)) < 1e-7 for r in got)
    back = {(r.frame, r.x, r.y): r.re for r in SP.inverse(spec, width=w, height=h).collect()}
    assert all(abs(back[r.frame, r.x, r.y] - r.v) < 1e-9 for r in plane.collect()) and len(back) == plane.count()


def test_transform_of_a_line_with_holes(spark):
    df = spark.createDataFrame([(1, 0, 3, 0, 2.0), (1, 0, 6, 1, -1.0)], "clip_id int, frame int, x int, y int, v double")
    g = np.zeros((2, 8))
    g[0, 3], g[1, 6] = 2.0, -1.0
    want = np.fft.fft2(g)
    assert all(abs(want[r.ky, r.kx] - complex(r.re, r.im)) < 1e-9 for r in SP.forward(df, width=8, height=2).collect())


def test_moved_block_is_found(spark):
    def frame(f, ox, oy):
        return [(0, f, x, y, *(3 * [255 if ox <= x < ox + 4 and oy <= y < oy + 4 else (x * 7 + y * 13) % 50]), 255)
                for y in range(16) for x in range(16)]
    df = spark.createDataFrame(frame(0, 4, 4) + frame(1, 6, 5), PX)
    v = M.motion_vectors(df, width=16, height=16, mode="rgb", cellSize=8, searchRadius=3).where("bx = 0 and by = 0").first()
    assert (v.dx, v.dy) == (-2, -1)


def test_equal_histogram_sum_and_palette_subset(spark):
    df = spark.createDataFrame(noise(9, 7, frames=3), PX)
    hist = A.histogram(df, ["frame"], A.luma_bin())
    assert hist.agg(F.sum("n")).first()[0] == df.count()
    pal = A.octree_palette(df, levels=6).collect()
    assert 0 < len(pal) <= 6
    colours = [(r.r, r.g, r.b) for r in pal]
    assert {tuple(r)[4:7] for r in N.nearest_palette(df, colours).collect()} <= set(colours)


# ---- frame timing -------------------------------------------------------------------------

def test_median_and_cadence(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (1, 31), (1, 40), (2, 7), (2, 7), (2, 9)], "clip_id int, v int")
    assert {r.clip_id: r.median for r in TL.value_median(df, ["clip_id"], "v").collect()} == {1: 26, 2: 7}


def test_thinning_keeps_the_last_frame(spark):
    fr = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 10, 30, 70, 75))], "clip_id int, event_id int, ts_us int")
    gap = spark.createDataFrame([(1, 30)], "clip_id int, min_us int")
    assert [r.ts_us for r in FD.cadence_thinning(fr, gap).orderBy("ts_us").collect()] == [0, 30, 70, 75]


def test_sessions_agree_with_the_built_in_window(spark, series):
    df = spark.createDataFrame([(k, t * 1_000_000, i) for k, t, i, _ in series], "k int, ts_us long, event_id int")
    mine = TL.idle_sessions(df, ["k"], 9_000_000, [F.count("*").alias("n")], width=37_000_000)
    ref = df.groupBy("k", F.session_window(F.timestamp_micros("ts_us"), "9 seconds").alias("w")).agg(F.count("*").alias("n"))
    ref = ref.select("k", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    assert rows(mine, "k", "start_us", "end_us", "n") == rows(ref)


# ---- recurrences by chunks -----------------------------------------------------------------

@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(noise(2, 2, frames=90, clips=2, seed=5), PX).cache()


def per_pixel(df):
    out = {}
    for r in df.orderBy("frame").collect():
        out.setdefault((r.clip_id, r.x, r.y), []).append(r)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_bounded_decays_do_not_depend_on_chunks(spark, clips, chunk):
    src = per_pixel(clips)
    for key, got in per_pixel(FD.additive_exposure(clips, decay=0.05, brightnessThreshold=100, chunk=chunk)).items():
        y = None
        for r, g in zip(src[key], got):
            y = float(r.r) if y is None else min(255.0, y * 0.95 + r.r * (0.3 if (r.r + r.g + r.b) / 3 >= 100 else 0.0))
            assert g.r == math.floor(y + 0.5 + 1e-9)
    for key, got in per_pixel(TP.motion_analysis(clips, source="PREVIOUS", renderMode="ACCUMULATED_HEAT", accumRate=2.0, coolRate=0.3, chunk=chunk)).items():
        heat, before = 0.0, None
        for r, g in zip(src[key], got):
            diff = 0.0 if before is None else (abs(r.r - before.r) + abs(r.g - before.g) + abs(r.b - before.b)) / 3
            heat, before = min(1.0, heat * 0.7 + diff / 255 * 2.0), r
            assert g.heat == pytest.approx(heat)


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_ranges_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(2)
    values = [(k, i, rng.uniform(-3, 3) if i % 17 else 40.0 * k) for k in (1, 2) for i in range(200)]
    df = spark.createDataFrame(values, "k int, t long, v double")
    got = {(r.k, r.t): (r.low, r.high, r.normalized) for r in FD.adaptive_range(df, ["k"], ["t"], "v", release=0.1, width=50, chunk=chunk).collect()}
    state = {}
    for k, t, v in values:
        lo, hi = state.get(k, (v, v))
        lo, hi = (v if v < lo else lo + (v - lo) * 0.1), (v if v > hi else hi + (v - hi) * 0.1)
        state[k], span = (lo, hi), max(0.08, hi - lo)
        assert got[k, t] == pytest.approx((lo, hi, min(1.0, max(0.0, (v - (hi - span)) / span))))


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_tiles_refresh_the_same_in_any_chunks(spark, clips, chunk):
    src = {(r.clip_id, r.frame, r.x, r.y): r for r in clips.collect()}
    got = {(r.clip_id, r.frame, r.x, r.y): r for r in FD.tile_stabiliser(clips, tileSize=2, motionThreshold=95.0, holdFrames=3, chunk=chunk).collect()}
    for c in (0, 1):
        shown = age = 0
        for f in range(90):
            cells = [(x, y) for x in (0, 1) for y in (0, 1)]
            moved = f == 0 or sum(abs(src[c, f, x, y][ch] - src[c, f - 1, x, y][ch]) for x, y in cells for ch in (4, 5, 6)) / 12 > 95.0
            shown, age = (f, 0) if moved or age >= 3 else (shown, age + 1)
            assert all(got[c, f, x, y].r == src[c, shown, x, y].r for x, y in cells)


@pytest.mark.parametrize("chunk, warm_rounds", [(1, None), (7, None), (1024, 1)])
def test_held_bands_and_thinning_are_repaired(spark, clips, chunk, warm_rounds):
    rounds = []
    held = per_pixel(FD.poster_hold(clips, levels=4, holdThreshold=30.0, releaseSpeed=0.6, chunk=chunk, rounds=rounds))
    whole = per_pixel(FD.poster_hold(clips, levels=4, holdThreshold=30.0, releaseSpeed=0.6, chunk=10_000))
    assert held == whole and rounds[-1] == 0 and len(rounds) <= 90 and (warm_rounds is None or len(rounds) == warm_rounds)
    rng = random.Random(9)
    frames = [(k, i, sum(rng.randrange(1, 40) for _ in range(1)) + 25 * i) for k in (1, 2) for i in range(150)]
    gaps = spark.createDataFrame([(1, 60), (2, 95)], "clip_id int, min_us long")
    kept = {(r.clip_id, r.event_id) for r in FD.cadence_thinning(
        spark.createDataFrame(frames, "clip_id int, event_id long, ts_us long"), gaps, chunk=chunk).collect()}
    want = set()
    for k, gap in ((1, 60), (2, 95)):
        mine, last = sorted((f for f in frames if f[0] == k), key=lambda f: f[::-1]), None
        for _, i, ts in mine:
            if last is None or ts - last >= gap:
                last = ts
                want.add((k, i))
        want.add((k, mine[-1][1]))
    assert kept == want


def test_speculation_runs_wrong_chunks_again(spark):
    """A sum never forgets how it began, so every guess is wrong and each round settles one chunk more."""
    df = spark.createDataFrame([(1, i, float(i % 5)) for i in range(40)], "k int, pos long, v double")
    rounds = []
    from rasterloom.operators import scans
    out = scans.fold_chunks(df, ["k"], "pos", ["v"], {"s": "double"}, lambda s, v: ((v if s is None else s[0] + v,),) * 2, chunk=8, warm=2, rounds=rounds)
    assert [r.s for r in out.orderBy("pos").collect()] == np.cumsum([i % 5 for i in range(40)]).tolist()
    assert rounds[-1] == 0 and len(rounds) == 5


@pytest.mark.parametrize("chunk, warm", [(1024, 256), (40, 100), (40, 30)])
def test_tempo_is_followed_in_chunks(spark, chunk, warm):
    rng = random.Random(4)
    rows_ = [(0, w, rng.choice((61.0, 90.0, 119.5, 170.0)) + rng.random(), rng.random()) for w in range(0, 300, 2)]
    out = S.smooth_tempo(spark.createDataFrame(rows_, "channel int, window long, bpm double, confidence double"), chunk=chunk, warm=warm)
    got, tempo, trust = {r.window: r for r in out.collect()}, None, None
    for _, w, bpm, sure in rows_:
        if tempo is None:
            tempo, trust = bpm, max(0.1, sure)
        else:
            pull = 0.2 + sure * 0.45
            near = min((bpm, bpm / 2 if 60 <= bpm / 2 <= 180 else bpm, bpm * 2 if 60 <= bpm * 2 <= 180 else bpm), key=lambda v: abs(v - tempo))
            tempo, trust = tempo * (1 - pull) + near * pull, trust * 0.7 + sure * 0.3
        assert (got[w].tempo, got[w].tempo_confidence) == pytest.approx((tempo, trust))


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_scan_composes_all_parts_before(spark, fan):
    from rasterloom.operators import scans
    df = spark.createDataFrame([(k, i * 3, f"{i},") for k in "ab" for i in range(25 if k == "a" else 1)], "k string, i long, m string")
    got = {(r.k, r.i): r.before for r in scans.scan(df, ["k"], "i", F.concat, fan=fan).collect()}
    assert got == {(k, i * 3): "".join(f"{j}," for j in range(i)) or None for k in "ab" for i in range(25 if k == "a" else 1)}


# ---- signal --------------------------------------------------------------------------------

def test_tempo_of_a_pulse_train(spark):
    series = [(0, i, 1.0 if i % 25 == 0 else 0.0) for i in range(400)]   # 25 hops of 20 ms: 120 bpm
    best = S.dominant_period(spark.createDataFrame(series, "channel int, hop long, novelty double"), hop_ms=20.0).first()
    assert abs(best.bpm - 120) < 1e-6 and best.confidence > 0.3


def test_a_year_without_samples_is_one_row(spark):
    year = 365 * 24 * 36_000   # hops of 100 ms
    times = [0, 1, 2, 5, year, year + 1, year + 3]
    samples = spark.createDataFrame([(i, 100_000 * t + i, 0, i % 3, 150.0) for i, t in enumerate(times)], "event_id long, ts_us long, channel int, bin int, sample double")
    series = S.series(S.slots(samples, 100_000, mid=50, scale=100), full_scale=1.0)
    assert rows(series, "hop", "run") == [(0, 1), (1, 1), (2, 1), (3, 2), (5, 1), (6, year - 6), (year, 1), (year + 1, 1), (year + 2, 1), (year + 3, 1)]
    got = {r.hop: r for r in S.envelopes(S.onsets(S.with_flux(S.with_bands(series)))).collect()}
    assert got[year].bass_envelope == pytest.approx(0.2 * got[year].bass) and got[5].peak_decay > got[6].peak_decay > 0.9 * got[5].peak_decay
    assert got[year].flux == pytest.approx(4 / 3) or got[year].flux == 1.0
    bpm = S.dominant_period(S.onsets(S.flux(series)), hop_ms=100.0).collect()
    assert len(bpm) <= 1


@pytest.mark.parametrize("gaps", [False, True])
def test_a_series_with_stretches_gives_what_dense_hops_give(spark, gaps):
    rng = random.Random(3)
    times = [t for t in range(300) if not gaps or t < 40 or 100 < t < 130 or t > 260]
    samples = [(i, 1000 * t + i % 900, i % 2, rng.randrange(4), rng.uniform(0, 100)) for i, t in enumerate(rng.choice(times) for _ in range(700))]
    df = spark.createDataFrame(samples, "event_id long, ts_us long, channel int, bin int, sample double")
    series = S.series(S.slots(df, 1000, mid=50, scale=100), full_scale=3.0)
    got = {(r.channel, r.hop): r for r in S.of_decays(S.onsets(S.flux(series))).collect()}
    tempo = {r.channel: r for r in S.dominant_period(S.onsets(S.flux(series)), hop_ms=100.0).collect()}
    for c in (0, 1):
        mine = [s for s in samples if s[2] == c]
        hops = range(min(s[1] for s in mine) // 1000, max(s[1] for s in mine) // 1000 + 1)
        mag = {h: [min(1.0, sum(s[1] // 1000 == h and s[3] == b for s in mine) / 3.0) for b in range(4)] for h in hops}
        ema, novelty = 0.0, []
        for h in hops:
            flux = min(1.0, sum(max(0.0, x - p) for x, p in zip(mag[h], mag.get(h - 1, mag[h]))) / 4 * 4.0)
            ema = 0.9 * ema + 0.1 * flux
            novelty.append(max(0.0, flux - ema))
            assert (got[c, h].flux, got[c, h].onset_ema, got[c, h].novelty) == pytest.approx((flux, ema, novelty[-1]))
        mean, n = sum(novelty) / len(novelty), len(novelty)
        score = {lag: sum((novelty[i] - mean) * (novelty[i + lag] - mean) for i in range(n - lag)) / (n - lag)
                 * max(0.35, 1 - abs(120 - 600 / lag) / 600) for lag in range(3, 11)}
        best = max(score, key=score.get)
        if score[best] > 0:
            assert tempo[c].bpm == pytest.approx(600 / best)


def test_signal_queries_scan_the_events_once_for_samples_and_once_for_types(spark):
    from rasterloom.suite import load
    names = "spectrum_smoothing zero_cross_rate stereo_width_balance envelopes_and_decays tempo_tracker beat_detection tap_downbeat_bpm_override".split()
    from rasterloom.operators import lineage
    seen, cut = [], lineage.cut_lineage

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("events.parquet") or str(df._jdf.queryExecution().optimizedPlan()).count("Relation [")

    def counting(df):
        seen.append(scans(df))
        return cut(df)
    import sys
    users = [m for m in list(sys.modules.values()) if getattr(m, "cut_lineage", None) is cut]
    try:
        for m in users:
            m.cut_lineage = counting
        for name in names:
            seen.clear()
            left = scans(load()[0][name](spark, "/root/testdata/sf0.001"))
            assert 1 <= sum(seen) + left <= 2, (name, seen, left)
    finally:
        for m in users:
            m.cut_lineage = cut


def walked_beats(rows, hop_ms=100.0):
    """The rules one hop after the other."""
    out, last, mean, sure, pulse, hold = {}, None, None, 0.0, 0.0, 0.0
    for hop, fires in rows:
        since = float("inf") if last is None else (hop - last) * hop_ms
        hit = fires and since >= S.MIN_BEAT
        if hit:
            if since < S.MAX_BEAT:
                mean = since if mean is None else mean * 0.8 + since * 0.2
                sure = min(1.0, max(0.0, 1 - abs(since - mean) / max(180.0, mean)))
            last, pulse, hold = hop, 1.0, 1.0
        else:
            pulse, hold, sure = pulse * 0.72, hold * 0.9, sure * 0.992
            if since > S.IDLE and last is not None:
                last, pulse, hold, sure = None, 0.0, 0.0, sure * 0.5
        out[hop] = (hit, pulse, hold, sure, mean)
    return out


@pytest.mark.parametrize("chunk", [7, 1024])
def test_beats_equal_the_rules_walked_hop_by_hop(spark, chunk):
    rng = np.random.default_rng(4)
    series = [(h, bool(rng.random() < 0.3 if h < 1500 else h < 1700 and h % 7 == 0)) for h in range(100, 1900)]
    df = spark.createDataFrame([(0, *r) for r in series], "channel int, hop long, trigger boolean")
    want = walked_beats(series)
    got = S.detect_beats(df, hop_ms=100.0, chunk=chunk).collect()
    assert len(got) == len(want)
    for r in got:
        hit, *values = want[r.hop]
        assert r.beat == hit and [r.pulse, r.hold, r.confidence, r.interval_ms or 0.0] == pytest.approx([*values[:3], values[3] or 0.0])


def test_beat_override_is_regular(spark):
    hops = spark.createDataFrame([(0, h) for h in range(40, 140)], "channel int, hop long")
    out = S.grid_beats(hops, 120.0, hop_ms=100.0).orderBy("hop").collect()
    assert [r.hop - 40 for r in out if r.beat][:4] == [0, 5, 10, 15] and out[2].pulse == pytest.approx(0.72 ** 2)


# ---- chains and sources --------------------------------------------------------------------

def test_chain_validates_before_running(spark):
    df = spark.createDataFrame(noise(3, 3), PX)
    with pytest.raises(KeyError):
        CH.apply_chain(df, ["no_such_step"])
    with pytest.raises(ValueError):
        CH.apply_chain(df, [("posterize", {"levels": 99})])
    with pytest.raises(ValueError):
        CH.apply_chain(df, ["gaussian_blur"])
    with pytest.raises(ValueError):
        CH.apply_chain(df, ["none"] * 17)
    assert rows(CH.apply_chain(df, [CH.Step("invert", {}, enabled=False), "none"])) == rows(df)


@pytest.mark.parametrize("name", sorted(n for n in CH.REGISTRY if n != "swap_channels"))
def test_every_operator_runs_on_a_solid_frame(spark, name):
    df = spark.createDataFrame([(0, f, x, y, 128, 64, 32, 255) for f in range(2) for x in range(4) for y in range(4)], PX)
    params = {"palette": T.CGA} if name == "quantize" else {"iterations": 1} if name == "anisotropic_diffusion" else {}
    out = CH.apply_chain(df, [(name, params)], width=4, height=4).collect()
    assert len(out) == 32 and all(0 <= r[c] <= 255 for r in out for c in "rgb")


def test_images_from_files(spark, tmp_path):
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n4 2\n255\n" + px.tobytes())
    out = MD.rows_to_pixels(MD.scan_images(spark, str(tmp_path)))
    assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in out.collect()} == {
        (x, y): (*map(int, px[y, x]), 255) for x in range(4) for y in range(2)}


def test_share_strings(spark):
    good = MD.PREFIX + __import__("base64").urlsafe_b64encode(zlib.compress(b'{"v":2}')).decode().rstrip("=")
    df = spark.createDataFrame([(good,), ("x.abc",), (MD.PREFIX + "!!",), (None,)], "s string")
    assert [r[0] for r in df.select(MD.decode_share(F.col("s"))).collect()] == ['{"v":2}', None, None, None]


def test_curve_points_keep_bad_input_out():
    from rasterloom.operators.pixel import tone_curve
    line = list(range(256))
    assert tone_curve("nonsense") == line == tone_curve("[[3,4]]") == tone_curve("[[0,0],[255,255]]") == tone_curve('{"a":1}')
    bent = tone_curve("[[0.5,1],[0,0]]")
    assert (bent[0], bent[64], bent[128], bent[200]) == (0, 128, 255, 255)
    assert tone_curve("[[0,10],[100,50],[100,200],[255,255]]")[99:102] == [50, 50, 200]


def test_chains_of_any_length_move_without_loss(spark):
    from rasterloom.operators import catalog as K
    names = [f"s{i}" for i in range(40)]
    row = spark.createDataFrame([(names,)], "steps array<string>").select(
        K.chain_move(F.col("steps"), 30, 2).alias("m"), K.chain_move(F.col("steps"), 0, 39).alias("e")).first()
    assert row.m == [*names[:2], "s30", *(n for n in names[2:] if n != "s30")] and row.e == [*names[1:], "s0"]


@pytest.mark.parametrize("threshold", [0.3, 0.45, 0.7, 0.85])
def test_similar_pairs_at_any_threshold(spark, threshold):
    from rasterloom.operators import catalog as K
    rng = np.random.default_rng(8)
    chains = [(i, "ab"[int(rng.integers(2))], [f"s{int(v)}" for v in rng.integers(0, 12, int(rng.integers(1, 9)))]) for i in range(120)]
    got = {(r.a, r.b): r.score for r in K.similar_pairs(
        spark.createDataFrame(chains, "chain_id int, category string, steps array<string>"), threshold=threshold).collect()}
    one = {}
    for i, c, s in chains:
        one.setdefault((c, tuple(s)), i)
    want = {}
    entries = sorted((i, c, s) for (c, s), i in one.items())
    for n, (j, cj, y) in enumerate(entries):
        for i, ci, x in entries[:n]:
            jac = len({*x} & {*y}) / len({*x} | {*y})
            score = 0.5 * jac + 0.25 * sum(p == q for p, q in zip(x, y)) / max(len(x), len(y)) + 0.15 * (x[0] == y[0]) + 0.1 * (ci == cj)
            if round(score, 9) >= threshold:
                want[i, j] = round(score, 9)
    assert got == pytest.approx(want)


def test_long_ids_pass_the_large_transform(spark):
    from rasterloom.operators import spectral as SP
    df = spark.createDataFrame([(1 << 40, 0, x, y, float(x == y)) for x in range(65) for y in range(3)], "clip_id long, frame int, x int, y int, v double")
    out = SP.forward(df, width=65, height=65)
    assert out.where("kx = 0 and ky = 0").first().re == pytest.approx(3.0) and out.first().clip_id == 1 << 40


def test_a_sixth_event_type_is_in_every_spectrum_metric(spark, tmp_path):
    from rasterloom.sources import views as V
    kinds = ["add_to_cart", "click", "error", "purchase", "signup", "view"]
    seen = [(0, 0, "view"), (0, 0, "view"), (0, 1, "add_to_cart"), (0, 2, "signup"), (0, 2, "view"), (1, 1, "view"), (1, 1, "click"), (1, 1, "error"), (1, 1, "purchase")]
    spark.createDataFrame([(i, 3_600_000_000 * h + i, u, k, 10.0) for i, (u, h, k) in enumerate(seen)], "event_id long, us long, user_id long, event_type string, value double").select(
        "event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    series = S.series(S.slots(V.signal(spark, str(tmp_path)), 3_600_000_000, mid=50, scale=100), full_scale=4.0)
    spec = S.spectrum(series)
    mag = {(c, h, b): sum((u, g, k) == (c, h, kinds[b]) for u, g, k in seen) / 4 for c, h in [(0, 0), (0, 1), (0, 2), (1, 1)] for b in range(6)}
    assert {(r.channel, r.hop, r.bin): r.mag for r in spec.collect()} == mag
    got = {}
    for df in (S.band_averages(series), S.spectral_centroid(series), S.flux(series)):
        for r in df.collect():
            got.setdefault((r.channel, r.hop), {}).update(r.asDict())
    for (c, h), row in got.items():
        m = [mag[c, h, b] for b in range(6)]
        rise = sum(max(0.0, x - mag.get((c, h - 1, b), x)) for b, x in enumerate(m))
        assert [row[k] for k in ("sub", "bass", "mid", "treble", "centroid", "flux")] == pytest.approx(
            [m[0], sum(m[:2]) / 2, sum(m[:3]) / 3, sum(m[2:]) / 4, sum(b * x for b, x in enumerate(m)) / sum(m) / 5, min(1.0, rise / 6 * 4)])


def test_samples_without_an_event_type_stay_in_the_signal(spark, tmp_path):
    from rasterloom.sources import views as V
    spark.createDataFrame([(1, 0, "view"), (2, 0, None), (3, 1, "click"), (4, 1, None)], "event_id long, user_id long, event_type string").select(
        "*", F.timestamp_micros("event_id").alias("ts"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(V.signal(spark, str(tmp_path)), "event_id", "bin") == [(1, 1), (2, 2), (3, 0), (4, 2)]


def test_bench_compare_after_a_mean_of_zero(spark):
    before = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", -0.0), ("d", 2.0), ("e", 0.0), ("f", None), ("g", 0.0)], "k string, v double")
    after = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("c", 3.0), ("d", 3.0), ("e", -3.0), ("f", 1.0)], "k string, v double")
    got = {r.k: (r.delta_pct, r.speedup, r.status) for r in A.bench_compare(before, after, ["k"]).collect()}
    inf = math.inf
    assert got.pop("b")[2] == "both" and all(math.isnan(x) for r in A.bench_compare(before, after, ["k"]).where("k = 'b'").collect() for x in (r.delta_pct, r.speedup))
    assert got == {"a": (inf, inf, "both"), "c": (-inf, -inf, "both"), "d": (50.0, 1.5, "both"), "e": (-inf, -inf, "both"),
                   "f": (None, None, "new"), "g": (None, None, "removed")}


def test_images_are_committed_by_runs_of_frames(spark, tmp_path):
    frames = [(c, f, [(c * 50 + f) % 256] * 4) for c in (1, 2) for f in range(40)]
    MD.write_images(spark.createDataFrame(frames, "clip_id int, frame int, q array<int>"), str(tmp_path), width=2, height=2, run=16)
    assert sorted(p.name for p in tmp_path.glob("run=*")) == [f"run={c}_{k}" for c in (1, 2) for k in range(3)]
    assert len(list(tmp_path.glob("run=*/clip_id=*/frame=*/*.txt"))) == len(frames)
    got = {tuple(map(int, p)): v for *p, v in MD.scan_images(spark, str(tmp_path), glob="*.txt").select(
        F.regexp_extract("path", r"/clip_id=(\d+)/", 1), F.regexp_extract("path", r"/frame=(\d+)/", 1), "y", F.to_json("rgba")).collect()}
    assert got == {(c, f, y): f"[{q[0]},{q[0]},{q[0]},255,{q[0]},{q[0]},{q[0]},255]" for c, f, q in frames for y in range(2)}


def test_pairs_with_all_steps_in_common_meet_on_more_than_three(spark, monkeypatch):
    from itertools import combinations, permutations

    from rasterloom.operators import catalog as K
    joined = []
    join = K.shuffled_join
    monkeypatch.setattr(K, "shuffled_join", lambda *a, **k: joined.append(join(*a, **k)) or joined[-1])
    chains = [(i, "c", ["s0", *s]) for i, s in enumerate(combinations([f"s{j}" for j in range(1, 15)], 4))]
    chains += [(9000 + i, "c", s) for i, s in enumerate(permutations(chains[0][2]))]
    df = spark.createDataFrame(chains, "chain_id int, category string, steps array<string>")
    got = {(r.a, r.b) for r in K.similar_pairs(df, threshold=0.85, meet=0.5).collect()}
    one = {}
    for i, _, s in chains:
        one.setdefault(tuple(s), i)
    want = {(min(i, j), max(i, j)) for (x, i), (y, j) in combinations(one.items(), 2)
            if x[0] == y[0] and round(0.75 + 0.25 * sum(p == q for p, q in zip(x, y)) / 5 - 0.5 * (1 - len({*x} & {*y}) / len({*x} | {*y})), 9) >= 0.85}
    assert got == want and len(want) > 100
    assert joined[-1].count() < 2 * len(list(combinations(range(120), 2)))   # only the permutations of one set meet
