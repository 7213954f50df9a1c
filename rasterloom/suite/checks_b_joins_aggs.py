"""Nearest-neighbour joins, histograms, palettes, cells and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import tables as T
from rasterloom.operators import aggregate as A
from rasterloom.operators import nearest as N
from rasterloom.operators import pixel as P
from rasterloom.operators import timeline as TL
from rasterloom.sources import views as V
from rasterloom.suite.checks_a_pixel import HSV, lin, nearest_sql, on_carrier, on_raster, unlin
from rasterloom.suite.registry import (CARRIER, CL, FU, J, L709, L709U, RASTER, U8, carrier_sql, check,
                                       each, raster_sql)

KEYS = "l_orderkey, l_linenumber"

# ---- flagship ---------------------------------------------------------------------------

_CUM = """select clip_id, bin, n, sum(n) over (partition by clip_id order by bin) as cdf,
 sum(n) over (partition by clip_id) as total from h"""


@check("flagship_equalised_luma", f"""with h as (select clip_id, {J(L709)} as bin, count(*) as n from {RASTER} p group by 1, 2),
 c as ({_CUM}), m as (select *, min(cdf) over (partition by clip_id) as lo from c),
 e as (select clip_id, n, case when total = lo then bin else {J('(cdf - lo) / (total - lo) * 255')} end as mapped from m)
 select clip_id, cast(sum(n) as bigint) as pixels, cast(sum(n * mapped) as bigint) as mapped_sum,
 round(sum(n * mapped) / sum(n), 6) as mean_mapped from e group by clip_id""")
def _flagship(spark, d):
    px = V.raster_px(spark, d)
    hist = A.histogram(px, ["clip_id"], A.luma_bin())
    lut = A._cdf_map(hist, ["clip_id"])
    total = F.sum(F.col("n") * F.col("mapped"))
    return hist.join(lut, ["clip_id", "bin"]).groupBy("clip_id").agg(
        F.sum("n").alias("pixels"), total.alias("mapped_sum"),
        F.round(total / F.sum("n"), 6).alias("mean_mapped"))


# ---- nearest ----------------------------------------------------------------------------

on_carrier("quantize_no_dithering", N.nearest_palette, nearest_sql(T.CGA, CARRIER, keys=KEYS), palette=T.CGA)
_APPROX = """(2 + (r + p.r) / 2.0 / 256) * (r - p.r) * (r - p.r) + 4 * (g - p.g) * (g - p.g)
 + (2 + (255 - (r + p.r) / 2.0) / 256) * (b - p.b) * (b - p.b)"""
on_carrier("quantize_weighted_rgb", N.nearest_palette, nearest_sql(T.PICO8, CARRIER, keys=KEYS, dist=_APPROX),
           palette=T.PICO8, algorithm="RGB_APPROX")


def feature_nearest(pal, feats, inner, dist):
    """Argmin over constant feature triples of each palette colour."""
    cands = ", ".join(f"{{'d': {dist.format(*f)}, 'i': {i}}}" for i, f in enumerate(feats))
    picks = ", ".join("[" + ", ".join(str(c[k]) for c in pal) + f"][best.i + 1] as {n}" for k, n in enumerate("rgb"))
    return f"select {KEYS}, {picks}, a from (select *, list_min([{cands}]) as best from {inner} n0) n1"


_DH = "(least(abs(h - {0!r}), 360 - abs(h - {0!r})) / 180.0)"
on_carrier("quantize_hsv", N.nearest_palette, feature_nearest(
    T.PICO8, [C.python_hsv(c) for c in T.PICO8], HSV,
    f"{_DH} * {_DH} + (s - {{1!r}}) * (s - {{1!r}}) + (v - {{2!r}}) * (v - {{2!r}})"),
    palette=T.PICO8, algorithm="HSV")


def xyz(t):
    return f"(case when {t} > 0.008856 then pow({t}, 1 / 3.0) else {t} * 7.787 + 16 / 116.0 end)"


LAB = f"""(select *, 116 * fy - 16 as ll, 500 * (fx - fy) as la, 200 * (fy - fz) as lb from
 (select *, {xyz('((lr * 100 * 0.4124 + lg * 100 * 0.3576 + lbl * 100 * 0.1805) / 95.047)')} as fx,
  {xyz('((lr * 100 * 0.2126 + lg * 100 * 0.7152 + lbl * 100 * 0.0722) / 100.0)')} as fy,
  {xyz('((lr * 100 * 0.0193 + lg * 100 * 0.1192 + lbl * 100 * 0.9505) / 108.883)')} as fz from
  (select *, {lin('r')} as lr, {lin('g')} as lg, {lin('b')} as lbl from {CARRIER} l0) l1) l2)"""
on_carrier("user_palette_nearest_match", N.nearest_palette, feature_nearest(
    T.CGA, [C.python_lab(c) for c in T.CGA], LAB,
    "(ll - {0!r}) * (ll - {0!r}) + (la - {1!r}) * (la - {1!r}) + (lb - {2!r}) * (lb - {2!r})"),
    palette=T.CGA, algorithm="LAB")


@check("nearest_centroid_vectors", """with c as (select label, pos, avg(cast(e as double)) as m from
  (select label, unnest(embedding) as e, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2),
 v as (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) as pos from embeddings),
 d as (select vec_id, c.label, sum((cast(e as double) - m) * (cast(e as double) - m)) as dist from v join c using (pos) group by 1, 2)
 select vec_id, cast(arg_min(label, dist) as int) as centroid from d group by vec_id""")
def _nearest_centroid(spark, d):
    emb = V.table(spark, d, "embeddings")
    long = emb.select("label", F.posexplode("embedding").alias("pos", "e"))
    cents = (long.groupBy("label", "pos").agg(F.avg(F.col("e").cast("double")).alias("m"))
             .groupBy(F.col("label").alias("idx")).agg(
                 F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding")))
    return N.nearest_centroid(emb.select("vec_id", "embedding"), cents).select("vec_id", "centroid")


_DRIFT = [(k + 3) % 16 for k in range(16)]
_inner = nearest_sql(T.PICO8, CARRIER, keys=KEYS + ", r as r0, g as g0, b as b0").replace(
    "[best.i + 1]", "[(best.i + 3) % 16 + 1]")
_kk = "((0.2126 * r0 + 0.7152 * g0 + 0.0722 * b0) / greatest(1.0, 0.2126 * r + 0.7152 * g + 0.0722 * b))"
on_carrier("palette_index_drift", N.palette_index_drift, carrier_sql(*each(U8(f"{{c}} * {_kk}")), pre=f"({_inner})"),
           palette=T.PICO8, drift=_DRIFT)

_SEEDS = [((k * 37 % 80) / 10.0 + 0.031 * k, (k * 53 % 80) / 10.0 + 0.017 * k) for k in range(24)]
_VD = ", ".join(f"{{'d': ({sx!r} - x) * ({sx!r} - x) + ({sy!r} - y) * ({sy!r} - y), 'i': {i}}}" for i, (sx, sy) in enumerate(_SEEDS))


@check("voronoi", f"""with s as (select *, list_min([{_VD}]).i as seed from {RASTER} p),
 m as (select clip_id, frame, seed, {J('avg(r)')} as r, {J('avg(g)')} as g, {J('avg(b)')} as b, {J('avg(a)')} as a from s group by 1, 2, 3)
 select s.clip_id, s.frame, s.x, s.y, cast(seed as int) as seed, m.r, m.g, m.b, m.a from s join m using (clip_id, frame, seed)""")
def _voronoi(spark, d):
    return N.voronoi(V.raster_px(spark, d), _SEEDS, width=8, height=8)


@check("theme_match", """with mine as (select clip_id, [0, 0, 0, 85, 85, 85] as c from (select distinct user_id as clip_id from events) where clip_id % 3 = 0
 union all select clip_id, [155, 188, 15, 139, 172, 15, 48, 98, 48, 15, 56, 15] from (select distinct user_id as clip_id from events) where clip_id % 3 = 1
 union all select clip_id, [22, 18, 16, 236, 218, 176] from (select distinct user_id as clip_id from events) where clip_id % 3 = 2)
 select clip_id, case when clip_id % 3 = 1 then 'GAMEBOY' else 'CREAM' end as theme from mine where clip_id % 3 <> 0""")
def _theme_match(spark, d):
    users = V.table(spark, d, "events").select(F.col("user_id").alias("clip_id")).distinct()
    lists = [[[0, 0, 0], [85, 85, 85]], [list(c) for c in T.GAMEBOY], [list(c) for c in T.CREAM]]
    colours = F.element_at(F.array(*[F.array(*[F.array(*[F.lit(v) for v in c]) for c in p]) for p in lists]),
                           F.pmod("clip_id", F.lit(3)).cast("int") + 1)
    themes = spark.createDataFrame([(k, [list(c) for c in v]) for k, v in T.THEMES.items()],
                                   "theme string, colors array<array<int>>")
    return TL.match_themes(users.withColumn("colors", colours), themes).select("clip_id", "theme")


# ---- counts and histograms --------------------------------------------------------------

@check("unique_colours_counts", f"select r, g, b, a, count(*) as n from {CARRIER} p group by all")
def _unique(spark, d):
    return A.unique_colours(V.channel_carrier(spark, d))


@check("rarest_colour_limit", f"select r, g, b, a, count(*) as n from {CARRIER} p group by all order by n, r, g, b, a limit 50")
def _rarest(spark, d):
    return A.unique_colours(V.channel_carrier(spark, d), limit=50)


@check("commonest_colour_limit", f"select r, g, b, a, count(*) as n from {CARRIER} p group by all order by n desc, r, g, b, a limit 50")
def _commonest(spark, d):
    return A.unique_colours(V.channel_carrier(spark, d), limit=50, order="desc")


@check("luma_channel_histogram", f"""with p as (select * from {RASTER} q), u as (select clip_id, frame, 'r' as channel, r as bin from p
 union all select clip_id, frame, 'g', g from p union all select clip_id, frame, 'b', b from p
 union all select clip_id, frame, 'luma', {J(L709)} from p)
 select clip_id, frame, channel, bin, count(*) as n from u group by all""")
def _hist(spark, d):
    return A.channel_histogram(V.raster_px(spark, d), ["clip_id", "frame"])


def cdf_sql(keys, bin_expr, src):
    return f"""(select {keys}, bin, case when total = lo then bin else {J('(cdf - lo) / (total - lo) * 255.0')} end as mapped from
 (select *, min(cdf) over (partition by {keys}) as lo from
  (select *, sum(n) over (partition by {keys} order by bin) as cdf, sum(n) over (partition by {keys}) as total from
   (select {keys}, {bin_expr} as bin, count(*) as n from {src} s0 group by all) h0) h1) h2)"""


_lut = cdf_sql("clip_id, frame", J(L709), RASTER)
_k = f"(case when {L709U} > 1 / 255.0 then mapped / 255.0 / {L709U} else 1.0 end)"
on_raster("histogram_equalization", A.histogram_equalization, raster_sql(
    *each(FU(f"{{c}} / 255.0 * {_k}")),
    pre=f"(select * from (select *, {J(L709)} as bin from {RASTER} e0) e1 join {_lut} e2 using (clip_id, frame, bin))"))
_per = {c: cdf_sql("clip_id, frame", c, RASTER) for c in "rgb"}


@check("histogram_equalization_per_channel", f"""select p.clip_id, p.frame, x, y, lr.mapped as r, lg.mapped as g, lb.mapped as b, a from {RASTER} p
 join {_per['r']} lr on lr.clip_id = p.clip_id and lr.frame = p.frame and lr.bin = p.r
 join {_per['g']} lg on lg.clip_id = p.clip_id and lg.frame = p.frame and lg.bin = p.g
 join {_per['b']} lb on lb.clip_id = p.clip_id and lb.frame = p.frame and lb.bin = p.b""")
def _heq_channels(spark, d):
    return A.histogram_equalization_per_channel(V.raster_px(spark, d))


@check("clahe", f"""with p as (select *, {J(L709)} as l from {RASTER} q),
 h as (select clip_id, frame, x // 4 as tx, y // 4 as ty, l as bin, count(*) as n from p group by all),
 t as (select clip_id, frame, tx, ty, sum(n) as total, greatest(1, {J('3.0 * sum(n) / 256')}) as cap from h group by all),
 ex as (select clip_id, frame, tx, ty, total, cap, sum(greatest(0, n - cap)) as excess from h join t using (clip_id, frame, tx, ty) group by all),
 dn as (select ex.*, b.bin, least(coalesce(h.n, 0), cap) as n from ex cross join (select unnest(range(256)) as bin) b
  left join h on h.clip_id = ex.clip_id and h.frame = ex.frame and h.tx = ex.tx and h.ty = ex.ty and h.bin = b.bin),
 cdf as (select clip_id, frame, tx, ty, bin, {J('(sum(n) over (partition by clip_id, frame, tx, ty order by bin) + (excess // 256) * (bin + 1) + least(bin + 1, excess - (excess // 256) * 256)) / total * 255.0')} as v from dn),
 f as (select *, greatest(0, cast(floor((x + 0.5) / 4 - 0.5) as int)) as tx0, greatest(0, cast(floor((y + 0.5) / 4 - 0.5) as int)) as ty0 from p),
 w as (select *, {CL('(x + 0.5) / 4 - 0.5 - tx0')} as wx, {CL('(y + 0.5) / 4 - 0.5 - ty0')} as wy, least(1, tx0 + 1) as tx1, least(1, ty0 + 1) as ty1 from f),
 m as (select w.*, round(c00.v * (1 - wx) * (1 - wy) + c10.v * wx * (1 - wy) + c01.v * (1 - wx) * wy + c11.v * wx * wy, 9) as mm from w
  join cdf c00 on c00.clip_id = w.clip_id and c00.frame = w.frame and c00.tx = tx0 and c00.ty = ty0 and c00.bin = l
  join cdf c10 on c10.clip_id = w.clip_id and c10.frame = w.frame and c10.tx = tx1 and c10.ty = ty0 and c10.bin = l
  join cdf c01 on c01.clip_id = w.clip_id and c01.frame = w.frame and c01.tx = tx0 and c01.ty = ty1 and c01.bin = l
  join cdf c11 on c11.clip_id = w.clip_id and c11.frame = w.frame and c11.tx = tx1 and c11.ty = ty1 and c11.bin = l)
 select clip_id, frame, x, y, {', '.join(U8(f'{c} * (case when l > 0 then mm / l else 1.0 end)') + f' as {c}' for c in 'rgb')}, a from m""")
def _clahe(spark, d):
    return A.clahe(V.raster_px(spark, d), width=8, height=8, tileSize=4)


@check("min_max_equalise", """select e.event_id, e.event_type, round((value - lo) * 256.0 / (hi - lo), 6) as v from events e
 join (select event_type, min(value) as lo, max(value) as hi from events group by 1) r using (event_type)""")
def _min_max(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type", "value")
    return A.min_max_equalise(e, ["event_type"], "value", "v").select(
        "event_id", "event_type", F.round("v", 6).alias("v"))


# ---- palettes ---------------------------------------------------------------------------

def median_cut_sql(depths, adapt):
    """Rank single pixels instead of weighted colours: the plain statement of the cut."""
    sql = f"""with p as (select r, g, b, r as c0, g as c1, b as c2 from {CARRIER} q),
 rng as (select list_sort([{{'d': -(max(r) - min(r)), 'k': 0}}, {{'d': -(max(g) - min(g)), 'k': 1}}, {{'d': -(max(b) - min(b)), 'k': 2}}]) as o from p),
 b0 as (select r, g, b, 0 as bucket, o from p, rng)"""
    for k in range(depths):
        key = f"(case o[{k % 3 + 1}].k when 0 then r when 1 then g else b end)"
        sql += f""", s{k} as (select *, row_number() over (partition by bucket order by {key} desc, r, g, b) - 1 as rn, count(*) over (partition by bucket) as sz from b{k}),
 b{k + 1} as (select r, g, b, bucket * 2 + case when rn < sz // 2 then 0 else 1 end as bucket, o from s{k})"""
    key = f"(case o[{depths % 3 + 1}].k when 0 then r when 1 then g else b end)"
    sql += f""", z as (select *, row_number() over (partition by bucket order by {key} desc, r, g, b) - 1 as rn, count(*) over (partition by bucket) as sz from b{depths})"""
    if adapt == "AVERAGE":
        pick = "select bucket, cast(floor(sum(r) / count(*)) as int) as r, cast(floor(sum(g) / count(*)) as int) as g, cast(floor(sum(b) / count(*)) as int) as b from z group by bucket"
    else:
        pick = f"select bucket, r, g, b from z where rn = {'0' if adapt == 'FIRST' else 'sz // 2'}"
    return sql + f" select cast(row_number() over (order by bucket) - 1 as int) as idx, r, g, b from ({pick}) y"


for _mode in ("MID", "AVERAGE", "FIRST"):
    check("mediancutpalette" if _mode == "MID" else f"mediancutpalette_{_mode.lower()}", median_cut_sql(3, _mode))(
        lambda spark, d, m=_mode: A.median_cut_palette(V.channel_carrier(spark, d), limit=3, adaptMode=m))
_pal_sql = median_cut_sql(3, "MID")


@check("median_cut", f"""with pal as ({_pal_sql}), d as (select q.l_orderkey, q.l_linenumber, q.a, q.rowid_, pal.r, pal.g, pal.b,
 row_number() over (partition by rowid_ order by (q.r - pal.r) * (q.r - pal.r) + (q.g - pal.g) * (q.g - pal.g) + (q.b - pal.b) * (q.b - pal.b), idx) as rn
 from (select *, row_number() over () as rowid_ from {CARRIER} c0) q, pal)
 select l_orderkey, l_linenumber, r, g, b, a from d where rn = 1""")
def _median_cut(spark, d):
    px = V.channel_carrier(spark, d)
    return N.nearest_palette(px, A.median_cut_palette(px, limit=3))


def _cube(d):
    return f"(((r >> (8 - {d})) << 16) + ((g >> (8 - {d})) << 8) + (b >> (8 - {d})))"


@check("octree_quantize", f"""with c as materialized (select r, g, b, count(*) as n from {CARRIER} c0 group by all),
 z as (select d, (select count(distinct case when d = 0 then 0 else {_cube('d')} end) from c) as k from (select unnest(range(0, 9)) as d)),
 p as (select max(d) as d, 12 - max_by(k, d) as free from z where d = 0 or k <= 12),
 q as (select case when p.d = 0 then 0 else {_cube('p.d')} end as parent, {_cube('least(8, p.d + 1)')} as cube, p.d, p.free, sum(n) as n, sum(r * n) as sr, sum(g * n) as sg, sum(b * n) as sb from c, p group by all),
 o as (select *, d = 8 or row_number() over (order by n desc, cube) <= free as own from q),
 e as (select own, case when own then cube else parent end as cube, {J('sum(sr) / sum(n)')} as pr, {J('sum(sg) / sum(n)')} as pg, {J('sum(sb) / sum(n)')} as pb from o group by all),
 pal as materialized (select row_number() over (order by own, cube) as i, pr, pg, pb from e),
 near as materialized (select r, g, b, arg_min({{'pr': pr, 'pg': pg, 'pb': pb}}, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 256 + i) as s from c, pal group by all)
 select l_orderkey, l_linenumber, s.pr as r, s.pg as g, s.pb as b, a from {CARRIER} c0 join near using (r, g, b)""")
def _octree(spark, d):
    px = V.channel_carrier(spark, d)
    pal = [(r["r"], r["g"], r["b"]) for r in A.octree_palette(px, levels=12).orderBy("own", "cube").collect()]
    return N.nearest_palette(px, pal)


_KSEED = [(0, 0, 0), (255, 255, 255), (200, 60, 50), (60, 180, 20)]


def kmeans_sql(iters):
    vals = ", ".join(f"({i}, {a}.0, {b}.0, {c}.0)" for i, (a, b, c) in enumerate(_KSEED))
    sql = f"with cc as (select r, g, b, count(*) as n from {CARRIER} q group by all), k0(i, kr, kg, kb) as (values {vals})"
    for t in range(iters):
        sql += f""", d{t} as (select r, g, b, n, i, row_number() over (partition by r, g, b order by (r - kr) * (r - kr) + (g - kg) * (g - kg) + (b - kb) * (b - kb), i) as rn from cc, k{t}),
 k{t + 1} as (select i, cast(sum(r * n) as double) / sum(n) as kr, cast(sum(g * n) as double) / sum(n) as kg, cast(sum(b * n) as double) / sum(n) as kb from d{t} where rn = 1 group by i)"""
    return sql + f""", f as (select r, g, b, i, kr, kg, kb, row_number() over (partition by r, g, b order by (r - kr) * (r - kr) + (g - kg) * (g - kg) + (b - kb) * (b - kb), i) as rn from cc, k{iters})
 select p.l_orderkey, p.l_linenumber, {J('kr')} as r, {J('kg')} as g, {J('kb')} as b, a from {CARRIER} p join f using (r, g, b) where rn = 1"""


@check("k_means", kmeans_sql(3))
def _kmeans(spark, d):
    return N.k_means(V.channel_carrier(spark, d), seeds=_KSEED, iterations=3)


# ---- cells ------------------------------------------------------------------------------

RASTER_Q = RASTER.replace("255 as a", "255 as a, q as px")


def gather_sql(sx, sy, src=RASTER_Q):
    """Pixels taken from another place of the same frame, whose values are the list px."""
    return f"""select clip_id, frame, x, y, px[i + 1] as r, px[(i + 21) % 64 + 1] as g, px[(i + 42) % 64 + 1] as b, a
 from (select *, cast({sy} as int) * 8 + cast({sx} as int) as i from {src} q0) t"""


def on_frames(name, op, sql, **params):
    check(name, sql)(lambda spark, d: op(V.raster_px(spark, d), **params))


_px = "cast(least(7, floor((least(2, floor({v} * 3 / 8.0)) + 0.5) * 8 / 3.0)) as int)"
on_frames("pixelate", A.pixelate, gather_sql(_px.format(v="x"), _px.format(v="y")), width=8, height=8, scale=0.4)


@check("pixelate_mean", f"""select clip_id, frame, cast(x // 3 as int) as bx, cast(y // 3 as int) as by_, count(*) as n, {J('avg(r)')} as r, {J('avg(g)')} as g, {J('avg(b)')} as b from {RASTER} p group by clip_id, frame, x // 3, y // 3""")
def _pixelate_mean(spark, d):
    return A.cell_average(V.raster_px(spark, d), {
        "bx": F.floor(F.col("x") / 3).cast("int"), "by_": F.floor(F.col("y") / 3).cast("int")})


_hex = f"""(select *, case when wq then -rw - rz else rq end as qc, case when wq then rz else -rq - rw end as rc from
 (select *, abs(rq - q) > abs(rw - w) and abs(rq - q) > abs(rz - z) as wq from
  (select *, floor(q + 0.5) as rq, floor(z + 0.5) as rz, floor(w + 0.5) as rw from
   (select *, -q - z as w from (select *, ((x - 2.5) * (1.7320508 / 3.0) - (y - 2.5) / 3.0) / 2.5 as q, ((y - 2.5) * (2.0 / 3.0)) / 2.5 as z from {RASTER_Q} h0) h1) h2) h3) h4)"""
on_frames("hex_pixelate", A.hex_pixelate, gather_sql(
    f"least(7, greatest(0, {J('2.5 * 1.7320508 * (qc + rc * 0.5) + 2.5')}))", f"least(7, greatest(0, {J('2.5 * 1.5 * rc + 2.5')}))",
    src=_hex), width=8, height=8, cellSize=2.5)
_tri = f"(select *, case when (x - floor(x / 3.0) * 3) + (y - floor(y / 3.0) * 3) < 3 then 1 / 3.0 else 2 / 3.0 end as fr from {RASTER_Q} t0)"
on_frames("triangle_pixelate", A.triangle_pixelate, gather_sql(
    f"least(7, greatest(0, {J('floor(x / 3.0) * 3 + 3 * fr')}))", f"least(7, greatest(0, {J('floor(y / 3.0) * 3 + 3 * fr')}))",
    src=_tri), width=8, height=8, cellSize=3)

# ---- step statistics --------------------------------------------------------------------

STEPS = "(select user_id as run_id, event_id, ts, event_type as name, round(value * 10, 2) as ms, props from events)"


@check("backend_usage_counts", f"""select name, string_agg(backend, ',' order by backend) as backends, count(*) as n_backends from
 (select distinct name, case when ms >= 300 then 'wasm' when ms >= 100 then 'gl' else 'js' end as backend from {STEPS} s) t group by name""")
def _backends(spark, d):
    s = V.step_times(spark, d).withColumn(
        "backend", F.when(F.col("ms") >= 300, "wasm").when(F.col("ms") >= 100, "gl").otherwise("js"))
    return A.backend_usage(s, "name", "backend")


@check("step_time_totals", f"""select run_id, name, cast(sum(cast(round(ms * 100) as bigint)) as bigint) / 100.0 as total_ms, count(*) as n
 from {STEPS} s group by rollup (run_id, name)""")
def _totals(spark, d):
    return A.step_totals(V.step_times(spark, d))


@check("slow_step_flagging", f"""select run_id || ':' || name as name, max(ms) as max_ms, count(*) filter (where ms >= 1500) as n_soft
 from {STEPS} s group by 1 having max(ms) >= 3500 or count(*) filter (where ms >= 1500) >= 2""")
def _slow(spark, d):
    return A.slow_steps(V.step_times(spark, d).withColumn("name", F.concat_ws(":", "run_id", "name")))


@check("slow_list", f"""select run_id || ':' || name as name from {STEPS} s group by 1
 having max(ms) >= 3500 or count(*) filter (where ms >= 1500) >= 2 order by 1""")
def _slow_list(spark, d):
    s = V.step_times(spark, d).withColumn("name", F.concat_ws(":", "run_id", "name"))
    return A.slow_steps(s).select("name").orderBy("name")


@check("bench_compare", """with r as (select user_id, event_type, ts < timestamp '2024-01-03' as early, avg(value) as v from events group by all),
 b as (select user_id, event_type, v from r where early), a as (select user_id, event_type, v from r where not early)
 select coalesce(b.user_id, a.user_id) as user_id, coalesce(b.event_type, a.event_type) as event_type, round(b.v, 6) as before, round(a.v, 6) as after,
 round((a.v - b.v) / b.v * 100, 6) as delta_pct, round(a.v / b.v, 6) as speedup,
 case when b.v is not null and a.v is not null then 'both' when b.v is null then 'new' else 'removed' end as status
 from b full join a on a.user_id = b.user_id and a.event_type = b.event_type""")
def _bench(spark, d):
    """The first two days against the rest of the month."""
    early = F.col("ts_us") < 1_704_240_000_000_000   # 2024-01-03 UTC
    keys = ["user_id", "event_type"]
    rep = V.events(spark, d).groupBy(*keys, early.alias("early")).agg(F.avg("value").alias("v"))
    return A.bench_compare(rep.where("early"), rep.where("not early"), keys).withColumns(
        {"before": F.round("before", 6), "after": F.round("after", 6)})


@check("gif_colour_table", f"""with f as (select clip_id, r, g, b, min({{'frame': frame, 'y': y, 'x': x}}) as p from {RASTER} q group by clip_id, r, g, b),
 k as (select clip_id, r, g, b, cast(row_number() over (partition by clip_id order by p) - 1 as int) as idx, count(*) over (partition by clip_id) as n from f)
 select clip_id, idx, r, g, b from k where idx < 256 and n >= 2""")
def _colour_table(spark, d):
    return A.first_seen_colours(V.raster_px(spark, d), ["clip_id"], ["frame", "y", "x"])


_vq = f"(select clip_id, frame, x, y, a, (r // 64) as r, (g // 64) as g, (b // 64) as b from {RASTER} v0)"


@check("error_diffusion_vote", f"""with q as (select * from {_vq} v), w as (select q.clip_id, q.frame, q.x, q.y, q.a, h.r, h.g, h.b, count(*) as n, max(h.frame) as late
  from q join q h on h.clip_id = q.clip_id and h.x = q.x and h.y = q.y and h.frame between q.frame - 4 and q.frame group by all)
 select clip_id, frame, x, y, cast(v.r as int) as r, cast(v.g as int) as g, cast(v.b as int) as b, a from
 (select clip_id, frame, x, y, a, max_by({{'r': r, 'g': g, 'b': b}}, {{'n': n, 'l': late}}) as v from w group by clip_id, frame, x, y, a) z""")
def _vote(spark, d):
    px = V.raster_px(spark, d).withColumns({c: F.floor(F.col(c) / 64).cast("int") for c in C.RGB})
    return A.most_common_recent(px, window=5, chunk=16)
