"""Sources, sorts, chains, presets, text and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import tables as T
from rasterloom.operators import catalog as K
from rasterloom.operators import lineage
from rasterloom.operators import sorting as SO
from rasterloom.plans import chain as CH
from rasterloom.sources import media as MD
from rasterloom.sources import views as V
from rasterloom.suite.checks_a_pixel import HSV, QL, SECTORS, from_hsv, lin, nearest_sql, on_raster, unlin
from rasterloom.suite.checks_b_joins_aggs import LAB, on_frames
from rasterloom.suite.checks_d_space import SIZE, chans, taps_sql
from rasterloom.operators import stencil as ST
from rasterloom.suite.registry import CARRIER, FU, J, L709, L709U, RASTER, U8, U8S, carrier_sql, check, each, raster_sql, tile_hash_sql

# ---- sources ----------------------------------------------------------------------------


@check("media_routing_by_type", """select event_id, case when event_type in ('view', 'click') then 'video' else 'image' end as route from events""")
def _routing(spark, d):
    mime = F.when(F.col("event_type").isin("view", "click"), "video/mp4").otherwise("image/png")
    videos, images = MD.route_by_type(V.table(spark, d, "events").withColumn("mime", mime))
    return videos.select("event_id", F.lit("video").alias("route")).unionByName(
        images.select("event_id", F.lit("image").alias("route")))


@check("image_file_scan", f"""select clip_id, frame, 8 as width, count(*) as height, cast(sum(total) as bigint) as total from
 (select clip_id, frame, y, sum(3 * r + a) as total from {RASTER} p group by all) q group by all""")
def _image_scan(spark, d):
    """Every frame is written as an image file into the shared folder; the files are found, read and decoded."""
    folder = lineage.work_folder(spark)
    MD.write_images(V.frame_vectors(spark, d), folder, width=8, height=8)
    rows = MD.scan_images(spark, folder, glob="*.txt")
    at = [F.regexp_extract("path", f"/{c}=(\\d+)/", 1).cast("int").alias(c) for c in ("clip_id", "frame")]
    return rows.groupBy(*at).agg(F.max("width").alias("width"), F.count("*").alias("height"),
                                 F.sum(F.aggregate("rgba", F.lit(0), lambda a, v: a + v)).cast("bigint").alias("total"))


@check("video_gif_frame_scan", """select user_id as clip_id, event_id, epoch_us(ts) as ts_us, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_token from events""")
def _frame_scan(spark, d):
    return MD.frame_tokens(V.decoded_frames(spark, d)).select("clip_id", "event_id", "ts_us", "frame_token")


@check("filter_catalogue_scan", "select p_name as name, p_brand as category, p_type as description, p_size % 2 = 0 as temporal from part")
def _catalogue(spark, d):
    return V.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("category"),
                                            F.col("p_type").alias("description"), (F.col("p_size") % 2 == 0).alias("temporal"))


CHAINS = """(select l_orderkey as chain_id, o_orderpriority as category, list('S' || (l_partkey % 40) order by l_linenumber, l_partkey, l_suppkey) as steps
 from lineitem join orders on o_orderkey = l_orderkey group by all)"""


@check("preset_catalogue_scan", f"select chain_id, category, cast(unnest(range(len(steps))) as int) as pos, unnest(steps) as step from {CHAINS} c")
def _presets(spark, d):
    cats = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("chain_id"), F.col("o_orderpriority").alias("category"))
    return V.positioned_steps(spark, d).join(cats, "chain_id").select("chain_id", "category", "pos", "step")


@check("theme_palette_scan", f"select clip_id, frame, cast(y * 8 + x as int) as idx, r, g, b from {RASTER} p")
def _themes(spark, d):
    zipped = F.arrays_zip(F.col("q").alias("r"), F.concat(F.slice("q", 22, 43), F.slice("q", 1, 21)).alias("g"),
                          F.concat(F.slice("q", 43, 22), F.slice("q", 1, 42)).alias("b"))
    return V.frame_vectors(spark, d).select("clip_id", "frame", F.posexplode(zipped).alias("idx", "c")).select(
        "clip_id", "frame", "idx", "c.*")


def _catalog_table(spark, d):
    """Known step names with their default options, from the steps in use."""
    return V.chain_steps(spark, d).select("step").distinct().where("cast(substr(step, 2) as int) < 30").select(
        F.col("step").alias("name"), F.create_map(F.lit("mode"), F.lit("A"), F.lit("q"), F.lit("10")).alias("defaults"))


def _state_docs(spark, d):
    li = V.table(spark, d, "lineitem")
    step = F.concat(F.lit('{"n":"S'), F.pmod("l_partkey", F.lit(40)), F.lit('","e":'), F.when(F.col("l_linenumber") % 3 == 0, "false").otherwise("true"),
                    F.lit(',"o":{"q":"'), F.col("l_quantity").cast("int"), F.lit('"}}'))
    docs = li.groupBy(F.col("l_orderkey").alias("state_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", step.alias("j")))), lambda s: s["j"]).alias("js"))
    v2 = F.concat(F.lit('{"v":2,"chain":['), F.array_join("js", ","), F.lit("]}"))
    v1 = F.concat(F.lit('{"selected":"S'), F.pmod("state_id", F.lit(40)), F.lit('"}'))
    return docs.select("state_id", F.when(F.col("state_id") % 4 == 0, v1).otherwise(v2).alias("doc"))


_steps = """(select l_orderkey as state_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as int) as pos,
 l_partkey % 40 as s, l_linenumber % 3 <> 0 as enabled, cast(cast(l_quantity as int) as varchar) as q from lineitem where l_orderkey % 4 <> 0
 union all select distinct l_orderkey, 0, l_orderkey % 40, true, '10' from lineitem where l_orderkey % 4 = 0)"""


@check("shared_state_ingest_v1_v2", f"select state_id, pos, 'S' || s as name, enabled, q, 'A' as mode from {_steps} t where s < 30")
def _ingest(spark, d):
    out = K.load_states(_state_docs(spark, d), _catalog_table(spark, d))
    return out.select("state_id", "pos", "name", "enabled", F.col("options")["q"].alias("q"), F.col("options")["mode"].alias("mode"))


@check("state_export_delta_encoded", f"""select state_id, '{{"v":2,"chain":[' || string_agg('{{"n":"S' || s || '"' || case when enabled then '' else ',"e":false' end
 || case when q = '10' then '' else ',"o":{{"q":"' || q || '"}}' end || '}}', ',' order by pos) || ']}}' as doc from {_steps} t where s < 30 group by state_id""")
def _export(spark, d):
    cat = _catalog_table(spark, d)
    return K.export_states(K.load_states(_state_docs(spark, d), cat), cat)


@check("frame_sequence_sink", raster_sql("r", "g", "b"))
def _sink(spark, d):
    """Write the frames and read them back."""
    path = lineage.work_folder(spark) + "/frames"
    MD.write_frames(V.raster_px(spark, d), path)
    return spark.read.parquet(path).drop("frame_run")


# ---- sorts ------------------------------------------------------------------------------

def sorted_sql(line, pos, key, lo, hi, *, extra="true", desc="", size=0, src=RASTER, back="", chan="r, g, b, a"):
    part = f"floor((pos - min(pos) over (partition by clip_id, frame, line, run)) / {size}.0)" if size else "0"
    return f"""with a as (select *, {line} as line, {pos} as pos, {L709} as l from {src} p0),
 b as (select *, l - coalesce(lag(l) over w, l) as dl from a window w as (partition by clip_id, frame, line order by pos)),
 c as (select *, l between {lo} and {hi} and {extra} as onn from b),
 e as (select *, case when onn and coalesce(lag(onn) over (partition by clip_id, frame, line order by pos), false) then 0 else 1 end as cut from c),
 f as (select *, sum(cut) over (partition by clip_id, frame, line order by pos) as run from e), g as (select *, {part} as part from f),
 h as (select *, row_number() over (partition by clip_id, frame, line, run, part order by {key}, pos) as k, row_number() over (partition by clip_id, frame, line, run, part order by pos) as p from g)
 select t.clip_id, t.frame, t.x, t.y, s.r, s.g, s.b, s.a from h t join h s on s.clip_id = t.clip_id and s.frame = t.frame and s.line = t.line and s.run = t.run and s.part = t.part and s.k = t.p"""


on_frames("pixelsort", SO.pixelsort, sorted_sql("x", "y", L709, 110, 140), sortPixelLuminanceAbove=110.0, sortPixelLuminanceBelow=140.0)
on_frames("pixelsort_rows", SO.pixelsort, sorted_sql("y", "x", "g desc, b desc, r desc, a desc", 100, 150, extra="dl between -30 and 30", size=3),
          direction="ROW", sortDirection="DESCENDING", comparator="GBRA", sortPixelLuminanceAbove=100.0, sortPixelLuminanceBelow=150.0,
          sortPixelLuminanceChangeAbove=-30.0, sortPixelLuminanceChangeBelow=30.0, maxIntervalSize=3)
on_frames("pixelsort_diagonal", SO.pixelsort, sorted_sql("x - y", "least(x, y)", "b, g, r, a", 0, 255), direction="DIAGONAL",
          comparator="BGRA", sortPixelLuminanceAbove=0.0, sortPixelLuminanceBelow=255.0)
_ck = {"RGBA": "r, g, b, a", "GBRA": "g, b, r, a", "HSVA": "h, s, v, a", "LABA": "ll, la, lb, a", "LUMINANCE": L709}


@check("comparators", f"""select l_orderkey, l_linenumber, r, g, b, dense_rank() over (order by r, g, b) as rk_rgb, dense_rank() over (order by g, b, r) as rk_gbr, dense_rank() over (order by b, g, r) as rk_bgr from {CARRIER} p""")
def _comparators(spark, d):
    """Ranks by channel-order comparators, computed on distinct colours and joined back."""
    px = V.channel_carrier(spark, d)
    ranked = px.select("r", "g", "b")
    out = px
    for name, cols in (("rk_rgb", ("r", "g", "b")), ("rk_gbr", ("g", "b", "r")), ("rk_bgr", ("b", "g", "r"))):
        out = out.join(_colour_rank(ranked, cols, name), ["r", "g", "b"])
    return out.select("l_orderkey", "l_linenumber", "r", "g", "b", "rk_rgb", "rk_gbr", "rk_bgr")


def _colour_rank(colours, cols, name):
    """Dense rank of each distinct colour: the leading channel is the bucket."""
    from rasterloom.operators.ordered import bucketed_rank
    d = colours.distinct().withColumn("_all", F.lit(0))
    return bucketed_rank(d, ["_all"], cols[0], list(cols[1:]), name).withColumn(name, F.col(name) + 1).drop("_all")


@check("comparator_order", f"select l_orderkey, l_linenumber, r, g, b, a from {HSV} q order by h desc, s desc, v desc, a desc, l_orderkey, l_linenumber, r, g, b")
def _comparator_order(spark, d):
    return SO.ordered_by(V.channel_carrier(spark, d), "HSVA", descending=True, ties=["l_orderkey", "l_linenumber", "r", "g", "b"])


@check("comparator_lab_luminance", f"""select l_orderkey, l_linenumber, r, g, b, a from {LAB} q order by ll, la, lb, a, l_orderkey, l_linenumber, r, g, b""")
def _lab_order(spark, d):
    return SO.ordered_by(V.channel_carrier(spark, d), "LABA", ties=["l_orderkey", "l_linenumber", "r", "g", "b"])


# ---- presets and chains -----------------------------------------------------------------

@check("preset_resolve", "select l_orderkey as chain_id, l_linenumber, 'S' || (l_partkey % 40) as step, 'A' as mode from lineitem where l_partkey % 40 < 30")
def _resolve(spark, d):
    cat = _catalog_table(spark, d).withColumnRenamed("name", "step")
    return V.chain_steps(spark, d).join(cat, "step").select("chain_id", "l_linenumber", "step", F.col("defaults")["mode"].alias("mode"))


@check("catalogue_membership_semi_anti", "select l_orderkey as chain_id, l_linenumber, 'S' || (l_partkey % 40) as step, l_partkey % 40 < 30 as known from lineitem")
def _membership(spark, d):
    s = V.chain_steps(spark, d).select("chain_id", "l_linenumber", "step")
    cat = _catalog_table(spark, d).select(F.col("name").alias("step"))
    return s.join(cat, "step", "left_semi").withColumn("known", F.lit(True)).unionByName(
        s.join(cat, "step", "left_anti").withColumn("known", F.lit(False))).select("chain_id", "l_linenumber", "step", "known")


SIGS = f"(select chain_id, list_aggregate(steps, 'string_agg', '>') as signature from {CHAINS} c)"


def _signed(spark, d):
    return V.chains(spark, d).select(F.col("chain_id").alias("name"), F.array_join("steps", ">").alias("signature"))


@check("preset_duplicate_groups", f"select signature, count(*) as n, min(chain_id) as first_name from {SIGS} s group by 1 having count(*) > 1")
def _dups(spark, d):
    return K.duplicate_groups(_signed(spark, d))


@check("preset_duplicate_members", f"select min(chain_id) over (partition by signature) as first_name, count(*) over (partition by signature) as n, chain_id as name from {SIGS} s qualify count(*) over (partition by signature) > 1")
def _dup_members(spark, d):
    return K.duplicate_members(_signed(spark, d))


_SIM = f"""with d as (select steps, category, min(chain_id) as id, count(*) as copies, list_distinct(steps) as tok from {CHAINS} c group by steps, category),
 p as (select a.id as a, b.id as b, a.copies as copies_a, b.copies as copies_b, len(list_intersect(a.tok, b.tok)) as sh, a.tok as ta, b.tok as tb, a.steps as sa, b.steps as sb, a.category = b.category as same
  from d a join d b on a.steps[1] = b.steps[1] and a.id < b.id),
 q as (select a, b, copies_a, copies_b, cast(sh as double) / (len(ta) + len(tb) - sh) as jac, len(list_filter(range(1, least(len(sa), len(sb)) + 1), lambda i: sa[i] = sb[i])) / cast(greatest(len(sa), len(sb)) as double) as ord, same from p)
 select a, b, round(jac * 0.5 + ord * 0.25 + 0.15 + case when same then 0.1 else 0.0 end, 9) as score, round(jac, 9) as jaccard, round(ord, 9) as ordered, copies_a, copies_b from q
 where round(jac * 0.5 + ord * 0.25 + 0.15 + case when same then 0.1 else 0.0 end, 9) >= 0.85"""


@check("preset_similarity_report", _SIM)
def _similar(spark, d):
    return K.similar_pairs(V.chains(spark, d), threshold=0.85)


@check("similar_pair_ranking", f"select a, b, score from ({_SIM}) z order by score desc, a, b limit 100")
def _ranking(spark, d):
    return K.similar_pairs(V.chains(spark, d), threshold=0.85, limit=100).select("a", "b", "score")


def _neighbours(spark, d):
    c = V.chains(spark, d).select("chain_id", "steps")
    nxt = c.select((F.col("chain_id") - 1).alias("chain_id"), F.col("steps").alias("other"))
    return c.join(nxt, "chain_id")


_NB = f"(select a.chain_id, a.steps, b.steps as other from {CHAINS} a join {CHAINS} b on b.chain_id = a.chain_id + 1)"


@check("shared_steps", f"select chain_id, coalesce(list_aggregate(list_sort(list_intersect(steps, other)), 'string_agg', ','), '') as shared, cast(len(list_intersect(steps, other)) as int) as n from {_NB} q")
def _shared(spark, d):
    s = F.array_sort(F.array_intersect("steps", "other"))
    return _neighbours(spark, d).select("chain_id", F.array_join(s, ",").alias("shared"), F.size(s).alias("n"))


@check("union_of_steps", f"select chain_id, cast(len(list_distinct(steps || other)) as int) as n, round(len(list_intersect(steps, other)) / cast(len(list_distinct(steps || other)) as double), 6) as jaccard from {_NB} q")
def _union(spark, d):
    u = F.size(F.array_union("steps", "other"))
    return _neighbours(spark, d).select("chain_id", u.alias("n"), F.round(F.size(F.array_intersect("steps", "other")) / u, 6).alias("jaccard"))


@check("preset_categories", f"select distinct category from {CHAINS} c")
def _categories(spark, d):
    return V.chains(spark, d).select("category").distinct()


JOIN = "list_aggregate({0}, 'string_agg', ',')"


@check("chain_add_duplicate", f"""select chain_id, {JOIN.format("case when len(steps) < 16 then list_append(steps, 'NEW') else steps end")} as added,
 {JOIN.format("case when len(steps) > 1 and len(steps) < 16 then steps[1:2] || steps[2:16] else steps end")} as duplicated from {CHAINS} c""")
def _add(spark, d):
    return V.chains(spark, d).select("chain_id", F.array_join(K.chain_add(F.col("steps"), F.lit("NEW")), ",").alias("added"),
                                     F.array_join(K.chain_duplicate(F.col("steps"), 1), ",").alias("duplicated"))


@check("chain_remove_toggle_reorder_replace", f"""select chain_id, {JOIN.format("case when len(steps) > 1 then steps[1:1] || steps[3:] else steps end")} as removed,
 {JOIN.format("steps[1:1] || (case when len(steps) > 1 then ['X'] else [] end) || steps[3:]")} as replaced,
 {JOIN.format("case when len(steps) > 2 then steps[2:3] || steps[1:1] || steps[4:] else steps end")} as moved,
 {JOIN.format("list_transform(steps, lambda s: s || ':' || (case when s = 'S7' then 'off' else 'on' end))")} as toggled from {CHAINS} c""")
def _edit(spark, d):
    s = F.col("steps")
    entries = F.transform(s, lambda n: F.struct(n.alias("name"), F.lit(True).alias("enabled")))
    shown = F.transform(K.chain_toggle(entries, F.lit("S7")), lambda e: F.concat(e["name"], F.when(e["enabled"], ":on").otherwise(":off")))
    return V.chains(spark, d).select("chain_id", F.array_join(K.chain_remove(s, 1), ",").alias("removed"),
                                     F.array_join(K.chain_replace(s, 1, F.lit("X")), ",").alias("replaced"),
                                     F.array_join(K.chain_move(s, 0, 2), ",").alias("moved"), F.array_join(shown, ",").alias("toggled"))


@check("distinct_metric_list", "select user_id, event_type, min(event_id) as first_pos from events where event_type <> 'error' group by 1, 2")
def _metric_list(spark, d):
    skip = spark.createDataFrame([("error",)], "event_type string")
    return K.first_seen(V.table(spark, d, "events"), ["user_id"], "event_type", "event_id", skip)


@check("metrictoparameter_pairing", """with recursive s as materialized (select *, md5(o_orderpriority || ':' || step) as h from
  (select o_custkey, o_orderpriority, 'S' || (l_partkey % 40) as step, count(*) * 2 + case when 'S' || (l_partkey % 40) < 'S2' then 1.5e0 else 0e0 end as score
   from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, o_orderpriority, l_partkey % 40) q),
 r as (select o_custkey, o_orderpriority, step, score, [o_orderpriority] as ls, [step] as rs from (select *, row_number() over (partition by o_custkey order by score desc, h desc) as rn from s) f where rn = 1
  union all select o_custkey, o_orderpriority, step, score, list_append(ls, o_orderpriority), list_append(rs, step) from
   (select s.*, r.ls, r.rs, row_number() over (partition by s.o_custkey order by s.score desc, s.h desc) as rn from r join s on s.o_custkey = r.o_custkey
    where not list_contains(r.ls, s.o_orderpriority) and not list_contains(r.rs, s.step)) n where rn = 1)
 select o_custkey, o_orderpriority, step, score from r""")
def _pairing(spark, d):
    """Order priorities compete for steps inside each customer; every pair seen is a candidate."""
    li = V.chain_steps(spark, d).select(F.col("chain_id").alias("o_orderkey"), "step")
    s = V.table(spark, d, "orders").join(li, "o_orderkey").groupBy("o_custkey", "o_orderpriority", "step").agg(
        (F.count("*") * 2 + F.when(F.col("step") < "S2", 1.5).otherwise(0.0)).alias("score"))
    return K.greedy_pairs(s, "o_custkey", "o_orderpriority", "step", 5)


@check("metric_pick_per_mode", """with m as (select o_orderkey % 7 as mode, 'S' || (l_partkey % 40) as step, count(*) > 40 as used from orders join lineitem on l_orderkey = o_orderkey group by all)
 select mode, step, used, cast(rank as int) as rank from (select *, row_number() over (partition by mode order by used, md5('0:' || step), step) as rank from m) r where rank <= 6""".replace("from orders join lineitem on l_orderkey = o_orderkey", "from lineitem").replace("o_orderkey", "l_orderkey"))
def _pick(spark, d):
    m = V.chain_steps(spark, d).groupBy(F.pmod("chain_id", F.lit(7)).alias("mode"), "step").agg((F.count("*") > 40).alias("used"))
    return K.pick_fresh(m, ["mode"], "step", 6)


# ---- text and JSON ----------------------------------------------------------------------

@check("stable_json_signature", """select l_orderkey, l_linenumber, 'S' || (l_partkey % 40) || '|{' || concat_ws(',', case when l_returnflag <> 'N' then '"flag":"' || l_returnflag || '"' end,
 case when l_quantity <> 10 then '"q":"' || cast(l_quantity as int) || '"' end) || '}' as signature from lineitem""")
def _signature(spark, d):
    li = V.table(spark, d, "lineitem")
    opts = F.create_map(F.lit("q"), F.col("l_quantity").cast("int").cast("string"), F.lit("_ui"), F.lit("x"), F.lit("flag"), F.col("l_returnflag"))
    defaults = F.create_map(F.lit("q"), F.lit("10"), F.lit("flag"), F.lit("N"))
    name = F.concat(F.lit("S"), F.pmod("l_partkey", F.lit(40)).cast("string"))
    return li.select("l_orderkey", "l_linenumber", K.signature(name, opts, defaults).alias("signature"))


@check("catalogue_text_search", "select p_partkey, p_name, p_brand, p_type from part where lower(p_brand) = (select lower(min(p_brand)) from part) and contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'e')")
def _search(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    first = p.agg(F.min("p_brand")).first()[0]
    return K.search(p, category=f"  {first.upper()} ", query=" E ", columns=("p_name", "p_brand", "p_type"), category_column="p_brand")


def _kw(col, fam):
    return f"regexp_matches(lower({col}), '{'|'.join(K.KEYWORDS[fam])}')"


def _kscore(kind, col="text"):
    return "cast(2 + " + " + ".join(f"case when {_kw(col, fam)} then {n} else 0 end" for fam, n in K.METRIC_BONUS[kind].items()) + " as int)"


@check("parameter_keyword_score", f"select doc_id, {', '.join(f'{_kscore(k)} as {k}' for k in K.METRIC_BONUS)} from documents")
def _score(spark, d):
    t = V.table(spark, d, "documents")
    return t.select("doc_id", *[K.metric_score(k, F.col("text")).alias(k) for k in K.METRIC_BONUS])


@check("share_string_zlib_base64url_json", "select doc_id, md5(text) as digest, length(text) as n from documents")
def _share(spark, d):
    t = V.table(spark, d, "documents").select("doc_id", MD.encode_share(F.col("text")).alias("s"))
    t = t.select("doc_id", MD.decode_share(F.col("s")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("bigint").alias("n"))


_kk = "cast(json_extract(props, '$.k') as int)"


@check("curve_control_points_parse", f"""select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then '0:0,255:255' when event_id % 5 = 0 then '0:128,255:255'
 else '0:' || {J('event_id % 300 + 0.4')} || ',' || '64:' || {_kk} || ',200:91,255:91' end as points from events where event_id % 13 <> 0
 union all select event_id, '0:' || {_kk} || ',64:' || {_kk} || ',200:91,255:91' from events where event_id % 13 = 0 and event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 5 <> 0
 union all select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then '0:0,255:255' else '0:128,255:255' end from events where event_id % 13 = 0 and (event_id % 7 = 0 or event_id % 11 = 0 or event_id % 5 = 0)""".replace(
    J('event_id % 300 + 0.4'), f"least(255, {J('event_id % 300 + 0.4')})"))
def _points(spark, d):
    k = F.get_json_object("props", "$.k")
    i = F.col("event_id")
    first = F.when(i % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("[0,"), (i % 300).cast("string"), F.lit(".4],")))
    text = (F.when(i % 7 == 0, F.lit("oops")).when(i % 11 == 0, F.lit("[[5,5]]")).when(i % 5 == 0, F.lit("[[1,1],[0,0.5]]"))
            .otherwise(F.concat(F.lit("[[200,90.6],"), first, F.lit("[64,"), k, F.lit("]]"))))
    pts = MD.control_points(text)
    return V.table(spark, d, "events").select("event_id", F.array_join(F.transform(
        pts, lambda p: F.concat_ws(":", p["x"], p["y"])), ",").alias("points"))


# ---- scalar functions -------------------------------------------------------------------

def scalar(name, sql_cols, build, pre=CARRIER):
    cols = ", ".join(f"round({e}, 6) as {c}" for c, e in sql_cols.items())
    check(name, f"select l_orderkey, l_linenumber, {cols} from {pre} p")(
        lambda spark, d: build(V.channel_carrier(spark, d)).select(
            "l_orderkey", "l_linenumber", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in sql_cols]))


def dbl(cols):
    return {c: f"cast({e} as double)" for c, e in cols.items()}


scalar("srgb_to_linear", {f"l{c}": lin(c) for c in "rgb"}, lambda d: d.withColumns({f"l{c}": C.srgb_to_linear(C.unit(c)) for c in "rgb"}))
scalar("linear_to_srgb", {f"s{c}": unlin(f"({c} / 255.0)") for c in "rgb"}, lambda d: d.withColumns({f"s{c}": C.linear_to_srgb(C.unit(c)) for c in "rgb"}))
scalar("rgba_to_hsva", {"h": "h", "s": "s", "v": "v", "alpha": "a / 255.0"}, lambda d: C.with_hsv(
    d, *(C.unit(c) for c in "rgb"), h="h", s="s", v="v").withColumn("alpha", C.unit("a")), pre=HSV)
scalar("rgba_to_lab", {"l": "ll", "la": "la", "lb": "lb"}, lambda d: d.withColumns(
    dict(zip(("l", "la", "lb"), C.lab("r", "g", "b").values()))), pre=LAB)


@check("buffer_linearise_delinearise", f"select clip_id, frame, x, y, r, g, b, a from {RASTER} p")
def _buffer(spark, d):
    """Whole-frame arrays to linear light and back; the round trip is exact."""
    back = F.transform(F.transform("q", lambda v: C.srgb_to_linear(v / 255.0)), lambda v: C.from_unit(C.linear_to_srgb(v)))
    return V.explode_pixels(V.frame_vectors(spark, d).withColumn("q", back))


@check("lab_to_rgba", carrier_sql("r", "g", "b"))
def _lab_back(spark, d):
    """RGB to Lab and back is the identity on 8-bit colours."""
    px = V.channel_carrier(spark, d).withColumns(dict(zip(("_l", "_la", "_lb"), C.lab("r", "g", "b").values())))
    return px.withColumns(dict(zip("rgb", C.lab_to_rgb(F.col("_l"), F.col("_la"), F.col("_lb"))))).drop("_l", "_la", "_lb")


@check("hsv_to_rgb", carrier_sql(*[FU(e) for e in SECTORS], pre=from_hsv(
    f"(select l_orderkey, l_linenumber, a, r * 1.4117 as h, g / 255.0 as s, b / 255.0 as v from {CARRIER} q)")))
def _hsv_back(spark, d):
    px = V.channel_carrier(spark, d).withColumns({"_h": F.col("r") * 1.4117, "_s": C.unit("g"), "_v": C.unit("b")})
    return C.with_hsv_as_rgb(px).drop("_h", "_s", "_v")


_pal0 = T.GAMEBOY


@check("linear_light_palette_match", f"""select l_orderkey, l_linenumber, {', '.join(f'round({lin(c)}, 6) as l{c}' for c in 'rgb')} from ({nearest_sql(_pal0, CARRIER, keys='l_orderkey, l_linenumber')}) q""")
def _linear_match(spark, d):
    from rasterloom.operators.nearest import linear_light_match
    px = V.channel_carrier(spark, d).withColumns({f"l{c}": C.srgb_to_linear(C.unit(c)) for c in "rgb"})
    return linear_light_match(px, _pal0).select("l_orderkey", "l_linenumber", *[F.round(f"l{c}", 6).alias(f"l{c}") for c in "rgb"])


_h0, _s0, _v0 = C.python_hsv((200, 100, 50))
_l0 = C.python_lab((200, 100, 50))
_dhh = f"(least(abs(h - {_h0!r}), 360 - abs(h - {_h0!r})) / 180)"


@check("colour_distance", f"""select q.l_orderkey, q.l_linenumber, round(cast((r - 200) * (r - 200) + (g - 100) * (g - 100) + (b - 50) * (b - 50) as double), 6) as rgb,
 round((2 + (r + 200) / 2.0 / 256) * (r - 200) * (r - 200) + 4 * (g - 100) * (g - 100) + (2 + (255 - (r + 200) / 2.0) / 256) * (b - 50) * (b - 50), 6) as approx,
 round({_dhh} * {_dhh} + (s - {_s0!r}) * (s - {_s0!r}) + (v - {_v0!r}) * (v - {_v0!r}), 6) as hsv,
 round({_dhh} * {_dhh} + (s - {_s0!r}) * (s - {_s0!r}) + (v - {_v0!r}) / 255.0 * ((v - {_v0!r}) / 255.0), 6) as hsv_legacy,
 round((ll - {_l0[0]!r}) * (ll - {_l0[0]!r}) + (la - {_l0[1]!r}) * (la - {_l0[1]!r}) + (lb - {_l0[2]!r}) * (lb - {_l0[2]!r}), 5) as lab
 from (select h1.*, ll, la, lb from (select *, row_number() over (order by l_orderkey, l_linenumber, r, g, b) as k from {HSV} h0) h1
  join (select row_number() over (order by l_orderkey, l_linenumber, r, g, b) as k, ll, la, lb from {LAB} l0) l1 using (k)) q""")
def _distance(spark, d):
    ref, out = (200, 100, 50), V.channel_carrier(spark, d)
    for name, algo, kw in (("rgb", "RGB", {}), ("approx", "RGB_APPROX", {}), ("hsv", "HSV", {}), ("hsv_legacy", "HSV", {"hsv_legacy": True}), ("lab", "LAB", {})):
        out, here = C.with_features(out, algo)
        out = out.withColumn(name, F.round(C.feature_distance(here, C.literal_features(ref, algo), algo, **kw), 5 if algo == "LAB" else 6)).drop("_f0", "_f1", "_f2")
    return out.select("l_orderkey", "l_linenumber", "rgb", "approx", "hsv", "hsv_legacy", "lab")


def _n(c):
    return f"({c} / 255.0 - 0.5)"


scalar("contrast_brightness_gamma", {
    **{f"c{c}": f"({_n(c)} + 0.8 * ({_n(c)} - 1) * {_n(c)} * ({_n(c)} - 0.5) + 0.5) * 255" for c in "rgb"},
    **{f"b{c}": f"{c} * 1.3 + 12" for c in "rgb"}, **{f"g{c}": f"255 * pow({c} / 255.0, 1 / 2.2)" for c in "rgb"}},
    lambda d: d.withColumns({
        **{f"c{c}": (C.unit(c) - 0.5 + (C.unit(c) - 1.5) * 0.8 * (C.unit(c) - 0.5) * (C.unit(c) - 1.0) + 0.5) * 255.0 for c in "rgb"},
        **{f"b{c}": F.col(c) * 1.3 + 12.0 for c in "rgb"}, **{f"g{c}": F.pow(C.unit(c), F.lit(1 / 2.2)) * 255.0 for c in "rgb"}}))


@check("add_sub_scale_vectors", """select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (cast(embedding[i] as double) + embedding[65 - i]) * i)), 4) as added,
 round(list_sum(list_transform(range(1, 65), lambda i: (cast(embedding[i] as double) - embedding[65 - i]) * i)), 4) as subtracted, round(list_sum(list_transform(embedding, lambda e: cast(e as double) * 2.5)), 4) as scaled from embeddings""")
def _vector_maths(spark, d):
    v = F.transform("embedding", lambda e: e.cast("double"))

    def weighted(a):
        return F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    e = V.table(spark, d, "embeddings").select("vec_id", v.alias("v"), F.reverse(v).alias("w"))
    return e.select("vec_id", F.round(weighted(F.zip_with("v", "w", lambda a, b: a + b)), 4).alias("added"),
                    F.round(weighted(F.zip_with("v", "w", lambda a, b: a - b)), 4).alias("subtracted"),
                    F.round(F.aggregate(F.transform("v", lambda x: x * 2.5), F.lit(0.0), lambda s, x: s + x), 4).alias("scaled"))


@check("scalematrix_null_preserving", """select event_id, round(value * 0.25, 6) as m00, round(cast(null as double), 6) as m01, round(case when event_id % 3 = 0 then null else cast(event_id as double) * 0.25 end, 6) as m10, 0.0 as m11 from events""")
def _scale_matrix(spark, d):
    m = F.array(F.array(F.col("value"), F.lit(None).cast("double")), F.array(F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("double")), F.lit(0.0)))
    s = F.transform(m, lambda row: F.transform(row, lambda v: v * 0.25))
    e = V.table(spark, d, "events").select("event_id", s.alias("s"))
    return e.select("event_id", *[F.round(F.col("s")[i][j], 6).alias(f"m{i}{j}") for i in (0, 1) for j in (0, 1)])


@check("clamp", "select event_id, round(greatest(20.0, least(200.0, value)), 6) as v, round(case when event_id % 4 = 0 then null else greatest(20.0, least(200.0, value)) end, 6) as nullable from events")
def _clamp(spark, d):
    v = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    return V.table(spark, d, "events").select("event_id", F.round(C.clamp(20, 200, F.col("value")), 6).alias("v"),
                                              F.round(F.when(v.isNotNull(), C.clamp(20, 200, v)), 6).alias("nullable"))


@check("tile_hash", f"select p.*, {tile_hash_sql('x // 2', 'y // 2')} as hash from {RASTER} p")
def _tile_hash(spark, d):
    from rasterloom.operators.temporal import tile_hash
    return V.raster_px(spark, d).withColumn("hash", tile_hash(F.floor(F.col("x") / 2), F.floor(F.col("y") / 2)))


# ---- chains -----------------------------------------------------------------------------

def _sol(c):
    return f"(case when {c} > 96 then 255 - {c} else {c} end)"


_chain3 = [("invert", {}), ("posterize", {"levels": 5}), ("solarize", {"threshold": 96})]
on_raster("chain_fold", lambda df: CH.apply_chain(df, [_chain3[0], CH.Step("sepia", {}, enabled=False), *_chain3[1:]]),
          raster_sql(*[f"{_sol('(' + QL(f'(255 - {c})', 5) + ')')}" for c in "rgb"]))
_gk = ST.kernel_offsets(ST.KERNELS["GAUSSIAN_3X3"])
on_frames("offline_chain_render", lambda df: CH.apply_chain(df, [("convolve", {}), ("grayscale", {}), ("flip", {})], **SIZE),
          f"""with b as (select p.clip_id, p.frame, p.x, p.y, {chans(U8S('sum(h.{c} * o.w)'))}, p.a from {taps_sql(_gk, 'dx, dy, w')} group by p.clip_id, p.frame, p.x, p.y, p.a)
 select clip_id, frame, 7 - x as x, y, {J('(r + g + b) / 3.0')} as r, {J('(r + g + b) / 3.0')} as g, {J('(r + g + b) / 3.0')} as b, a from b""")


@check("filter_function_contract", raster_sql("b", "r", "g"))
def _contract(spark, d):
    """A user's own DataFrame function, registered and run by name."""
    CH.register("swap_channels", lambda df: df.select("clip_id", "frame", "x", "y", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), "a"))
    return CH.apply_chain(V.raster_px(spark, d), ["swap_channels"])


@check("option_schema", f"""select l_orderkey, l_linenumber, case when r / 10.0 between 2 and 32 then 'ok' else 'bad' end as posterize_levels, case when (g - 100) / 10.0 between -40 and 40 then 'ok' else 'bad' end as contrast,
 case when b % 4 < 3 then 'ok' else 'bad' end as flip_mode from {CARRIER} p""")
def _schema(spark, d):
    """Option values held in a table, checked against the operators' own schemas."""
    def verdict(op, option, v):
        o = CH.REGISTRY[op].options[option]
        good = v.isin(*o.values) if o.kind == "ENUM" else v.between(o.low, o.high)
        return F.when(good, "ok").otherwise("bad")
    modes = F.element_at(F.array(*[F.lit(m) for m in ("HORIZONTAL", "VERTICAL", "BOTH", "SIDEWAYS")]), F.pmod("b", F.lit(4)) + 1)
    return V.channel_carrier(spark, d).select("l_orderkey", "l_linenumber", verdict("posterize", "levels", F.col("r") / 10.0).alias("posterize_levels"),
                                              verdict("brightness_contrast", "contrast", (F.col("g") - 100) / 10.0).alias("contrast"),
                                              verdict("flip", "mode", modes).alias("flip_mode"))


@check("step_output_cache", raster_sql(*[f"{_sol('(' + QL(f'(255 - {c})', 5) + ')')}" for c in "rgb"])
       + " union all " + raster_sql(*[f"255 - ({QL(f'(255 - {c})', 5)})" for c in "rgb"]))
def _cache(spark, d):
    """Two chains restart from the same kept step."""
    keep = {"posterize": None}
    first = CH.apply_chain(V.raster_px(spark, d), _chain3, keep=keep)
    second = CH.apply_chain(keep["posterize"], [("invert", {})])
    return first.unionByName(second)


@check("random_options", f"select * from ({' union all '.join(raster_sql(*[QL(c, n) for c in 'rgb']).replace('select ', f'select {i} as variant, ', 1) for i, n in enumerate((2, 4, 6, 8)))}) z")
def _sweep(spark, d):
    grid = CH.option_grid({"levels": (2, 8, 2)})
    return CH.sweep(V.raster_px(spark, d), lambda p: [("posterize", {"levels": int(p["levels"])})], grid)
