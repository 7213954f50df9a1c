"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / w: u is a hash of the document in (0, 1], w its
quality weight.  Within a source the smallest keys come first.  A source whose
target is e whole sizes and a fraction gives e complete epochs of all its documents,
then documents in key order until the prefix sum of their words reaches the rest of
the budget; the document across the border is taken if more than half of it fits.

A source may hold most rows, so nothing sorts a source in one task: keys fall into
buckets, prefix sums run over bucket totals, and only the one bucket per source in
which the budget ends is sorted.  What comes out is one cut (key, tie) per source,
so the choice is a predicate on a row and texts are never shuffled.

Defined cases: a null text has no words and the least weight; a null source is a source
of its own, the last one; rows equal in id and text have one key and are taken or left
together; an empty table gives an empty mix; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import WORD, dimension_join, staged, word_array

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, STOP, LEAST_WEIGHT = 1.5, 2.0, 0.05
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
KEYS = ("mix_size", "mix_key", "mix_tie")


def letter_share(text: Column) -> Column:
    """Quality weight: letters among the characters of the words, from 0.05 to 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), letters / F.nullif(solid, F.lit(0))), F.lit(LEAST_WEIGHT))


def with_keys(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", weight: Column | None = None) -> DataFrame:
    """Add mix_size (words), mix_key and mix_tie."""
    t = F.col(text)
    tie = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(t, F.lit("")))))
    u = (F.conv(F.substring("mix_tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return (docs.withColumn("mix_size", F.when(t.isNull(), 0).otherwise(F.size(word_array(t))).cast("long"))
            .withColumn("mix_tie", tie)
            .withColumn("mix_key", -F.log(u) / (letter_share(t) if weight is None else weight)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, stop: float = STOP) -> DataFrame:
    """Per source its target: one level for all weights, each target stopped at `stop` sizes.

    The level that uses up the total is found in closed form, in the order in which rising
    water would stop the sources; this is where resharing the excess by weight ends.
    One row per source; no document goes through here.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    by_name, every = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy()
    rising = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    d = (sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", w)
         .withColumn("_stop", F.col("source_size") * F.lit(float(stop))).withColumn("_ratio", F.col("_stop") / F.col("_w"))
         .withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("_gone", F.coalesce(F.sum("_stop").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_open", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("_level", (F.col("_total") - F.col("_gone")) / F.col("_open"))
         .withColumn("_at", F.row_number().over(rising)))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(every)["_level"]
    level = F.coalesce(level, F.lit(float("inf")))
    return d.withColumn("target", F.least("_stop", level * F.col("_w"))).select("source", "source_size", "target")


def cuts(keyed: DataFrame, **options) -> DataFrame:
    """Per source: source_size, target, epochs and the last (key, tie) that the fraction takes.

    `keyed` has source and the columns of with_keys, and should be staged: it is read a few times.
    """
    buckets = LEAST_BUCKETS + keyed.count() // BUCKET_ROWS
    k = keyed.select("source", *KEYS).withColumn("_b", F.floor(F.lit(float(buckets)) * F.col("mix_key") / (F.col("mix_key") + 1)))
    last = F.struct("mix_key", "mix_tie")
    totals = staged(k.groupBy("source", "_b").agg(F.sum("mix_size").alias("_n"), F.max(last).alias("_last")))
    goals = (targets(totals.groupBy("source").agg(F.sum("_n").alias("source_size")), **options)
             .withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int"))
             .withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    run = (totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
           .withColumn("_earlier", F.max("_last").over(before))
           .join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
           .filter((F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + F.col("_n"))))
    border = staged(run.select("source", "_b", "_before", "_budget", "_earlier"))
    in_border = dimension_join(
        k, border.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), "_before", "_budget"),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb")))
    w = Window.partitionBy("source").orderBy("mix_key", "mix_tie")
    taken = (in_border.groupBy("source", "mix_key", "mix_tie", "_before", "_budget").agg(F.sum("mix_size").alias("_n"))
             .withColumn("_half", F.col("_before") + F.sum("_n").over(w) - F.col("_n") / 2)
             .filter(F.col("_half") <= F.col("_budget")).groupBy("source").agg(F.max(last).alias("_cut")))
    ends = (border.select("source", "_earlier").join(taken.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
            .select(F.col("source").alias("_s"), F.coalesce("_cut", "_earlier").alias("_cut")))
    return goals.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", F.col("epochs").alias("mix_epochs"), F.col("_cut").alias("mix_cut"))


def take(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, copies (how often the mix takes the row) and taken (words); columns of these names are replaced."""
    within = F.struct("mix_key", "mix_tie") <= F.col("mix_cut")
    own = [c for c in keyed.columns if c.lower() not in ("source_size", "target", "copies", "taken")]
    d = dimension_join(keyed.select(*[F.col(f"`{c}`") for c in own]), plan, F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return (d.withColumn("copies", F.col("mix_epochs") + F.coalesce(within, F.lit(False)).cast("int"))
            .withColumn("taken", F.col("copies") * F.col("mix_size")).drop("mix_cut", "mix_source", "mix_epochs"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of `docs`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row"), "doc_id", "text", "source")
    keyed = with_keys(rows)
    plan = staged(cuts(staged(keyed.select("source", *KEYS)), **options))
    return (take(keyed, plan).filter("copies > 0")
            .select("doc_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc_row.*"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    keyed = staged(with_keys(docs).select("doc_id", "source", *KEYS))
    out = take(keyed, staged(cuts(keyed)))
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken", "copies")


OP1_SQL = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
  md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as tie,
  coalesce(greatest(0.05e0, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) /
   nullif(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0)::double), 0.05e0) as w
 from documents),
k as (select doc_id, source, size, tie, -ln((('0x' || substr(tie, 1, 13))::bigint::double + 0.5e0) / 4503599627370496e0) / w as key from d),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as r from k group by source),
sw as (select *, case r % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w, source_size * 2e0 as stop from s),
lv as (select *, stop / w as ratio, (1.5e0 * (select sum(source_size) from s)
   - coalesce(sum(stop) over (order by stop / w, source is null, source rows between unbounded preceding and 1 preceding), 0e0))
   / sum(w) over (order by stop / w, source is null, source rows between current row and unbounded following) as level,
  row_number() over (order by stop / w, source is null, source) as nth from sw),
g as (select source, source_size, least(stop, w * (select min_by(level, nth) from lv where level <= ratio)) as target from lv),
e as (select *, coalesce(floor(target / nullif(source_size, 0)), 0) as epochs from g),
p as (select k.doc_id, size, source_size, target, epochs, target - epochs * source_size as budget,
  sum(size) over (partition by k.source order by key, tie) as run,
  sum(size) over (partition by k.source, key, tie) as own
 from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (epochs + (run - own / 2e0 <= budget)::int))::bigint as taken,
 (epochs + (run - own / 2e0 <= budget)::int)::int as copies from p
"""
