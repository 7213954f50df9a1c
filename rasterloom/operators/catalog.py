"""Chains, presets and catalogues: arrays of steps, option maps, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.operators.lineage import cut_lineage
from rasterloom.operators.ordered import shuffled_join, spread

MAX_CHAIN = 16

STATE_V2 = T.StructType([
    T.StructField("v", T.IntegerType()),
    T.StructField("chain", T.ArrayType(T.StructType([
        T.StructField("n", T.StringType()), T.StructField("d", T.StringType()),
        T.StructField("e", T.BooleanType()),
        T.StructField("o", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("selected", T.StringType()),
    T.StructField("g", T.BooleanType()), T.StructField("l", T.BooleanType())])


# ---- option maps ------------------------------------------------------------------------

def canonical(options: Column) -> Column:
    """Key-sorted JSON text of a map."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(options))))


def overrides(options: Column, defaults: Column) -> Column:
    """Options that differ from the default; keys starting with `_` are dropped."""
    return F.map_filter(options, lambda k, v: ~k.startswith("_") & ~v.eqNullSafe(F.try_element_at(defaults, k)))


def signature(name: Column, options: Column, defaults: Column) -> Column:
    return F.concat(name, F.lit("|"), canonical(overrides(options, defaults)))


def with_defaults(options: Column, defaults: Column) -> Column:
    """Missing options take their defaults."""
    missing = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(options, k))
    return F.map_concat(missing, options)


# ---- saved states -----------------------------------------------------------------------

def load_states(states: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Saved JSON states to steps.

    v2 documents hold a chain; v1 documents hold one selected step.  Steps not in
    the catalogue are dropped by the join, missing options take defaults.
    `catalogue(name, defaults)` is a dimension table; Catalyst broadcasts it by size.
    """
    d = states.withColumn("s", F.from_json("doc", STATE_V2))
    v1 = F.array(F.struct(F.col("s.selected").alias("n"), F.lit(None).cast("string").alias("d"),
                          F.lit(True).alias("e"), F.create_map().cast("map<string,string>").alias("o")))
    steps = d.select("state_id", F.posexplode(F.coalesce("s.chain", v1)).alias("pos", "step"))
    j = steps.join(catalogue, F.col("step.n") == F.col("name"))
    opts = F.coalesce(F.col("step.o"), F.create_map().cast("map<string,string>"))
    return j.select("state_id", "pos", "name", F.coalesce("step.d", "name").alias("display"),
                    F.coalesce("step.e", F.lit(True)).alias("enabled"),
                    with_defaults(opts, F.col("defaults")).alias("options"))


def export_states(steps: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Steps to delta-encoded JSON, one document per state (a chain holds at most 16 steps)."""
    j = steps.join(catalogue, "name")
    delta = overrides(F.col("options"), F.col("defaults"))
    entry = F.struct(F.col("name").alias("n"),
                     F.when(F.col("display") != F.col("name"), F.col("display")).alias("d"),
                     F.when(~F.col("enabled"), F.lit(False)).alias("e"),
                     F.when(F.size(delta) > 0, F.map_from_entries(F.array_sort(F.map_entries(delta)))).alias("o"))
    chain = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(entry).alias("j")))), lambda s: s["j"])
    return j.groupBy("state_id").agg(F.concat(F.lit('{"v":2,"chain":['), F.array_join(chain, ","), F.lit("]}")).alias("doc"))


# ---- chain edits on an array of steps -----------------------------------------------------

def chain_add(steps: Column, step: Column) -> Column:
    return F.when(F.size(steps) < MAX_CHAIN, F.array_append(steps, step)).otherwise(steps)


def chain_duplicate(steps: Column, at: int) -> Column:
    """Copy the entry at a 0-based position right after itself."""
    dup = F.concat(F.slice(steps, 1, at + 1), F.slice(steps, F.lit(at + 1), F.size(steps)))
    return F.when((F.size(steps) > at) & (F.size(steps) < MAX_CHAIN), dup).otherwise(steps)


def chain_remove(steps: Column, at: int) -> Column:
    """The last remaining entry stays."""
    cut = F.filter(steps, lambda _, i: i != at)
    return F.when(F.size(steps) > 1, cut).otherwise(steps)


def chain_replace(steps: Column, at: int, step: Column) -> Column:
    return F.transform(steps, lambda s, i: F.when(i == at, step).otherwise(s))


def chain_move(steps: Column, src: int, dst: int) -> Column:
    """Take an entry out and put it back at another position."""
    rest = F.filter(steps, lambda _, i: i != src)
    moved = F.concat(F.slice(rest, 1, dst) if dst else F.array().cast("array<string>"),
                     F.slice(steps, src + 1, 1), F.slice(rest, F.lit(dst + 1), F.size(rest)))
    return F.when(F.size(steps) > max(src, dst), moved).otherwise(steps)


def chain_toggle(entries: Column, name: Column) -> Column:
    """Flip `enabled` of the entries with a name."""
    return F.transform(entries, lambda e: F.struct(
        e["name"].alias("name"), F.when(e["name"] == name, ~e["enabled"]).otherwise(e["enabled"]).alias("enabled")))


# ---- presets ----------------------------------------------------------------------------

def duplicate_groups(presets: DataFrame) -> DataFrame:
    """Signatures shared by more than one preset, with how many and the first name.

    `presets(name, signature)`; counting keeps a hot signature cheap, and names
    are listed by joining back, one row per member.
    """
    return presets.groupBy("signature").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).where("n > 1")


def duplicate_members(presets: DataFrame) -> DataFrame:
    return presets.join(duplicate_groups(presets), "signature").select("first_name", "n", "name")


LEAD, CATEGORY, ORDERED, JACCARD = 0.15, 0.1, 0.25, 0.5   # fixed values: weights of the score
MOST_STEPS, MOST_KEYS, MOST_PLANS = 6, 64, 20_000
CASES = [(lead, category) for lead in (True, False) for category in (True, False)]


def subsets(items: Column, k: int) -> Column:
    """All k-subsets of an array, each in the array's order."""
    if k == 1:
        return F.transform(items, lambda x: F.array(x))
    return F.flatten(F.transform(items, lambda x, i: F.transform(
        subsets(F.slice(items, i + 2, F.greatest(F.lit(0), F.size(items) - i - 1)), k - 1), lambda rest: F.concat(F.array(x), rest))))


def similar_pairs(chains: DataFrame, *, threshold=0.85, limit: int | None = None, meet: float = 16.0) -> DataFrame:
    """Pairs of distinct chains with a high similarity.

    score = 0.5 Jaccard + 0.25 position match + 0.15 same lead + 0.1 same category.
    Equal chains (same steps and category) are one entry, named by their least
    id, with `copies`.

    Chains meet in four cases, by whether lead and category are equal; equal ones are part of the
    join key.  Case and sizes m <= n tell how many steps a pair must share at least.  If it shares o,
    then the first k steps that it shares, in order of rarity, stand among the first m - o + k of the
    one and n - o + k of the other, so every k-subset of these prefixes is a key; k is the least
    with which about `meet` chains are expected at a key, from the counts of the steps, at most
    MOST_STEPS and, beyond 3, no more than leaves a chain MOST_KEYS keys for a size it may meet.
    Chains of different lead never match in all positions, so a case that needs that is none.
    A pair counts at the key that is its first k common steps; a key that stays hot is left to the
    engine's splitting of skewed joins, as its members share those steps, the case and the sizes.
    """
    if threshold <= CATEGORY:
        raise ValueError("pairs without a common step reach 0.1: every pair is one")
    d = chains.where(F.size("steps") > 0).groupBy("steps", "category").agg(F.min("chain_id").alias("id"), F.count("*").alias("copies"))
    d = cut_lineage(spread(d, "id"))
    each = d.select("id", F.explode(F.array_distinct("steps")).alias("token"))
    counts = cut_lineage(each.groupBy("token").agg(F.count("*").alias("df")))
    ranked = shuffled_join(each, counts, "token").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("rare"))   # one chain's steps
    d = cut_lineage(shuffled_join(d, ranked, "id"))
    n, most, mean = d.agg(F.count("*"), F.max(F.size("rare")), F.avg(F.size("rare"))).first()
    if not n or not most:
        return d.select(F.col("id").alias("a"), F.col("id").alias("b"), *[F.lit(0.0).alias(c) for c in ("score", "jaccard", "ordered")],
                        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b")).limit(0)
    total, square = counts.agg(F.sum("df"), F.sum(F.col("df") * F.col("df"))).first()
    share = mean * square / total / total   # chance that a chain has a step, met as often as it occurs
    k_most = next((k for k in range(1, MOST_STEPS) if n * share ** k <= meet), MOST_STEPS)

    def needed(m: Column, n: Column, own: Column, rest: float) -> Column:
        """Least number of shared steps; `own` is the chain's excess of steps over different ones, `rest` what they must earn."""
        def reached(s: Column) -> Column:
            ordered = F.least(F.lit(1.0), (s + own) / F.greatest(m, n))
            return s / (m + n - s) * JACCARD + ordered * ORDERED - rest >= 0
        return F.get(F.filter(F.sequence(F.lit(1), F.least(m, n)), reached), F.lit(0))   # null where none is enough

    # keys follow from a chain's counts alone: they are found once for each pair of counts, as places in `rare`
    d = d.withColumns({"size": F.size("rare"), "own": F.size("steps") - F.size("rare")})
    shapes = cut_lineage(d.select("size", "own").distinct())
    sides = []
    for small in (True, False):
        parts = []
        for lead, category in CASES:
            # a different lead costs a position: a 4 n-th of the score, above 1e-7 for chains below two million steps
            rest = threshold - LEAD * lead - CATEGORY * category + (-1e-9 if lead else 1e-7)
            least = max(0.0, (rest - ORDERED) / JACCARD)   # Jaccard similarity, if all positions match
            if least > 1 + 1e-9:
                continue
            size = F.col("size")
            low = size if small else F.greatest(F.lit(1), F.ceil(size * least - 1e-9).cast("int"))
            high = (F.least(F.lit(most), F.floor(size / least + 1e-9).cast("int")) if least > 0 else F.lit(most)) if small else size
            x = shapes.where(low <= high).withColumn("_other", F.explode(F.sequence(low, high)))
            m, big = (size, F.col("_other")) if small else (F.col("_other"), size)
            fair = F.coalesce(needed(m, big, big, rest), F.lit(1))   # the same on both sides: with all positions matching
            x = x.withColumns({"_o": needed(m, big, F.col("own"), rest), "_fair": fair}).where("_o is not null")
            k, ways = F.lit(min(k_most, 3)), F.lit(1.0)
            for more in range(1, k_most + 1):   # subsets of `more` steps in the longer prefix
                ways = ways * (big - F.col("_fair") + more) / more
                if more > 3:
                    k = F.when(ways <= MOST_KEYS, more).otherwise(k)
            x = x.withColumn("_k", F.least("_fair", k))
            prefix = F.sequence(F.lit(0), F.least(size, size - F.col("_o") + F.col("_k")) - 1)
            picks = subsets(prefix, k_most)
            for k in range(k_most - 1, 0, -1):
                picks = F.when(F.col("_k") == k, subsets(prefix, k)).otherwise(picks)
            parts.append(x.select("size", "own", F.lit(lead).alias("lead"), F.lit(category).alias("same"), m.alias("m"), big.alias("n"), picks.alias("picks")))
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        plans = cut_lineage(union)
        x = d.join(plans.hint("broadcast" if plans.count() <= MOST_PLANS else "merge"), ["size", "own"])
        x = x.withColumn("pick", F.explode("picks")).withColumn("key", F.transform("pick", lambda i: F.get("rare", i)))
        where = [F.when(F.col("lead"), F.element_at("steps", 1)), F.when(F.col("same"), F.col("category"))]
        sides.append(x.select("id", "steps", "category", "rare", "copies", "lead", "same", "key", F.xxhash64("key", "lead", "same", "m", "n", *where).alias("meet")))
    a, b = (x.select("meet", *[F.col(c).alias(f"{n}_{c}") for c in x.columns if c != "meet"]) for n, x in zip("ab", sides))
    p = shuffled_join(a, b, "meet").where(
        ((F.size("a_rare") < F.size("b_rare")) | ((F.size("a_rare") == F.size("b_rare")) & (F.col("a_id") < F.col("b_id"))))
        & (F.col("a_lead") == F.col("b_lead")) & (F.col("a_same") == F.col("b_same")) & (F.col("a_key") == F.col("b_key"))
        & ((F.element_at("a_steps", 1) == F.element_at("b_steps", 1)) == F.col("a_lead"))
        & (F.col("a_category").eqNullSafe(F.col("b_category")) == F.col("a_same")))
    common = F.array_intersect("a_rare", "b_rare")
    p = p.where(F.slice(common, F.lit(1), F.size("a_key")) == F.col("a_key"))   # each pair once
    shared = F.size(common)
    p = p.withColumn("jaccard", shared / (F.size("a_rare") + F.size("b_rare") - shared))
    match = F.size(F.filter(F.arrays_zip("a_steps", "b_steps"), lambda z: z["a_steps"] == z["b_steps"]))
    p = p.withColumn("ordered", match / F.greatest(F.size("a_steps"), F.size("b_steps")))
    score = (F.col("jaccard") * JACCARD + F.col("ordered") * ORDERED + F.when(F.col("a_lead"), LEAD).otherwise(0.0)
             + F.when(F.col("a_same"), CATEGORY).otherwise(0.0))
    swap = F.col("a_id") > F.col("b_id")

    def side(name: str, first: bool) -> Column:
        x, y = (F.col(f"a_{name}"), F.col(f"b_{name}")) if first else (F.col(f"b_{name}"), F.col(f"a_{name}"))
        return F.when(swap, y).otherwise(x)
    out = p.withColumn("score", F.round(score, 9)).where(F.col("score") >= threshold).select(
        side("id", True).alias("a"), side("id", False).alias("b"), "score", F.round("jaccard", 9).alias("jaccard"),
        F.round("ordered", 9).alias("ordered"), side("copies", True).alias("copies_a"), side("copies", False).alias("copies_b"))
    return out.orderBy(F.col("score").desc(), "a", "b").limit(limit) if limit else out


# ---- search and scores ------------------------------------------------------------------

def search(df: DataFrame, *, category: str | None = None, query: str | None = None, columns=("name", "category", "description"),
           category_column="category") -> DataFrame:
    """Case-insensitive category equality and substring search over the text columns."""
    if category and category.strip():
        df = df.where(F.lower(F.col(category_column)) == category.strip().lower())
    if query and query.strip():
        hay = F.lower(F.concat_ws(" ", *columns))
        df = df.where(hay.contains(query.strip().lower()))
    return df


# Keyword families of option names.
KEYWORDS = {
    "transient": ["amount", "mix", "intensity", "strength", "threshold", "glitch", "noise", "contrast", "edge",
                  "detail", "sharpen", "poster", "posterize", "density", "count", "morph", "iterations", "spread",
                  "dust", "grit"],
    "heavy": ["size", "scale", "radius", "blur", "smear", "feedback", "decay", "persistence", "block", "pixel",
              "distort", "warp", "offset", "displace", "line", "scan", "depth", "rows", "cols", "grid", "cell",
              "tile", "chunk"],
    "tone": ["hue", "color", "palette", "gamma", "brightness", "saturation", "tone", "warm", "cool", "channel",
             "rgb", "contrast", "temperature", "lightness", "chroma", "tint", "shade", "value"],
    "flow": ["phase", "speed", "angle", "rotate", "offset", "scroll", "drift", "wave", "wobble", "frequency",
             "motion", "shift", "time", "step", "cycle", "sweep"],
    "noise": ["noise", "glitch", "detail", "edge", "grain", "jitter", "spark", "rough", "scratch", "hash",
              "fizz", "speckle"],
}

# Bonus per keyword family for each kind of metric.
METRIC_BONUS = {
    "beat": {"transient": 6, "heavy": 2},
    "bass": {"heavy": 7, "transient": 2},
    "treble": {"tone": 7, "transient": 1},
    "tempo": {"flow": 7, "heavy": 1},
    "roughness": {"noise": 7, "transient": 2},
    "stereo": {"flow": 3, "tone": 2, "heavy": 2},
    "mid": {"transient": 3, "heavy": 2, "tone": 2},
}


def keyword_hit(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def keyword_score(text: Column, bonuses: dict[str, int], base: int = 2) -> Column:
    """Base score plus a bonus per keyword family found in the text."""
    score = F.lit(base)
    for family, bonus in bonuses.items():
        score = score + F.when(keyword_hit(text, KEYWORDS[family]), bonus).otherwise(0)
    return score


def metric_score(metric_kind: str, text: Column) -> Column:
    """How well an option, named and labelled by `text`, suits a kind of metric."""
    return keyword_score(text, METRIC_BONUS[metric_kind])


def pick_fresh(metrics: DataFrame, group: list[str], name: str, n: int, *, seed: int = 0) -> DataFrame:
    """`n` members per group, unused ones first, then in hashed order (small dimension tables)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy("used", F.md5(F.concat(F.lit(f"{seed}:"), name)), name)
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_seen(df: DataFrame, keys: list[str], value: str, pos: str, skip: DataFrame) -> DataFrame:
    """Distinct values by first position, without the skip list."""
    return df.groupBy(*keys, value).agg(F.min(pos).alias("first_pos")).join(skip, value, "left_anti")


def greedy_pairs(scores: DataFrame, key: str, left: str, right: str, rounds: int) -> DataFrame:
    """Greedy best-score matching inside each key; equal scores go by a digest of the pair.

    A pair is taken in the round in which it is the best free one of both its sides, which gives
    what taking the best pair of the key again and again would give.  Matched rows leave by
    anti-join.  The best pair of a key goes in every round, so rounds are bounded by the number of
    lefts, a parameter.
    """
    rest, out = cut_lineage(scores.withColumn("_h", F.md5(F.concat_ws(":", left, right)))), None
    for _ in range(rounds):
        order = F.struct("score", "_h")
        by_left = rest.groupBy(key, left).agg(F.max_by(F.struct(right, "score"), order).alias("_w")).select(key, left, f"_w.{right}", "_w.score")
        by_right = rest.groupBy(key, right).agg(F.max_by(left, order).alias(left))
        won = cut_lineage(shuffled_join(by_left, by_right, [key, left, right]).select(key, left, right, "score"))
        out = won if out is None else out.unionByName(won)
        rest = cut_lineage(rest.join(won.select(key, left), [key, left], "left_anti").join(
            won.select(key, right), [key, right], "left_anti"))
        if rest.isEmpty():
            break
    return out
