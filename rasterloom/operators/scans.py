"""Recurrences over keys of any length, by chunks of their rows.

Where the effect of a chunk on the state is a small map (a clamped line, a table from entry to
exit), every chunk is summarised on its own, the maps are composed in a tree of bounded fan-out,
and every chunk then works out its rows from its own entry state.  Where it is not, chunks start
from a guess that a stretch of rows before them suggests, and only those whose real entry state
turns out to differ run again, until none does.  No task holds more than a chunk of one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.operators.lineage import cut_lineage
from rasterloom.operators.ordered import chunked, shuffled_join

CHUNK, FAN, WARM = 1024, 64, 64


def scan(parts: DataFrame, keys: list[str], index: str, compose: Callable[[Column, Column], Column], *, fan: int = FAN) -> DataFrame:
    """`(keys, index, before)`: the composed maps of all parts of the key before each one, null before the first.

    `parts` has one row `(keys, index, m)` a chunk; `compose(first, then)` gives a map of m's type.
    A level unites `fan` neighbours, so a key of n chunks takes log(n) / log(fan) levels up and down.
    """
    parts = cut_lineage(parts.select(*keys, F.col(index).cast("long").alias("_i"), "m"))
    levels, most = [parts], parts.agg(F.max("_i")).first()[0] or 0
    kind = parts.schema["m"].dataType.simpleString()
    none = F.lit(None).cast(kind)

    def then(first: Column, m: Column) -> Column:
        return F.when(first.isNull(), m).when(m.isNull(), first).otherwise(compose(first, m))

    def together(level: DataFrame) -> DataFrame:
        return level.groupBy(*keys, F.floor(F.col("_i") / fan).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_i", "m"))).alias("_l"))

    while most >= fan:
        up = together(levels[-1]).select(*keys, F.col("_g").alias("_i"), F.aggregate("_l", none, lambda acc, x: then(acc, x["m"])).alias("m"))
        levels.append(cut_lineage(up))
        most //= fan
    before = None
    for level in reversed(levels):
        groups = together(level)
        groups = groups.withColumn("_b", none) if before is None else shuffled_join(
            groups, before.select(*keys, F.col("_i").alias("_g"), F.col("before").alias("_b")), [*keys, "_g"], "left")
        own = F.transform("_l", lambda x, at: F.struct(
            x["_i"].alias("_i"), F.aggregate(F.slice("_l", 1, at), F.col("_b"), lambda acc, y: then(acc, y["m"])).alias("before")))
        before = groups.select(*keys, F.inline(own))
    return before.select(*keys, F.col("_i").alias(index), "before")


@dataclass
class Decay:
    """`y = min(limit, keep * y_prev + add)`, or the greater of the two; the first row of a key has `start`."""
    keep: float
    add: Column
    limit: Column
    start: Column
    upper: bool = True


def bounded_decay(df: DataFrame, keys: list[str], pos: str, outs: dict[str, Decay], *, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Add the state after each row as `outs`' names; `pos` numbers a key's rows from 0 without gaps.

    Maps x -> min(c, a x + b) with a > 0 are closed under composition.  Inside a chunk they are
    running sums and minima: with k rows since the entry, s the sum of add / keep^i and m the least
    limit / keep^i - s_i, the state is keep^k * min(entry + s, m + s).
    """
    chunk = min(chunk, *(max(1, int(230 / -math.log(o.keep))) for o in outs.values()))   # keep^-k stays finite
    by, w = [*keys, "_chunk"], Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    first, d = F.col(pos) == 0, df.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("long"))
    d = d.withColumn("_k", F.col(pos) - F.col("_chunk") * chunk + (F.col("_chunk") > 0).cast("int"))

    def shrink(o: Decay) -> Column:
        return F.pow(F.lit(o.keep), F.col("_k").cast("double"))

    sign = {n: 1.0 if o.upper else -1.0 for n, o in outs.items()}
    d = d.withColumns({f"_s_{n}": F.sum(F.when(first, 0.0).otherwise(o.add * sign[n]) / shrink(o)).over(w) for n, o in outs.items()})
    d = d.withColumns({f"_m_{n}": F.min(F.when(first, float("inf")).otherwise(o.limit * sign[n]) / shrink(o) - F.col(f"_s_{n}")).over(w) for n, o in outs.items()})
    d = d.withColumns({f"_x_{n}": F.when(first, o.start * sign[n]) for n, o in outs.items()})

    def after(entry: Column, n: str) -> Column:
        return shrink(outs[n]) * (F.least(entry, F.col(f"_m_{n}")) + F.col(f"_s_{n}"))

    last = d.groupBy(*by).agg(F.max_by(F.struct("_k", *[f"_{p}_{n}" for n in outs for p in "sm"]), pos).alias("_e"),
                              *[F.max(f"_x_{n}").alias(f"_x_{n}") for n in outs])
    last = last.select(*by, "_e.*", *[f"_x_{n}" for n in outs])
    maps = F.struct(*[F.struct(
        F.when(F.col(f"_x_{n}").isNull(), shrink(o)).otherwise(0.0).alias("a"),
        F.when(F.col(f"_x_{n}").isNull(), shrink(o) * F.col(f"_s_{n}")).otherwise(after(F.col(f"_x_{n}"), n)).alias("b"),
        F.when(F.col(f"_x_{n}").isNull(), shrink(o) * (F.col(f"_m_{n}") + F.col(f"_s_{n}"))).otherwise(float("inf")).alias("c")).alias(n)
        for n, o in outs.items()])

    def compose(f: Column, g: Column) -> Column:
        return F.struct(*[F.struct((f[n]["a"] * g[n]["a"]).alias("a"), (f[n]["b"] * g[n]["a"] + g[n]["b"]).alias("b"),
                                   F.least(g[n]["c"], F.when(g[n]["a"] > 0, f[n]["c"] * g[n]["a"] + g[n]["b"]).otherwise(float("inf"))).alias("c")).alias(n) for n in outs])

    entries = scan(last.select(*by, maps.alias("m")), keys, "_chunk", compose, fan=fan)
    starts = last.where("_chunk = 0").select(*keys, F.struct(*[F.col(f"_x_{n}").alias(n) for n in outs]).alias("_start"), F.lit(0).cast("long").alias("_chunk"))
    entries = entries.join(starts, [*keys, "_chunk"], "left").select(*by, *[
        F.coalesce(F.least(F.col("before")[n]["b"], F.col("before")[n]["c"]), F.col("_start")[n]).alias(f"_in_{n}") for n in outs])
    j = shuffled_join(d, entries, by)
    j = j.withColumns({n: after(F.col(f"_in_{n}"), n) * sign[n] for n in outs})
    return j.drop("_chunk", "_k", *[f"_{p}_{n}" for n in outs for p in ("s", "m", "x", "in")])


# ---- speculation ---------------------------------------------------------------------------

def _walk(rows: DataFrame, keys: list[str], pos: str, inputs: list[str], step: Callable, chunk: int, outputs: dict[str, str] | None) -> DataFrame:
    """Walk every chunk of `rows` from `_entry` (null: from nothing); rows before its own only lead up to it.

    Gives each row's outputs, or, without outputs, a chunk's `_entry` and `_exit`.
    """
    names = list(outputs or {})
    if outputs is None:
        schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("_chunk bigint, _entry array<double>, _exit array<double>").fields])
    else:
        schema = StructType([f for f in rows.schema.fields if f.name != "_entry"] + StructType.fromDDL(", ".join(f"{n} {t}" for n, t in outputs.items())).fields)

    def packed(state):
        return None if state is None else [float(x) for x in state]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, entered, own = None, None, None, False
        ends = []
        for pdf in batches:
            out = []
            for key, at, entry, row in zip(zip(*(pdf[k] for k in keys), pdf["_chunk"]), pdf[pos], pdf["_entry"], zip(*(pdf[c] for c in inputs))):
                if key != current:
                    if current is not None:
                        ends.append((*current, packed(entered), packed(state)))
                    current, own = key, False
                    state = None if entry is None else tuple(entry)
                if not own and at >= key[-1] * chunk:
                    own, entered = True, state
                state, values = step(state, *row)
                out.append(values)
            if outputs is not None:
                yield pdf.drop(columns="_entry").assign(**{n: [v[i] for v in out] for i, n in enumerate(names)})
        if outputs is None:
            if current is not None:
                ends.append((*current, packed(entered), packed(state)))
            yield pd.DataFrame(ends, columns=[*keys, "_chunk", "_entry", "_exit"])

    return rows.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", pos).mapInPandas(run, schema)


def fold_chunks(df: DataFrame, keys: list[str], pos: str, inputs: list[str], outputs: dict[str, str], step: Callable, *,
                chunk: int = CHUNK, warm: int = WARM, near: float = 0.0, rounds: list | None = None) -> DataFrame:
    """Add `outputs` (name -> type) by `state, values = step(state, *inputs)`; `pos` numbers a key's rows from 0.

    A state is a tuple of numbers, None at first.  Chunks guess theirs by walking `warm` rows
    before them; those whose guess differs (by more than `near` of the value) from what the chunk
    before hands on run again.  A chunk is right after as many rounds as it has predecessors,
    most are at once; `rounds` collects how many ran again in each.
    """
    by = [*keys, "_chunk"]
    rows = cut_lineage(df.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("long")))
    none = F.lit(None).cast("array<double>")
    lead = chunked(rows.select(*keys, pos, *[c for c in inputs if c not in keys and c != pos]), pos, chunk, warm).withColumn("_entry", none)
    known = cut_lineage(_walk(lead, keys, pos, inputs, step, chunk, None))
    while True:
        handed = known.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_exit").alias("_real"))
        differs = F.exists(F.zip_with("_entry", "_real", lambda a, b: F.abs(a - b) > F.greatest(F.lit(1.0), F.abs(b)) * near), lambda x: x)
        wrong = cut_lineage(shuffled_join(known, handed, by).where(F.coalesce(differs, F.lit(True))).select(*by, F.col("_real").alias("_entry")))
        n = wrong.count()
        if rounds is not None:
            rounds.append(n)
        if not n:
            break
        again = _walk(shuffled_join(rows, wrong, by), keys, pos, inputs, step, chunk, None)
        known = cut_lineage(known.join(wrong.select(*by).hint("merge"), by, "left_anti").unionByName(again))
    entered = shuffled_join(rows, known.select(*by, "_entry"), by)
    return _walk(entered, keys, pos, inputs, step, chunk, outputs).drop("_chunk")
