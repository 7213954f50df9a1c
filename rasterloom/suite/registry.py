"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def as_double(sql: str) -> str:
    """Write plain decimal literals as doubles, so both engines use the same arithmetic."""
    return _DECIMAL.sub(r"\1e0", sql)


def check(name: str, sql: str | None = None):
    """Register a query; `sql` is its equivalent over the same tables."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = as_double(sql)
        return fn
    return wrap


# ---- SQL fragments shared by the checks -------------------------------------------------

def J(x: str) -> str:
    return f"cast(floor(({x}) + 0.5) as int)"


def U8(x: str) -> str:
    return J(f"least(greatest({x}, 0.0), 255.0)")


def U8S(x: str) -> str:
    """U8 with the upward tolerance used after recurrences."""
    return U8(f"({x}) + 0.000000001")


def FU(x: str) -> str:
    """Unit value to 8 bits."""
    return J(f"least(greatest({x}, 0.0), 1.0) * 255.0")


def CL(x: str, lo: str = "0.0", hi: str = "1.0") -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def SMOOTH(lo: str, hi: str, x: str) -> str:
    t = CL(f"(({x}) - ({lo})) / (({hi}) - ({lo}))")
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def MIX(a: str, b: str, t: str) -> str:
    return f"(({a}) * (1.0 - ({t})) + ({b}) * ({t}))"


L709 = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
L709U = "(0.2126 * (r / 255.0) + 0.7152 * (g / 255.0) + 0.0722 * (b / 255.0))"

CARRIER = """(select l_orderkey, l_linenumber, cast(l_partkey % 256 as int) as r,
 cast(cast(l_quantity * 5 as int) % 256 as int) as g, cast(l_suppkey % 256 as int) as b,
 255 as a from lineitem)"""

RASTER = """(select clip_id, frame, cast(i % 8 as int) as x, cast(i // 8 as int) as y,
 q[i + 1] as r, q[(i + 21) % 64 + 1] as g, q[(i + 42) % 64 + 1] as b, 255 as a
 from (select label as clip_id,
  cast(row_number() over (partition by label order by vec_id) - 1 as int) as frame,
  list_transform(embedding, lambda e: cast(floor((cast(e as double) + 1) * 127.5 + 0.5) as int)) as q
  from embeddings) fv, (select unnest(range(64)) as i) ii)"""


def carrier_sql(r: str, g: str, b: str, a: str = "a", pre: str = CARRIER) -> str:
    return f"select l_orderkey, l_linenumber, {r} as r, {g} as g, {b} as b, {a} as a from {pre} p"


def each(fmt: str) -> tuple[str, str, str]:
    """The same expression for the three channels; `{c}` is the channel."""
    return tuple(fmt.replace("{c}", c) for c in "rgb")


def raster_sql(r: str, g: str, b: str, a: str = "a", pre: str = RASTER) -> str:
    return f"select clip_id, frame, x, y, {r} as r, {g} as g, {b} as b, {a} as a from {pre} p"


def tile_hash_sql(tx: str, ty: str) -> str:
    """Hash of a tile position to [0, 1), in whole numbers."""
    m = f"((cast({tx} as bigint) * 374761393 + cast({ty} as bigint) * 668265263) % 4294967296)"
    n = f"((xor({m}, {m} >> 13) * 1274126177) % 4294967296)"
    return f"(xor({n}, {n} >> 16) / 4294967296.0)"
