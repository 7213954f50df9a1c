"""Fill-in-the-middle texts: cuts found in an indexable skip list.

A text is a list of units (code points, or the matches of a pattern).  The list's lowest lane
holds the units; each lane above keeps a node of the one below with a fixed chance and knows,
for every step, how many units and how many code points it passes.  A cut at a rank of units
starts in the highest lane, steps on while the accumulated units do not pass the rank, and goes
down a lane, so it reaches the rank exactly and knows its place in code points, whatever the
units' lengths.  Heights decide only the way, never the result.

Prefix, middle and suffix are put in the order prefix-suffix-middle (psm) or suffix-prefix-middle
(spm) with a mark before each; a text that is empty, holds a mark, or is chosen to stay is plain.
Ranks and form come from a hash of seed and id, so reruns agree.

Defined cases: a null text is empty and plain; a null id is hashed as an empty one; equal ids
are cut at the same draws; repeated rows stay; an empty table gives no rows; other columns are
left out, those named in `keep` pass through under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, slices, table

SEED, SPREAD = 1, 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100


class SkipList:
    """Units with their widths in code points; `at` finds the code point where a rank of units ends."""

    def __init__(self, widths: np.ndarray, coins: np.random.Generator, spread: int = SPREAD):
        self.n = len(widths)
        self.lanes = [(None, None, widths)]  # where a node stands in the lane below, units and code points of its step
        while len(widths) > spread:
            gaps, reached = [], 0
            while reached < len(widths):  # a node is kept with chance 1/spread, so gaps are geometric
                more = coins.geometric(1 / spread, 1 + (len(widths) - reached) // spread)
                gaps.append(more)
                reached += int(more.sum())
            below = np.cumsum(np.concatenate([[0], *gaps]))
            below = below[below < len(widths)]
            units = np.diff(below, append=len(widths)) if self.lanes[-1][1] is None else np.add.reduceat(self.lanes[-1][1], below)
            widths = np.add.reduceat(widths, below, dtype=np.int64)
            self.lanes.append((below, units, widths))

    def at(self, rank: int) -> int:
        """Code points in the first `rank` units."""
        node = units = points = 0
        for below, steps, widths in reversed(self.lanes):
            end = len(widths)
            while node < end and units + (1 if steps is None else int(steps[node])) <= rank:
                units += 1 if steps is None else int(steps[node])
                points += int(widths[node])
                node += 1
            if units == rank:
                break
            node = 0 if below is None else int(below[node])
        return points


def unit_widths(text: str, find) -> np.ndarray:
    """Code points of each unit; what lies between two matches belongs to the later one, a rest to the last."""
    if find is None:
        return np.broadcast_to(np.ones(1, np.uint8), len(text))
    ends = np.fromiter((m.end() for m in find(text) if m.end() > m.start()), np.int64)
    if len(text) and not len(ends):
        return np.array([len(text)])
    if len(ends):
        ends[-1] = len(text)
    return np.diff(ends, prepend=0)


def draws(doc_id, seed: int) -> list[int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transformed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", unit: str | None = None, seed: int = SEED,
                spread: int = SPREAD) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output.

    `unit` is a pattern whose matches are the units, by default every code point is one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coins, find = np.random.default_rng(seed), regex.compile(unit).finditer if unit else None

        def one(i, t: str) -> tuple:
            widths = unit_widths(t, find)
            n, (h1, h2, h3, h4) = len(widths), draws(i, seed)
            if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h3 % 100 >= PLAIN_FROM:
                return n, "plain", None, None, t
            cuts = SkipList(widths, coins, spread)
            a, b = (cuts.at(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
            if h4 % 100 < SPM_BELOW:
                return n, "spm", a, b - a, "".join((SUFFIX, t[b:], PREFIX, t[:a], MIDDLE, t[a:b]))
            return n, "psm", a, b - a, "".join((PREFIX, t[:a], SUFFIX, t[b:], MIDDLE, t[a:b]))

        for batch in batches:
            for part in slices(batch, "text"):
                made = [one(i, t or "") for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]
                cols = list(zip(*made)) if made else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())))],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_arrow(d, run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of which an output was made; it holds none of the marks unless it is plain."""
    body = F.substring(output, len(PREFIX) + 1, 2 ** 31 - 1)

    def parts(mark: str) -> tuple[Column, Column, Column]:
        rest = F.substring_index(body, mark, -1)
        return F.substring_index(body, mark, 1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(SUFFIX)
    last, first, between = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, between, last)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
         WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
         ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
