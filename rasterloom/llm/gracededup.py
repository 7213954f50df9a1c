"""Exact dedup by Grace hash partitioning: buckets that fit, and in each an open-addressing table.

Texts are equal when they are identical without white space.  Where a text is read, a table of
a bounded block of texts makes one record of equal ones, so a common text is shuffled about
once a block.  Records are dealt by a hash of their content into buckets; a bucket that is too
large for one table goes to the next level, where its records are first united in even parts
(copies of one text cannot be split by a hash) and then dealt by another hash, until every
bucket fits.  The spill files are Spark's shuffle files and, between levels, tables in the
shared folder.  A bucket's table is open-addressed with linear probing, and two records are
one group only where the complete contents are equal.

Only numbers of records are joined back to the rows, and a record has at most the rows of one
block, so no join has a hot key.  Of a group the row with the most code points stays, then
that of the smallest id (null last); of rows equal in both, one.

Defined cases: null is an empty text; empty and blank texts are one group; repeated rows are
copies; an empty table gives no rows; other columns pass through `without_copies` under any
name and are not in `groups`, which returns doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.llm.common import dimension_join, give_back, map_arrow, staged, table

WHITE = b" \t\n\x0b\x0c\r"
BLOCK_TEXT = 16 << 20  # bytes of text that are united where they are read
TABLE_BYTES = 64 << 20  # bytes of content that one bucket's table may hold
FEW = 64  # a bucket of so few records, all of one text, is never split
RECORD = "rec bigint, sha binary, bytes bigint, content binary, n bigint, chars bigint, id {id}, best bigint"


class ContentTable:
    """Open addressing with linear probing; an entry is a whole content, found by comparing all of it."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, key: int, content: bytes) -> int:
        """The content's entry, a new one (the last) if it was not met before."""
        at = key & self.mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == key and self.contents[k] == content:
                return k
            at = (at + 1) & self.mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.contents) > self.mask:
            self._grow()
        return k

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, key in enumerate(self.hashes):
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = k


def order(chars: int, doc_id, tie: int) -> tuple:
    """Least first: most code points, then the smallest id, null last."""
    return (-chars, doc_id is None, 0 if doc_id is None else doc_id, tie)


def key_of(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little")


def records(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, row (the named columns), rec (its record's number), sha and chars.

    The row that stands for its record has `content`, `bytes`, and `n`, the rows of the record.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in (doc_id, *columns)]).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.length(F.col(f"`{text}`")).cast("bigint").alias("chars"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, met = TaskContext.get().partitionId() << 40, 0
        held, seen, entries, shas = [], ContentTable(), [], []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            rows = [b for b, _ in held]
            ids = [x for b in rows for x in b.column("id").to_pylist()]
            chars = [x or 0 for b in rows for x in b.column("chars").to_pylist()]
            stands = [-1] * len(seen.contents)
            n = [0] * len(stands)
            for at, k in enumerate(entries):
                n[k] += 1
                if stands[k] < 0 or order(chars[at], ids[at], at) < order(chars[stands[k]], ids[stands[k]], stands[k]):
                    stands[k] = at
            at = 0
            for b, m in held:
                here = range(at, at + m)
                own = [stands[entries[i]] == i for i in here]
                content = [seen.contents[entries[i]] if o else None for i, o in zip(here, own)]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), b.column("row"), pa.array([base + met + entries[i] for i in here], pa.int64()),
                    pa.array(shas[at:at + m], pa.binary()), pa.array(chars[at:at + m], pa.int64()),
                    pa.array([None if c is None else len(c) for c in content], pa.int64()), pa.array(content, pa.binary()),
                    pa.array([n[entries[i]] if o else None for i, o in zip(here, own)], pa.int64())],
                    names=["id", "row", "rec", "sha", "chars", "bytes", "content", "n"])
                at += m

        for batch in batches:
            for t in batch.column("text"):
                content = (t.as_py() or b"").translate(None, WHITE)
                sha = hashlib.sha256(content).digest()
                entries.append(seen.entry(key_of(sha), content))
                shas.append(sha)
                size += len(content)
            held.append((batch.select(["id", "row", "chars"]), batch.num_rows))
            if size > BLOCK_TEXT:
                yield from block()
                met += len(seen.contents)
                held, seen, entries, shas, size = [], ContentTable(), [], [], 0
                give_back()
        yield from block()

    of = kept.schema
    return map_arrow(kept, run, f"id {of['id'].dataType.simpleString()}, row {of['row'].dataType.simpleString()}, rec bigint, sha binary, "
                                "chars bigint, bytes bigint, content binary, n bigint")


def united(parts: DataFrame, *, whole: bool) -> DataFrame:
    """One table for each partition of records.

    whole: the partition holds all copies; per record its group's (keep_id, group_size, keep_rec).
    Otherwise per record the record it goes into, which alone has a content and sums up the others.
    """
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, groups, recs, entries, shas = ContentTable(), [], [], [], []
        for batch in batches:
            for rec, sha, content, n, chars, doc_id, best in zip(*(batch.column(c).to_pylist() for c in ("rec", "sha", "content", "n", "chars", "id", "best"))):
                k = seen.entry(key_of(sha), content)
                mine = order(chars, doc_id, best)
                if k == len(groups):
                    groups.append([mine, chars, doc_id, best, n, rec])
                    shas.append(sha)
                else:
                    g = groups[k]
                    g[4] += n
                    if mine < g[0]:
                        g[:4] = mine, chars, doc_id, best
                recs.append(rec)
                entries.append(k)
        for i in range(0, len(recs), 10_000):
            g = [groups[k] for k in entries[i:i + 10_000]]
            if whole:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(recs[i:i + 10_000], pa.int64()), pa.array([x[2] for x in g], id_type), pa.array([x[4] for x in g], pa.int64()),
                     pa.array([x[3] for x in g], pa.int64())], names=["rec", "keep_id", "group_size", "keep_rec"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(recs[i:i + 10_000], pa.int64()), pa.array([x[5] for x in g], pa.int64())] + [
                    pa.nulls(len(g), t) for t in (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), id_type, pa.int64())],
                    names=["rec", "into", "sha", "bytes", "content", "n", "chars", "id", "best"])
        if not whole:  # the records that stand for others, once more and whole
            for k, (_, chars, doc_id, best, n, rec) in enumerate(groups):
                yield pa.RecordBatch.from_pylist([{"rec": rec, "into": None, "sha": shas[k], "bytes": len(seen.contents[k]), "content": seen.contents[k],
                                                   "n": n, "chars": chars, "id": doc_id, "best": best}], schema=pa.schema([
                    ("rec", pa.int64()), ("into", pa.int64()), ("sha", pa.binary()), ("bytes", pa.int64()), ("content", pa.binary()), ("n", pa.int64()),
                    ("chars", pa.int64()), ("id", id_type), ("best", pa.int64())]))

    id_type = to_arrow_type(parts.schema["id"].dataType)
    out = f"rec bigint, keep_id {kind}, group_size bigint, keep_rec bigint" if whole else "rec bigint, into bigint, " + RECORD.format(id=kind)[len("rec bigint, "):]
    return map_arrow(parts, run, out)


def settled(open_: DataFrame, *, limit: int = TABLE_BYTES) -> DataFrame:
    """(rec, keep_id, group_size, keep_rec) of every record; `open_` is staged."""
    spark, done, moves, level = open_.sparkSession, [], [], 0
    fields = ["rec", "sha", "bytes", "content", "n", "chars", "id", "best"]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        rows, total = open_.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        fan = min(max(1, rows), max(-(-2 * total // limit), min(least, 1 + rows // 500)))
        open_ = open_.select(*fields, F.pmod(F.xxhash64("sha", F.lit(level)), F.lit(fan)).cast("int").alias("bucket"))
        large = staged(open_.groupBy("bucket").agg(F.sum("bytes").alias("total"), F.count("*").alias("n"), (F.min("sha") == F.max("sha")).alias("one"))
                       .filter((F.col("total") > limit) & ~(F.col("one") & (F.col("n") <= FEW))).select(F.col("bucket").alias("_bucket"), "total", "n"))
        over, many = large.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        fits = dimension_join(open_, large, F.col("bucket") == F.col("_bucket"), "left_anti") if over else open_
        done.append(united(fits.repartitionById(fan, "bucket").select(*fields), whole=True))
        if not over:
            break
        rest = dimension_join(open_, large, F.col("bucket") == F.col("_bucket"), "left_semi")
        met = staged(united(rest.repartition(min(many, -(-over // limit)), "rec").select(*fields), whole=False))
        moves.append(met.filter("into is not null").select("rec", "into"))
        open_ = met.filter("into is null").select(*fields)
        level += 1
    found = done.pop()
    while moves:
        moved = moves.pop().join(found.select(F.col("rec").alias("into"), "keep_id", "group_size", "keep_rec").hint("merge"), "into")
        found = done.pop().union(moved.select("rec", "keep_id", "group_size", "keep_rec"))
    return found


def grouped(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", columns: tuple[str, ...] = (), limit: int = TABLE_BYTES) -> DataFrame:
    """Every row's (row, keep_id, group_size, kept, sha); `row` is a struct of doc_id and the named columns."""
    rows = staged(records(docs, text=text, doc_id=doc_id, columns=columns), compression="zstd")
    found = settled(rows.filter("content is not null").select("rec", "sha", "bytes", "content", "n", "chars", "id", F.col("rec").alias("best")), limit=limit)
    return (rows.select("row", "rec", "sha", F.col("n").isNotNull().alias("stands")).join(found.hint("merge"), "rec")
            .select("row", "keep_id", "group_size", (F.col("stands") & (F.col("rec") == F.col("keep_rec"))).alias("kept"), "sha"))


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", limit: int = TABLE_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    return grouped(docs, text=text, doc_id=doc_id, limit=limit).select(
        F.col("row")[doc_id].alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", limit: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return grouped(whole, columns=("own",), limit=limit).filter("kept").select("row.own.*")


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id ASC NULLS LAST)
"""
