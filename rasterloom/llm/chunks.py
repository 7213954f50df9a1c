"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; where its value has enough zero bits, a chunk
ends.  Chunking is normalised: below the normal size a boundary needs more zero bits, above
it fewer, with a least and a largest size.  A boundary depends on the bytes just before it,
so an edit changes the chunks that it touches and leaves the others, wherever they move to.
A fingerprint is the set of a text's chunk digests, each with its length; how much of one
text lies in another is the length of the shared chunks over the length of all chunks.

Neighbours in descending id order meet in range buckets of counted size, a task for each: texts are shuffled
once, and the first row of each bucket is also sent to the end of the bucket before it, so
no bucket needs another one and no whole order lies in one task.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, which
is wholly in another empty one and not at all in any other; rows with equal ids follow in
text order; null ids come last; the only row of a table is its own next; an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, slices

LEAST, NORMAL, MOST = 16, 48, 192
STRICT_BITS, LOOSE_BITS = 8, 4  # about two bits more and two less than log2 of the normal size
WINDOW_STEPS = 5  # the gear hash looks at 2 ** 5 bytes
BUCKET_ROWS, MOST_BUCKETS = 4_000, 10_000
GEAR = np.random.Generator(np.random.Philox(key=10)).integers(0, 1 << 64, 256, np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: gear values of the window, each shifted by its distance."""
    h = GEAR[data]
    for k in range(WINDOW_STEPS):
        step = 1 << k
        if step >= len(h):
            break
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))  # the right side is made before it is stored
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if not n:
        return []
    h = gear(np.frombuffer(data, np.uint8)) >> np.uint64(64 - STRICT_BITS)
    strict = (np.flatnonzero(h == 0) + 1).tolist()
    loose = (np.flatnonzero(h >> np.uint64(STRICT_BITS - LOOSE_BITS) == 0) + 1).tolist()
    ends, at = [], 0
    while n - at > LEAST:
        k = bisect_left(strict, at + LEAST)
        if k < len(strict) and strict[k] < at + NORMAL:
            at = strict[k]
        else:
            k = bisect_left(loose, at + NORMAL)
            at = min(n, at + MOST, loose[k] if k < len(loose) else n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def fingerprint(text: str | None) -> dict[bytes, int]:
    """Chunk digests with the chunks' lengths in bytes."""
    data, at, out = (text or "").encode(), 0, {}
    for end in boundaries(data):
        out[xxhash.xxh64_digest(data[at:end])] = end - at
        at = end
    return out


def contained(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Share of a's length in chunks that b has too."""
    if not a:
        return float(not b)
    return sum(n for digest, n in a.items() if digest in b) / sum(a.values())


def written(chunks: dict[bytes, int]) -> str:
    """Digests in hexadecimal with their lengths, in digest order."""
    return ",".join(f"{digest.hex()}:{n}" for digest, n in sorted(chunks.items()))


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the fingerprint of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                made = [written(fingerprint(t)) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.string())], names=[*keep, "fingerprint"])

    d = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return map_arrow(d, run, f"{fields}, fingerprint string")


def with_next(docs: DataFrame, *, rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text) in runs: sorted by bucket, then descending id; the last row of a bucket, marked
    `ahead`, is the row that follows the bucket.  Needs a whole-number doc_id.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    wanted = min(MOST_BUCKETS, max(1, -(-n // rows)))
    edges = sorted(set(ids.stat.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.25 / wanted))) if wanted > 1 else []
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if edges:  # how many edges are below the id, by bisection
        table, key = F.array(*[F.lit(int(e)) for e in edges]), F.col("doc_id")
        below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(
            (at + step <= len(edges)) & (F.get(table, at + step - 1) < key), step).otherwise(0))
    else:
        below = F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(len(edges) - below)
    firsts = sorted((r.b, r.first) for r in ids.select(bucket.alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("first")).collect())
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}  # the bucket that ends where b begins
    first_of, sent_to = [None] * (len(edges) + 2), [None] * (len(edges) + 2)
    for b, first in firsts:
        first_of[b], sent_to[b] = first, before[b]
    longs, at = "array<bigint>", F.col("bucket")
    leads = F.get(F.array(*[F.lit(x) for x in first_of]).cast(longs), at).eqNullSafe(F.col("doc_id"))
    back = F.get(F.array(*[F.lit(x) for x in sent_to]).cast("array<int>"), at)
    here = F.struct(at.alias("b"), F.lit(False).alias("ahead"))
    copies = F.when(leads, F.array(here, F.struct(back.alias("b"), F.lit(True).alias("ahead")))).otherwise(F.array(here))
    spread = d.withColumn("bucket", bucket).select("doc_id", "text", F.inline(copies).alias("bucket", "ahead"))
    return spread.repartitionById(len(edges) + 2, "bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")


def neighbours(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how near these and the next document's are.

    Edited is the text whose last third is replaced by the start of the next document in descending id order.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), *((c, pa.float64()) for c in names[5:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[dict] = []
                for bucket, ahead, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                    if held is not None and held[0] != bucket:
                        held, done = None, False
                    if done:  # rows that follow the bucket, equal in id
                        continue
                    mine = fingerprint(text)
                    if held is not None:
                        _, of, before, chunks = held
                        third = len(before) // 3
                        edited = before[:len(before) - third] + text[:third]
                        changed = fingerprint(edited)
                        out.append(dict(zip(names, (of, len(before), hashlib.sha256(edited.encode()).hexdigest(), written(chunks),
                                                    written(changed), contained(chunks, changed), contained(chunks, mine)))))
                    held, done = (bucket, doc_id, text, mine), ahead
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    sql = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_next(docs).select("bucket", "ahead", "doc_id", "text"), run, sql)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
