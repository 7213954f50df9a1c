"""Byte-level BPE encoding and decoding by merge replay over the words of a chunk.

The pieces of a chunk of documents are collected once, however often they occur.  An
inverted index leads from the rank of a token pair to its positions in all those pieces;
merges are applied in rank order to all positions of a rank together, and only the pairs
that touch a merged position change.  Merges of a piece never depend on another piece, so
chunks give the same ids as the corpus at once; a chunk is what bounds the memory of a
task, and no text, piece or id is shuffled.  Should a merge make a pair of a smaller rank,
that rank goes first, left to right, as in the public library.

Defined cases: a null or empty text has no ids and decodes to the empty string; ids of any
length are kept whole; other columns pass through where asked for; an empty table stays empty.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rasterloom.llm.common import binary_column, kept_by_worker, map_arrow, ragged, slices

# Pieces that are kept by a task, and by a worker between tasks: the latest half, and those before, of which the used ones move on.
KEPT_PIECES, MOST_PIECES = 450_000, 700_000
KEPT_PAIRS = 300_000
# Texts that are cut into pieces at a time, and new pieces that are merged at a time: a byte of these costs some 100 in lists.
TEXT_BYTES, MERGED_BYTES = 512 << 10, 128 << 10


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a rank file, which the driver reads; at most a vocabulary."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Replay:
    """Encodes batches of different pieces."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.pairs: dict[int, int] = {}

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of two neighbouring tokens as one token, -1 if they never merge."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(p) for p in pieces]
        text = b"".join(p for p, rank in zip(pieces, whole) if rank is None)
        ends = np.cumsum([len(p) for p, rank in zip(pieces, whole) if rank is None]).tolist()
        single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        ids = [single[b] for b in text]
        if -1 in ids:
            raise ValueError("the rank file lacks a single byte that occurs in a text")
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:  # a piece has neither neighbour
            after[e - 1] = n
            if e < n:
                before[e] = -1
        index: dict[int, list[int]] = {}
        ranks_at = [-1] * n
        for i in range(n - 1):
            if after[i] < n and (rank := self.pair_rank(ids[i], ids[i + 1])) >= 0:
                ranks_at[i] = rank
                index.setdefault(rank, []).append(i)
        queue = list(index)
        heapq.heapify(queue)

        def note(at: int, rank: int) -> None:
            ranks_at[at] = rank
            if rank >= 0:
                if rank in index:
                    index[rank].append(at)
                else:
                    index[rank] = [at]
                    heapq.heappush(queue, rank)

        while queue:
            rank = heapq.heappop(queue)
            spots = index.pop(rank)
            spots.sort()
            for k, i in enumerate(spots):
                if queue and queue[0] < rank:  # a smaller rank came up: it goes first
                    index.setdefault(rank, []).extend(spots[k:])
                    heapq.heappush(queue, rank)
                    break
                if ranks_at[i] != rank:
                    continue
                j = after[i]
                k2, h = after[j], before[i]
                ids[i], ids[j] = rank, -1
                ranks_at[j] = -1
                after[i] = k2
                if k2 < n:
                    before[k2] = i
                    note(i, self.pair_rank(rank, ids[k2]))
                else:
                    ranks_at[i] = -1
                if h >= 0:
                    note(h, self.pair_rank(ids[h], rank))
        out, at, split = [], 0, iter(ends)
        for rank in whole:
            if rank is not None:
                out.append([rank])
                continue
            end = next(split)
            out.append([x for x in ids[at:end] if x >= 0])
            at = end
        return out


def few(pieces: Iterable[str], limit: int = MERGED_BYTES) -> Iterator[list[str]]:
    """The pieces in lists of about `limit` code points at most, but one piece at least."""
    held, size = [], 0
    for p in pieces:
        if held and size + len(p) > limit:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield held


class Encoder:
    """Packed ids of whole texts; pieces met before are looked up and joined as bytes."""

    def __init__(self, tokens: list[bytes], pattern: str, kept: int = KEPT_PIECES):
        self.replay, self.find, self.kept = Replay(tokens), regex.compile(pattern).findall, kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.kept // 2:
            self.older, self.known = self.known, {}
        found = [self.find(t) if t else [] for t in texts]
        new = set().union(*found).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        for some in few(new - again):
            self.known.update(zip(some, (array("I", ids).tobytes() for ids in self.replay.encode([p.encode() for p in some]))))
        of = self.known.__getitem__
        return [b"".join(map(of, pieces)) for pieces in found]


def kept_encoder(tokens: list[bytes], pattern: str, kept: int = MOST_PIECES) -> Encoder:
    """The worker's encoder, with the pieces that it met in earlier tasks."""
    return kept_by_worker(("pieces", hash(tuple(tokens)), pattern, kept), lambda: Encoder(tokens, pattern, kept))


def encode(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add `out`: the ids of the whole text as little-endian unsigned 32-bit integers.

    `ranks` is the path of a rank file on the driver, `keep` the columns to keep (all but the text).
    """
    keep = [c for c in docs.columns if c not in (text, out)] if keep is None else keep
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokens.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                columns = [*part.columns[:len(keep)], pa.array(encoder.encode(part.column(text).to_pylist()), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    schema = StructType([*(docs.schema[c] for c in keep), StructField(out, BinaryType())])
    return map_arrow(docs.select(*keep, *([] if text in keep else [text])), run, schema)


class Decoder:
    """Bytes of ids."""

    def __init__(self, tokens: list[bytes]):
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, runs: list[bytes]) -> pa.Array:
        """The bytes that each run of packed ids stands for."""
        at = np.frombuffer(b"".join(runs), "<u4").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lens[at])])[np.cumsum([len(x) // 4 for x in runs])]
        return binary_column(self.flat[ragged(self.starts[at], self.lens[at])], ends)


def decode(encoded: DataFrame, ranks: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out`: the bytes that the ids stand for."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    columns = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens.value)
        for batch in batches:
            for part in slices(batch, ids):
                text = decoder.decode([x or b"" for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*columns, out])

    schema = StructType([*(encoded.schema[c] for c in columns), StructField(out, BinaryType())])
    return map_arrow(encoded.select(*columns), run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MOST_PIECES) -> DataFrame:
    """The kept columns with ids and decoded: encode and decode in one pass, with one Python worker a task.

    `most` bounds the pieces that a worker keeps; it has no part in results.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = kept_encoder(tokens.value, pattern, most), Decoder(tokens.value)
        for batch in batches:
            for part in slices(batch, "_text", TEXT_BYTES):
                ids = encoder.encode(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), decoder.decode(ids)], names=[*keep, "ids", "decoded"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    return map_arrow(docs.select(*keep, F.col(text).alias("_text")), run, schema, keeps=True)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs, path, public_tokenizers.PATTERN)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def digests(decoded: DataFrame) -> DataFrame:
    return (decoded.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
            .withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256)))
