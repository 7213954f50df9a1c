"""Token ids as binary files: static range asymmetric numeral systems in interleaved blocks.

Documents are tokenized, an end id is appended to each, and ids are written in ascending id
order.  One frequency table, counted over all ids, is shared by all blocks.  A block holds
whole documents and is independent of the others; within it token j belongs to lane j mod
LANES, and the lanes' 64-bit states advance together as one vector.  Every STRIDE steps the
states and the place in the stream are kept as a checkpoint, from which decoding can start,
so a block, too, can be decoded in parallel; checksums cover the head and the stream.

File format, little-endian.  A file is a sequence of blocks, each
  magic "RTB1", u32 length of what follows up to the trailer, u32 crc32 of it, then
  u64 part, u64 block number, u64 tokens, u32 documents, u32 lanes, u32 stride, u32 bits,
  u32 checkpoints, u64 words; per document i64 id, u8 id is null, u64 tokens;
  per checkpoint u64 first word, lanes x u64 states; the words (u32); trailer "RTB."
The folder holds `blocks` (these files) and `table` (token, freq as Parquet).

Defined cases: a null or empty text has the end id only; null ids come last; rows equal in id
follow in the order of their ids' bytes; a document longer than a block makes one of its own
size; strings of special tokens are ordinary text; an empty table writes no block; other columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import binary_column, dimension_join, kept_by_worker, map_arrow, running_total, runs, shared_folder, slices, staged, write_raw

LANES, STRIDE, BITS = 2048, 128, 20
LOW = 31  # states stay in [2 ** LOW, 2 ** (LOW + 32))
BLOCK_TOKENS, FILE_TOKENS = 1 << 19, 1 << 24
MAGIC, TRAILER, HEAD = b"RTB1", "RTB.", "<QQQIIIIIQ"
RUN_BYTES = 12 << 20  # of texts whose words are numbered together
KEPT_BYTES = 240 << 20  # memory of the words and pieces that a task remembers
ENTRY_BYTES = 240  # of one of them, besides its characters and ids
# Fixed value: how the tokenizer file splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters for which lower case, white space and pieces are known to be the library's; other texts go to it whole.
PLAIN = "\x00-\x1b\x20-\u012f\u0131-\u024f"
DOUBTFUL = np.zeros(256, bool)  # bytes of texts that may have others: four separators, leads of U+0130 and of U+0240 on
DOUBTFUL[[*range(0x1C, 0x20), 0xC4, *range(0xC9, 0x100)]] = True
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # neither letters nor digits nor white space


def byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(rest)}


class Tokens:
    """Ids of whole texts by the tokenizers library; its model sees each different piece of plain texts once.

    Pieces never reach across white space, so a text's ids are those of its words in turn, and
    a word's are those of its pieces.  Arrow lowers, splits and numbers the words of many texts
    at once, so that a different word is looked up once, and lays out its packed ids where it occurs.
    The strings of special tokens in a text are ordinary text.
    """

    def __init__(self, model: str, end: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.encode_special_tokens = True
        self.merge = self.library.model.tokenize
        self.kind = width(max(end, *self.library.get_vocab().values()))
        self.packed = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end], self.kind).tobytes()
        self.other, self.find = re.compile(f"[^{PLAIN}]").search, regex.compile(PIECES).findall
        shown = byte_characters()
        self.characters = "".join(chr(shown.get(b, b)) for b in range(256))
        # words and pieces (a word of letters is one piece): the latest, and those before, of which the used ones move on
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the latest

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts have no character but those in PLAIN; most need no look at each of them."""
        ends, data = layout(texts)
        out = np.ones(len(texts), bool)
        if DOUBTFUL[data[ends[0]:ends[-1]]].any():
            for k, (start, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                out[k] = not DOUBTFUL[data[start:end]].any() or not self.other(texts[k].as_py())
        return out

    def whole(self, text: str) -> bytes:
        """Packed ids of any text, by the tokenizer as it is."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def remember(self, word: str, ids: bytes) -> bytes:
        if self.held > KEPT_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        self.known[word] = ids
        self.held += ENTRY_BYTES + 3 * len(word)
        return ids

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece."""
        ids = self.known.get(piece)
        if ids is not None:
            return ids
        ids = self.older.get(piece)
        if ids is None:
            shown = piece if piece.isascii() and piece.isprintable() else charmap_decode(piece.encode(), "strict", self.characters)[0]
            ids = array(self.packed, [t.id for t in self.merge(shown)]).tobytes()
        return self.remember(piece, ids)

    def word(self, word: str) -> bytes:
        """Packed ids of a word."""
        if word.isalpha():
            return self.piece(word)
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(MARKS)  # most are letters and then marks
            ids = self.piece(stem) + self.piece(word[len(stem):]) if stem.isalpha() else b"".join(map(self.piece, self.find(word)))
        return self.remember(word, ids)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Packed ids of plain texts, one after the other, and their ends in bytes."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        numbered = split.flatten().dictionary_encode()
        different = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, different))
        for k, found in enumerate(ids):
            if found is None:
                ids[k] = self.word(different[k])
        at = np.insert(numbered.indices.to_numpy(), ends, len(ids))  # the end id follows each text
        starts, data = layout(pa.array([*ids, self.end], pa.large_binary()).take(pa.array(at)))
        return data[starts[0]:starts[-1]], starts[ends + np.arange(1, len(ends) + 1)] - starts[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Packed ids of all texts, one after the other, the end id after each, and their ends in bytes."""
        texts = texts.fill_null("")
        plain = self.plain(texts)
        if plain.all():
            return self.words(texts)
        data, ends = self.words(texts.filter(pa.array(plain)))
        simple = np.split(data, ends[:-1]) if len(ends) else []
        each, k = [], iter(simple)
        for is_plain, text in zip(plain.tolist(), texts):
            each.append(next(k).tobytes() if is_plain else self.whole(text.as_py()) + self.end)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum([len(x) for x in each])


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows of a string or binary column, and the bytes that they point into."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if offsets and offsets.size else np.zeros(1, np.int32)
    return offsets, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)


def width(most: int) -> str:
    """The unsigned kind that ids are packed in."""
    return "<u2" if most < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, model: str, end: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, bytes per id, ids): little-endian ids of the text and the end id, packed by the vocabulary's size.

    A task's last row has no ids but `seen`, how often the task met each id, as pairs of 64-bit numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_text(encoding="utf-8"))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(("tokens", hash(shared.value), end), lambda: Tokens(shared.value, end))
        size, counts = np.dtype(tokens.kind).itemsize, np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "size", "ids", "seen"]
        for part in runs(batches, "text", RUN_BYTES):
            data, ends = tokens.encode(part.column("text"))
            more = np.bincount(data.view(tokens.kind), minlength=len(counts))
            more[:len(counts)] += counts
            counts = more
            made = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends, prepend=0) // size), pa.array(np.full(len(ends), size, np.int32)),
                                               binary_column(data, ends), pa.nulls(len(ends), pa.binary())], names=names)
            yield from slices(made, "ids")
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()),
                                          pa.array([np.stack([used, counts[used]]).astype("<i8").tobytes()], pa.binary())], names=names)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(d, run, "doc_id bigint, n_tokens bigint, size int, ids binary, seen binary", keeps=True)


def frequencies(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs, from the tasks' counts: one row per id of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("seen"):
                used, counts = np.frombuffer(data.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts)], names=["token", "n"])

    rows = map_arrow(tokens.filter("seen is not null").select("seen"), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def scaled(counts: dict[int, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in ascending order and whole shares of 2 ** bits, at least 1 each."""
    tokens = np.array(sorted(counts), np.int64)
    n = np.array([counts[t] for t in tokens.tolist()], np.float64)
    whole = 1 << bits
    if len(tokens) > whole:
        raise ValueError("more different ids than the table has places")
    if not len(tokens):
        return tokens, np.zeros(0, np.int64)
    freq = 1 + np.floor(n / n.sum() * (whole - len(tokens))).astype(np.int64)
    freq[freq.argmax()] += whole - freq.sum()
    return tokens, freq


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray, bits: int = BITS):
        self.tokens, self.bits = tokens, bits
        self.freq, self.low = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(tokens), dtype=np.int32), freq)
        self.place = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
        self.place[tokens] = np.arange(len(tokens))

    def encode(self, ids: np.ndarray, lanes: int = LANES, stride: int = STRIDE) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Checkpoints (first word, states) in order of the tokens, and the words."""
        at = self.place[ids]
        freq, low = self.freq[at], self.low[at]
        steps, bits = -(-len(ids) // lanes), np.uint64(self.bits)
        x = np.full(lanes, 1 << LOW, np.uint64)
        groups: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []  # words after this place, states
        written = 0
        for step in reversed(range(steps)):
            f, c = freq[step * lanes:(step + 1) * lanes], low[step * lanes:(step + 1) * lanes]
            y = x[:len(f)]
            full = (y >> np.uint64(LOW + 32 - self.bits)) >= f
            groups.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(groups[-1])
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[:len(f)] = (q << bits) + (y - q * f) + c
            if step % stride == 0:
                marks.append((written, x.copy()))
        words = np.concatenate(groups[::-1]) if groups else np.zeros(0, "<u4")
        return [(written - after, states) for after, states in reversed(marks)], words

    def decode(self, n: int, lanes: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The next n ids from a checkpoint's states and the words from its place on."""
        out, x, at = np.empty(n, np.int64), states.astype(np.uint64), 0
        bits, mask, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(1 << LOW)
        for start in range(0, n, lanes):
            y = x[:min(lanes, n - start)]
            slot = y & mask
            s = self.symbol[slot.astype(np.int64)]
            out[start:start + len(y)] = s
            y = self.freq[s] * (y >> bits) + slot - self.low[s]
            short = y < low
            k = int(short.sum())
            y[short] = (y[short] << np.uint64(32)) | words[at:at + k]
            x[:len(y)] = y
            at += k
        return self.tokens[out]


def pack(coder: Coder, part: int, number: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One block without its trailer."""
    marks, words = coder.encode(ids)
    body = b"".join([
        struct.pack(HEAD, part, number, len(ids), len(doc_ids), LANES, STRIDE, coder.bits, len(marks), len(words)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(counts, "<u8").tobytes(),
        *(struct.pack("<Q", at) + states.astype("<u8").tobytes() for at, states in marks), words.tobytes()])
    return MAGIC + struct.pack("<II", len(body), zlib.crc32(body)) + body


class Block:
    """A block read back; `decode` gives all ids or those from a checkpoint on."""

    def __init__(self, body: bytes):
        (self.part, self.number, self.tokens, docs, self.lanes, self.stride, self.bits, marks, words) = struct.unpack_from(HEAD, body)
        at = struct.calcsize(HEAD)
        ids, null = np.frombuffer(body, "<i8", docs, at), np.frombuffer(body, "u1", docs, at + 8 * docs)
        self.counts = np.frombuffer(body, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.doc_ids = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist())]
        at += 17 * docs
        self.marks = []
        for _ in range(marks):
            self.marks.append((struct.unpack_from("<Q", body, at)[0], np.frombuffer(body, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.words = np.frombuffer(body, "<u4", words, at)

    def decode(self, coder: Coder, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint `first` up to checkpoint `last` (to the end by default)."""
        span = self.lanes * self.stride
        stop = self.tokens if last is None else min(self.tokens, last * span)
        at, states = self.marks[first]
        return coder.decode(stop - first * span, self.lanes, states, self.words[at:].astype(np.uint64))


def unpack(data: bytes) -> Iterator[Block]:
    """The blocks of a file; a wrong checksum or a torn block raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        n, crc = struct.unpack_from("<II", data, at + 4)
        body, stop = view[at + 12:at + 12 + n], at + 12 + n + len(TRAILER)
        if view[at:at + 4] != MAGIC or zlib.crc32(body) != crc or view[stop - len(TRAILER):stop] != TRAILER.encode():
            raise ValueError("damaged block")
        yield Block(bytes(body))
        at = stop


def write_tokens(tokens: DataFrame, folder: str, *, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> None:
    """Write the rows of `tokenized`, staged, in ascending doc_id order; a file ends after about so many tokens."""
    spark = tokens.sparkSession
    names, freq = scaled(frequencies(tokens))
    table = [(int(t), int(f)) for t, f in zip(names, freq)]
    spark.createDataFrame(table, "token bigint, freq bigint").coalesce(1).write.parquet(f"{folder}/table")
    tokens = tokens.filter("ids is not null")
    rows, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 500)
    parts = max(least, -(-total // file_tokens))
    shared = spark.sparkContext.broadcast((names, freq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = Coder(*shared.value), TaskContext.get().partitionId(), 0
        docs, counts, held, n_held, size = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), f"<u{size}")
            return pa.RecordBatch.from_arrays([pa.array([pack(coder, part, number, docs, counts, ids)], pa.binary())], names=["block"])

        for batch in batches:
            own, each = batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_numpy()
            ends, at = np.cumsum(each), 0
            size = batch.column("size")[0].as_py()
            starts = np.frombuffer(batch.column("ids").buffers()[1], np.int32)[batch.column("ids").offset:]
            data = batch.column("ids").buffers()[2]
            while at < len(own):  # up to the document that fills the block
                stop = min(len(own), 1 + int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_tokens - n_held)))
                docs += own[at:stop]
                counts += each[at:stop].tolist()
                held.append(data[int(starts[at]):int(starts[stop])].to_pybytes())
                n_held += int(each[at:stop].sum())
                if n_held >= block_tokens:
                    yield block()
                    docs, counts, held, n_held, number = [], [], [], 0, number + 1
                at = stop
        if docs:
            yield block()

    ordered = tokens.repartitionByRange(parts, F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), "ids")
    write_raw(map_arrow(ordered.select("doc_id", "n_tokens", "size", "ids"), run, "block binary"), "block", f"{folder}/blocks", TRAILER,
              rows_per_file=max(1, file_tokens // block_tokens))


def read_tokens(spark: SparkSession, folder: str, columns: tuple[Column | str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, start, n_tokens, ...) of every document, decoded from the files, which are read once.

    `columns` are made of `ids`, the document's ids as little-endian unsigned 32-bit integers, while they are there.
    """
    table = sorted((r.token, r.freq) for r in spark.read.schema("token bigint, freq bigint").parquet(f"{folder}/table").collect())
    shared = spark.sparkContext.broadcast((np.array([t for t, _ in table], np.int64), np.array([f for _, f in table], np.int64)))
    files = spark.read.format("binaryFile").load(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for data in batch.column("content"):
                for b in unpack(data.as_py()):
                    ends = np.cumsum(b.counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ends), v, np.int64)) for v in (b.part, b.number)]
                        + [pa.array(b.doc_ids, pa.int64()), pa.array(ends - b.counts), pa.array(b.counts), binary_column(b.decode(coder).astype("<u4"), ends * 4)],
                        names=["part", "number", "doc_id", "at", "n_tokens", "ids"])

    docs = map_arrow(files.select("content"), run, "part bigint, number bigint, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    made = staged(docs.select("part", "number", "doc_id", "at", "n_tokens", *columns))
    blocks = staged(running_total(made.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")), F.struct("part", "number"), "n", "before")
                    .select(F.col("part").alias("_part"), F.col("number").alias("_number"), "before"))
    joined = dimension_join(made, blocks, (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number")))
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), *made.columns[4:])


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_folder(spark)
    write_tokens(staged(tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), 2)), folder)
    return read_tokens(spark, folder, (F.crc32("ids").alias("ids_crc32"),))
