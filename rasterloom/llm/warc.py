"""WARC archives of web pages, and their index by an external merge.

Writing: one record per page.  Of records with equal payloads of a least size, the one with
the largest page id is the response, the others are revisits that refer to it; a revisit
keeps the HTTP head, so it states its payload's length and digest without the payload.
Every record is a gzip member of its own, so a reader can start at any record.

Reading: every archive gives a run of index rows (URL key, time, page, place), sorted where
it was read.  A loser tree merges the runs of each key range: its inner nodes hold the runs
that lost, so the next row costs one comparison per level.  Ranges are cut by (URL key,
time, page), so a URL with very many captures is spread over ranges too; ranges and rows in
them are in global order, and index_pos is a row's place in it.

Defined cases: null html is the empty payload; a null URL has the empty key and target; a
null page id is written as such, is never the one referred to and comes first among equals;
rows equal in page id are written as often; an empty table writes no record; other columns
are left out.  Captures carry no time of their own here, so one is counted from the page id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterloom.llm.common import dimension_join, map_arrow, running_total, shared_folder, staged, write_raw

LEAST_PAYLOAD = 1000
FILE_BYTES = 48 << 20  # of payload, before compression
LEVEL = 3
START = datetime(2024, 1, 1, tzinfo=UTC)
INDEX_ROWS = 100_000  # rows of a key range
# Every member that is followed by this empty member ends in a zero byte; the sink writes that byte as its separator.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")


def url_key(url: Column) -> Column:
    """Host names turned round, then path and query in lower case, without scheme, `www` and fragment."""
    u = F.lower(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*", 0), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    return F.when(u == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def planned(pages: DataFrame, *, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, url_key, payload, digest, response): response is the page that a revisit refers to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    d = d.withColumn("digest", F.sha1("payload"))
    copies = staged(d.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
                    .filter("n > 1 and response is not null").select(F.col("digest").alias("_digest"), "response"))
    d = dimension_join(d, copies, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    other = ~F.col("page_id").eqNullSafe(F.col("response"))
    return d.withColumn("response", F.when(F.col("response").isNotNull() & other, F.col("response"))).withColumn("url_key", url_key(F.col("url")))


def when(page_id: int | None) -> datetime:
    return START + timedelta(seconds=(page_id or 0) % (1 << 31))


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record: a whole response, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {when(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if response is None else [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response)}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(plan: DataFrame, folder: str) -> None:
    """Archives of about FILE_BYTES, written where the pages are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "response")]
            for i in range(batch.num_rows):
                deflate = zlib.compressobj(LEVEL, wbits=31)
                data = deflate.compress(record(*(c[i].as_py() for c in cols))) + deflate.flush()
                yield pa.RecordBatch.from_arrays([pa.array([data + EMPTY_MEMBER[:-1]], pa.binary())], names=["record"])

    rows, size = plan.agg(F.count("*"), F.avg(F.length("payload"))).first()
    write_raw(map_arrow(plan.select("page_id", "url", "payload", "digest", "response"), run, "record binary"),
              "record", folder, "\x00", max(1, int(FILE_BYTES / max(200.0, size or 0))))


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, content) of each gzip member, fed in pieces so that a long file stays linear."""
    at, view = 0, memoryview(data)
    while at < len(view):
        inflate, start, out, step = zlib.decompressobj(wbits=31), at, [], 1 << 12
        while not inflate.eof:
            piece = view[at:at + step]
            if not piece:
                raise ValueError("torn record")
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
            step = min(step * 2, 1 << 20)
        yield start, at - start, b"".join(out)


def parsed(content: bytes) -> dict:
    """Index fields of a record; a response is checked against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("damaged record")

    def page(name: str) -> int | None:
        value = fields.get(name, "<urn:x-page:none>").removeprefix("<urn:x-page:").removesuffix(">")
        return None if value == "none" else int(value)

    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"),
            "captured_at": datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of all records in the archives."""
    names = ("page_id", "url", "captured_at", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_at", "record_bytes")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured_at", pa.timestamp("us", "UTC")), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
                        ("record_at", pa.int64()), ("record_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [{**parsed(content), "archive": path.rsplit("/", 1)[-1], "record_at": at, "record_bytes": n}
                        for at, n, content in members(data.as_py()) if content]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    sql = "page_id bigint, url string, captured_at timestamp, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, record_at bigint, record_bytes bigint"
    found = map_arrow(spark.read.format("binaryFile").load(folder).select("path", "content"), run, sql)
    return found.select(url_key(F.col("url")).alias("url_key"), *names)


class LoserTree:
    """Merges sorted runs of comparable rows."""

    def __init__(self, runs: list[list]):
        self.runs, self.next, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * self.k  # inner node n has children 2 n and 2 n + 1; leaf r is node k + r
        if self.k:
            winners = [-1] * self.k + list(range(self.k))
            for node in range(self.k - 1, 0, -1):
                a, b = winners[2 * node], winners[2 * node + 1]
                winners[node], self.losers[node] = (b, a) if self.before(b, a) else (a, b)
            self.losers[0] = winners[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """Whether run a's next row comes first; an ended run comes last, equal rows in run order."""
        x, y = self.next[a], self.next[b]
        if x >= len(self.runs[a]):
            return False
        if y >= len(self.runs[b]):
            return True
        p, q = self.runs[a][x], self.runs[b][y]
        return p < q or (p == q and a < b)

    def __iter__(self) -> Iterator:
        for _ in range(sum(map(len, self.runs))):
            run = self.losers[0]
            yield self.runs[run][self.next[run]]
            self.next[run] += 1
            node = (self.k + run) // 2
            while node:
                if self.before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.losers[0] = run


def merged(index: DataFrame, rows: int = INDEX_ROWS) -> DataFrame:
    """All index rows in global order of (url_key, captured_at, page_id), numbered by index_pos.  `index` is staged."""
    order = [F.col(c) for c in ("url_key", "captured_at", "page_id", "archive", "record_at")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        part = TaskContext.get().partitionId()
        if not held:
            return
        rows_of = pa.Table.from_batches(held)
        keys = list(zip(*(rows_of.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "archive", "record_at"))))
        runs: dict[str, list] = {}
        for i, (key, at, page, archive, place) in enumerate(keys):  # each archive's rows come sorted
            runs.setdefault(archive, []).append((key, at, page is not None, page or 0, archive, place, i))
        taken = rows_of.take(pa.array([row[-1] for row in LoserTree([runs[a] for a in sorted(runs)])]))
        taken = taken.append_column("_part", pa.array([part] * len(keys), pa.int64())).append_column("_at", pa.array(range(len(keys)), pa.int64()))
        yield from taken.to_batches()

    parts = max(1, -(-index.count() // rows))
    ranged = index.repartitionByRange(parts, *order).sortWithinPartitions("archive", *order)  # run by run
    out = staged(map_arrow(ranged, run, StructType([*index.schema.fields, StructField("_part", LongType()), StructField("_at", LongType())])))
    parts_before = staged(running_total(out.groupBy("_part").count(), "_part", "count", "_before").select(F.col("_part").alias("_p"), "_before"))
    return (dimension_join(out, parts_before, F.col("_part") == F.col("_p"))
            .select(*index.columns, (F.col("_before") + F.col("_at")).alias("index_pos")))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archives(planned(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{folder}/archives")
    index = merged(staged(read_archives(spark, f"{folder}/archives")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "index_pos")
