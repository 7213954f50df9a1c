"""Vector codes: exact k-means over parts, by metric trees of the anchors hierarchy.

A vector is cut into equal consecutive parts, and each part position has a codebook.  Rows lie
in chunks; a chunk has one tree of balls for each part.  A tree is built middle out: about
sqrt(n) anchors are spread, each new one at the point farthest from its own anchor, and takes
the points nearer to it (the triangle inequality tells which ones need no look); anchors are
merged in pairs to the smallest balls up to the root, and each anchor is split further in the
same way.  A ball caches the count and the sum of its points.

An assignment descends with lists of candidate entries: a ball inherits its parent's, drops the
entries that another one beats for every point of the ball, and adds its cached sum and count at
once when one entry is left, so it is wholly owned.  Only points of leaves still contested are
compared one by one.  Trees are built once, staged, and serve all rounds; a round shuffles one
row for each task and entry.

Everything is whole-numbered: distances between points and entries are exact in doubles (see
`checked`), bounds of balls are taken with a margin, so ties always reach the comparison of
points and go to the lower index.

Defined cases: rows whose vector is null, has a null or non-finite component, or a length that
is no positive multiple of the parts or differs from that of the first kept row are left out;
with fewer rows than entries each row is an entry; null ids come last, equal ids in the order of
their vectors; equal vectors get equal codes; repeated rows stay; null labels are one label; an
empty table gives no rows; other columns are left out.  Components beyond what `checked` allows
are an error.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.llm.common import dimension_join, map_arrow, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CHUNK_ROWS, LEAF_ROWS = 4096, 16


# ---- trees ---------------------------------------------------------------------------------

def spread(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor (0 and up) that owns each point."""
    owner, pivots = np.zeros(len(points), np.int64), points[:1]
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(pivots) < most:
        x = int(far.argmax())
        if far[x] == 0:
            break
        half = np.sqrt(((pivots - points[x]) ** 2).sum(1)) / 2
        near = np.flatnonzero(far > half[owner])  # no other point can be nearer to the new anchor
        new = np.sqrt(((points[near] - points[x]) ** 2).sum(1))
        taken = new < far[near]
        near, new = near[taken], new[taken]
        owner[near], far[near] = len(pivots), new
        pivots = np.concatenate([pivots, points[x:x + 1]])
    return owner


def merged(balls: list[tuple]) -> tuple:
    """One ball (centre, radius, count, left, right) over all, joining the two of the smallest ball first."""
    centre = np.array([b[0] for b in balls])
    radius, count = np.array([b[1] for b in balls]), np.array([float(b[2]) for b in balls])

    def with_one(i: int) -> np.ndarray:
        weight = count / (count + count[i])
        gap = np.sqrt(((centre - centre[i]) ** 2).sum(1))
        size = np.maximum(gap * (1 - weight) + radius, gap * weight + radius[i])
        size[i] = np.inf
        return size

    nodes, alive = list(balls), len(balls)
    sizes = np.array([with_one(i) for i in range(len(balls))])
    while alive > 1:
        i, j = divmod(int(sizes.argmin()), len(nodes))
        size, n = float(sizes[i, j]), count[i] + count[j]
        centre[i] = (centre[i] * count[i] + centre[j] * count[j]) / n
        radius[i], count[i] = size, n
        nodes[i] = (centre[i].copy(), size, int(n), nodes[i], nodes[j])
        nodes[j] = None
        sizes[j], sizes[:, j] = np.inf, np.inf
        row = with_one(i)
        row[[k for k, b in enumerate(nodes) if b is None]] = np.inf
        sizes[i], sizes[:, i] = row, row
        alive -= 1
    return next(b for b in nodes if b is not None)


def grown(points: np.ndarray, rows: np.ndarray, leaf: int) -> tuple:
    """The ball of these rows: (centre, radius, count, left, right), or (centre, radius, count, rows, None) for a leaf."""
    own = points[rows]
    if len(rows) > leaf:
        owner = spread(own, int(np.ceil(np.sqrt(len(rows)))))
        if owner.any():
            return merged([grown(points, rows[owner == k], leaf) for k in range(owner.max() + 1) if (owner == k).any()])
    centre = own.mean(0)
    return centre, float(np.sqrt(((own - centre) ** 2).sum(1).max())), len(rows), rows, None


class Tree:
    """Balls in flat arrays; a ball's points are rows[first:last], `left` is -1 for a leaf."""

    def __init__(self, first, last, left, right, rows, points):
        self.first, self.last, self.left, self.right, self.rows = first, last, left, right, rows
        self.points = points  # in the order of `rows`
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)])
        self.sums, self.counts = total[last] - total[first], last - first
        self.centre = self.sums / self.counts[:, None]
        apart = points.astype(np.float64)
        self.radius = np.array([np.sqrt(((apart[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(first, last, self.centre)])

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        root = grown(points.astype(np.float64), np.arange(len(points)), leaf)
        first, last, left, right, rows, at = [], [], [], [], [], 0
        open_ = [(root, -1, False)]
        while open_:  # depth first, left before right, so that points of a ball lie together
            ball, parent, is_right = open_.pop()
            here = len(first)
            first.append(at)
            last.append(at + ball[2])
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (right if is_right else left)[parent] = here
            if ball[4] is None:
                rows.append(ball[3])
                at += ball[2]
            else:
                open_ += [(ball[4], here, True), (ball[3], here, False)]
        rows = np.concatenate(rows)
        return cls(*(np.array(x, np.int64) for x in (first, last, left, right)), rows, points[rows])

    def packed(self) -> bytes:
        return struct.pack("<III", len(self.first), *self.points.shape) + b"".join(
            x.astype("<i4").tobytes() for x in (self.first, self.last, self.left, self.right, self.rows, self.points))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        m, n, d = struct.unpack_from("<III", data)
        flat = np.frombuffer(data, "<i4", offset=12).astype(np.int64)
        return cls(*flat[:4 * m].reshape(4, m), flat[4 * m:4 * m + n], flat[4 * m + n:].reshape(n, d))


class Codebook:
    """Entries of one part with the gaps between them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.exact = entries.astype(np.float64)
        self.square = (self.exact ** 2).sum(1)
        self.gap = np.sqrt(np.maximum(0, self.square[:, None] + self.square - 2 * self.exact @ self.exact.T))

    def distances(self, points: np.ndarray) -> np.ndarray:
        p = points.astype(np.float64)
        return (p ** 2).sum(1)[:, None] - 2 * p @ self.exact.T + self.square

    def owners(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that are wholly owned and their entries; points (places in the tree) that are not in one and theirs."""
        balls, entries, points, theirs = [], [], [], []
        front, allowed = np.zeros(1, np.int64), np.ones((1, len(self.entries)), bool)
        while len(front):
            far = self.distances(tree.centre[front])
            margin = 1e-9 * (far.max(1) + self.square.max() + (tree.centre[front] ** 2).sum(1) + 1)
            far[~allowed] = np.inf
            best = far.argmin(1)
            reach = 2 * tree.radius[front][:, None] * self.gap[best]
            allowed = allowed & (far - far[np.arange(len(front)), best][:, None] <= reach * (1 + 1e-9) + margin[:, None])
            owned = allowed.sum(1) == 1
            balls.append(front[owned])
            entries.append(best[owned])
            leaf = ~owned & (tree.left[front] < 0)
            if leaf.any():
                lens = tree.counts[front[leaf]]
                at = np.concatenate([np.arange(tree.first[b], tree.last[b]) for b in front[leaf]])
                near = self.distances(tree.points[at])
                near[~np.repeat(allowed[leaf], lens, 0)] = np.inf
                points.append(at)
                theirs.append(near.argmin(1))
            inner = ~owned & ~leaf
            allowed = np.concatenate([allowed[inner]] * 2)
            front = np.concatenate([tree.left[front[inner]], tree.right[front[inner]]])
        none = [np.zeros(0, np.int64)]
        return tuple(np.concatenate(none + x) for x in (balls, entries, points, theirs))


# ---- jobs ----------------------------------------------------------------------------------

def checked(values: np.ndarray) -> None:
    """Doubles hold the distances exactly while 4 d x^2 stays below 2^53 for d components up to x."""
    most = float(np.abs(values).max(initial=0))
    if 4 * values.shape[1] * most * most >= 2.0 ** 53:
        raise ValueError(f"a component of {most} is too large for exact distances")


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v): whole-numbered vectors of the rows that can be coded."""
    v = F.col(f"`{vector}`")
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    sound = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.filter(sound).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), whole.alias("v"))


def trees(rows: DataFrame, dims: int, parts: int, chunk: int) -> DataFrame:
    """One row for each chunk: its vec_ids, its labels, and a packed tree for each part."""
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label")]

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks()
        values = batch.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        checked(values.reshape(-1, dims // parts))
        ends = pa.array([0, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, batch.column(c).combine_chunks().cast(k)) for c, k in zip(("vec_id", "label"), kinds)]
        packed = [Tree.of(np.ascontiguousarray(p)).packed() for p in np.split(values, parts, axis=1)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.list_(pa.binary()))], names=["vec_ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, chunk - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == chunk:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    names = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return map_arrow(rows, run, f"vec_ids array<{names[0]}>, labels array<{names[1]}>, trees array<binary>")


def sums(chunks: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): count and component sums of the parts assigned to each entry."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)  # a fixed number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        n = [np.zeros(len(b.entries), np.int64) for b in own]
        total = [np.zeros((len(b.entries), width), np.int64) for b in own]
        for batch in batches:
            for packed in batch.column("trees"):
                for p, data in enumerate(packed):
                    tree = Tree.unpacked(data.as_py())
                    balls, entries, points, theirs = own[p].owners(tree)
                    np.add.at(n[p], entries, tree.counts[balls])
                    np.add.at(total[p], entries, tree.sums[balls])
                    np.add.at(n[p], theirs, 1)
                    np.add.at(total[p], theirs, tree.points[points])
        for p, (count, s) in enumerate(zip(n, total)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(s[used, j]) for j in range(width))],
                names=["part", "entry", "n", *(f"s{j}" for j in range(width))])

    fields = [f"s{j}" for j in range(width)]
    each = map_arrow(chunks.select("trees"), run, "part int, entry int, n bigint, " + ", ".join(f"{f} bigint" for f in fields))
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in fields])


def coded(chunks: DataFrame, books: list[np.ndarray], kinds: list[str]) -> DataFrame:
    """(vec_id, label, code, error) of every row: the entries' numbers as two hex digits each."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in shared.value]
        for batch in batches:
            ids, labels = batch.column("vec_ids"), batch.column("labels")
            for k, packed in enumerate(batch.column("trees")):
                found, error = [], 0
                for p, data in enumerate(packed):
                    tree = Tree.unpacked(data.as_py())
                    balls, entries, points, theirs = own[p].owners(tree)
                    code = np.empty(len(tree.rows), np.int64)
                    for b, e in zip(balls.tolist(), entries.tolist()):
                        code[tree.first[b]:tree.last[b]] = e
                    code[points] = theirs
                    back = np.empty_like(code)
                    back[tree.rows] = code
                    away = np.empty_like(code)
                    away[tree.rows] = ((tree.points - own[p].entries[code]) ** 2).sum(1)
                    found.append(back)
                    error = error + away
                digits = np.stack(found, 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids[k].values, labels[k].values, pa.array([r.tobytes().hex() for r in digits]), pa.array(error)],
                                                 names=["vec_id", "label", "code", "error"])

    return map_arrow(chunks, run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compressed(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
               entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the final codebook of each part (at most 256 entries)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = kept(vectors, vec_id, vector, label, parts, scale)
    by_id = (F.asc_nulls_last("vec_id"), "v")
    first = rows.orderBy(*by_id).limit(entries).collect()
    dims = len(first[0].v) if first else parts
    rows = rows.filter(F.size("v") == dims)
    if any(len(r.v) != dims for r in first):
        first = rows.orderBy(*by_id).limit(entries).collect()
    start = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    checked(start.reshape(-1, dims // parts))
    books = [np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)]
    chunks = staged(trees(rows, dims, parts, chunk))
    for _ in range(rounds):
        for r in sums(chunks, books, dims // parts).collect():  # one row for each entry
            books[r.part][r.entry] = [r[3 + j] // r.n for j in range(dims // parts)]
    return coded(chunks, books, [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    found = staged(found)
    of = staged(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return (dimension_join(found, of, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
