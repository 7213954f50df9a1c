"""Near-duplicate classes by DartMinHash signatures and exact verification.

A document is the set of its five-word shingles (or, weighted, their counts).  Darts fall
on the plane of an element's weight and a rank, one per unit of area on average, placed by
hashes of the element alone; those that land below the element's weight belong to the
document.  Each dart names one of k coordinates, and a coordinate keeps its earliest dart,
so two documents agree in a coordinate with the probability of their weighted Jaccard
similarity.  Only about k ln k + 2 k darts are looked at, whatever the length of the text.

Signatures are cut into bands; documents that share a band meet in a bucket.  A bucket never
gives all its pairs: in a small one a centre is compared with all members.  Then, where a bucket
still has members of different classes, their sketches (one byte of each coordinate) are compared
inside the bucket's task, and a member asks for a few verifications a round, of its nearest
members in other classes, so rows are proportional to members; a bucket of more than MOST members
is compared block by block.  Classes merge after each round; the last round asks for all that is
left.  Every link is verified on whole shingle sets.

With 40 bands of 6, a pair of similarity 0.8 shares no band with probability 6e-6; its sketches
agree in less than NEAR of the coordinates (three deviations below) with probability 1e-3, and
less the more similar it is; in the last round FINER more coordinates of the members that are still
open narrow that, so few pairs below the wanted similarity are verified.  exact=True leaves the sketches out and refutes all pairs of a bucket in
different classes, but those that cannot share enough elements; its rows grow with their number.

Equal sets are one node from the start, so copies are never expanded.  Nodes, buckets, links
and classes stay in tables; nothing of them goes through the driver but counts.

Defined cases: a text of 1 to 4 words is one shingle; a null text or one without a word is a
class of its own; rows equal in text are one class, also with a null or repeated id; the class
id is the least id in the class, null if it has none; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_ROWS, WORD, dimension_join, forget, map_arrow, slices, staged, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
STAR = 8  # buckets up to this size begin with one star
DEVIATIONS = 3  # how far below the wanted similarity sketches may fall
FINER = 1200  # coordinates more of members that are still open in the last round
ASKED = (2, 8, 0)  # partners a member of an open bucket asks for in each round, 0 for all
MOST = 8192  # members of a bucket that are compared in one piece
GROWTH = 4  # a bucket has one centre in the first round and so many times more in each later one
KEPT_WORDS = 150_000
POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 18)])])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


def shingles(words: list[str], known: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles in ascending order, and how often each occurs."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    s = np.full(n, len(h) < size and len(h), np.uint64)
    for k in range(min(size, len(h))):
        s = mixed(s + h[k:k + n] * GOLDEN)
    return np.unique(s, return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Earliest dart per coordinate (its 64-bit name); needs an element of positive weight."""
    wanted = k * np.log(k) + 2 * k
    while True:
        limit = wanted / weights.sum()
        high, wide = max(1, int(np.ceil(limit))), np.ceil(weights).astype(np.int64)
        cells = np.repeat(np.arange(len(elements)), wide * high)
        place = np.arange(len(cells)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
        column, row = place // high, place % high  # unit of weight, unit of rank
        seed = mixed(elements[cells] + GOLDEN * (column.astype(np.uint64) << np.uint64(32) | row.astype(np.uint64)))
        count = np.searchsorted(POISSON, (mixed(seed ^ GOLDEN) >> np.uint64(11)) / float(1 << 53))
        at = np.repeat(np.arange(len(cells)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mixed(seed[at] + GOLDEN * (nth + 1).astype(np.uint64))
        spot = mixed(dart + GOLDEN)
        rank = row[at] + (spot >> np.uint64(32)) / float(1 << 32)
        lands = (column[at] + (spot & np.uint64(0xFFFFFFFF)) / float(1 << 32) < weights[cells[at]]) & (rank <= limit)
        dart, rank = dart[lands], rank[lands]
        order = np.argsort(-rank, kind="stable")  # the earliest is written last and stays
        kept, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        coordinate = (mixed(dart ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(k)).astype(np.int64)[order]
        kept[coordinate], filled[coordinate] = dart[order], True
        if filled.all():
            return kept
        wanted *= 2


def band_keys(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for column in kept.reshape(bands, rows).T:
        key = mixed(key + column)
    return key.view(np.int64)


def signed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, text_md5, node (digest of its shingles, null without words), size (total weight), band keys and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = Words(), re.compile(WORD).findall
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, sizes, keys, sketches = [], [], [], []
                for t in part.column("text").to_pylist():
                    elements, counts = shingles(find(t or ""), known)
                    weights = counts.astype(np.float64) if weighted else np.ones(len(elements))
                    nodes.append(xxhash.xxh3_128_digest(elements.tobytes() + weights.tobytes()) if len(elements) else None)
                    sizes.append(float(weights.sum()))
                    found = signature(elements, weights, bands * rows) if len(elements) else None
                    keys.append(None if found is None else band_keys(found, bands, rows))
                    sketches.append(None if found is None else (found & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_md5"), pa.array(nodes, pa.binary()), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "text_md5", "node", "size", "keys", "sketch"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_md5"), F.col(text).alias("text"))
    return map_arrow(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_md5 string, node binary, size double, keys array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, *, text: str = "text", weighted: bool = False) -> DataFrame:
    """(node, elements, weights) of the rows with words, as packed 64-bit hashes and doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = Words(), re.compile(WORD).findall
        for batch in batches:
            for part in slices(batch, "text"):
                made = []
                for t in part.column("text").to_pylist():
                    elements, counts = shingles(find(t or ""), known)
                    weights = counts.astype(np.float64) if weighted else np.ones(len(elements))
                    if len(elements):
                        made.append((xxhash.xxh3_128_digest(elements.tobytes() + weights.tobytes()), elements.tobytes(), weights.tobytes() if weighted else b""))
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.binary()) for k in range(3)], names=["node", "elements", "weights"])

    return map_arrow(docs.select(F.col(text).alias("text")), run, "node binary, elements binary, weights binary")


def similarity(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets; weights are 1 where none are given."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not wa:
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common / (len(both) - common)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    u, v = np.frombuffer(wa, np.float64), np.frombuffer(wb, np.float64)
    common = float(np.minimum(u[i], v[j]).sum())
    return common / (u.sum() + v.sum() - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are at least so similar, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("ea", "wa", "eb", "wb")]
            keep = [similarity(*(c[i].as_py() for c in cols)) >= least for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = staged(pairs.select(F.col("a").alias("_n")).union(pairs.select("b")).distinct())
    sets = dimension_join(sets, needed, F.col("node") == F.col("_n"), "left_semi")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb")).hint("merge"), "b")
    out = staged(map_arrow(both.select("a", "b", "ea", "wa", "eb", "wb"), run, "a binary, b binary"))
    forget(needed)
    return out


def common_at_most(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, common): the weight of a node's elements that any other of the nodes has too.

    No other node can share more, which bounds the similarity without looking at pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, elements, weights in zip(*(batch.column(c).to_pylist() for c in ("node", "elements", "weights"))):
                x = np.frombuffer(elements, np.int64)
                w = np.frombuffer(weights, np.float64) if weights else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(x), pa.binary()), pa.array(x), pa.array(w)], names=["node", "element", "weight"])

    wanted = nodes.select(F.col("node").alias("_n"))
    each = map_arrow(dimension_join(sets, wanted, F.col("node") == F.col("_n"), "left_semi").select("node", "elements", "weights"), run, "node binary, element bigint, weight double")
    alone = (each.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight"))
             .filter("n = 1").groupBy("node").agg(F.sum("weight").alias("alone")))
    return nodes.join(alone.hint("merge"), "node", "left").select("node", F.coalesce("alone", F.lit(0.0)).alias("alone"))


def agreement(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of each of my sketches with each of theirs."""
    if len(mine) * len(theirs) <= 4096:
        return (mine[:, None] == theirs[None]).mean(2, dtype=np.float32)
    same = np.zeros((len(mine), len(theirs)), np.uint16)
    for a, b in zip(np.ascontiguousarray(mine.T), np.ascontiguousarray(theirs.T)):
        same += a[:, None] == b
    return same / np.float32(mine.shape[1])


def nearest(part: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, band: int, rows: int, near: float, least: float,
            asked: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that may be links: for each member outside the largest class its `asked` (or all) nearest in other classes.

    A pair counts in the first band that it shares.  Members of side 1 and 2 are met across the sides only.
    """
    classes, own = np.unique(part, return_inverse=True)
    open_ = np.flatnonzero(own != np.bincount(own).argmax()) if len(classes) > 1 else np.zeros(0, np.int64)
    left, right = [], []
    step = max(1, (4 << 20) // len(part))
    for at in range(0, len(open_), step):
        mine = open_[at:at + step]
        alike = agreement(sketch[mine], sketch)
        able = (alike >= near) & (own[mine][:, None] != own) & (np.minimum(size[mine][:, None], size) >= least * np.maximum(size[mine][:, None], size))
        able &= (side[mine][:, None] != side) | (side[mine][:, None] == 0)
        row, col = np.nonzero(able)
        earlier = (sketch[mine[row], :band * rows] == sketch[col, :band * rows]).reshape(len(row), band, rows).all(2).any(1)
        row, col = row[~earlier], col[~earlier]
        if asked:
            order = np.lexsort((-alike[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < asked], col[place < asked]
        left.append(mine[row])
        right.append(col)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + left), np.concatenate(none + right)


def finer(seen: DataFrame, sets: DataFrame, coordinates: int = FINER) -> DataFrame:
    """Add `more` to the rows (node, ...): bytes of so many coordinates more, of other darts than the bands'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for elements, weights in zip(batch.column("elements").to_pylist(), batch.column("weights").to_pylist()):
                x = np.frombuffer(elements, np.uint64)
                w = np.frombuffer(weights, np.float64) if weights else np.ones(len(x))
                made.append((signature(mixed(x ^ GOLDEN), w, coordinates) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "more"])

    needed = staged(seen.select(F.col("node").alias("_n")).distinct())
    own = staged(map_arrow(dimension_join(sets, needed, F.col("node") == F.col("_n"), "left_semi").select("node", "elements", "weights"), run, "node binary, more binary"))
    return seen.join(own.hint("merge"), "node")


def likely(seen: DataFrame, *, least: float, asked: int, bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """Pairs (a, b) that may be links, of open buckets: rows (key, band, node, size, part, sketch) and `more`, if it is there."""
    def bound(coordinates: int) -> float:
        return least - DEVIATIONS * float(np.sqrt(least * (1 - least) / coordinates))

    near = bound(bands * rows)
    if "more" not in seen.columns:
        seen = seen.withColumn("more", F.lit(None).cast("binary"))
    names = ["key", "band", "node", "size", "part", "sketch", "more"]
    counts = staged(seen.groupBy("key").count().filter(F.col("count") > most).select(F.col("key").alias("_key"), F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    sides = seen.withColumn("side", F.lit(0)).withColumn("cell", F.lit(0))
    if not counts.isEmpty():  # cells of two blocks each, in which every two members of a bucket meet
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
            (F.least(mine, k) * F.col("blocks") + F.greatest(mine, k)).alias("cell"),
            F.when(mine == k, 0).when(mine < k, 1).otherwise(2).alias("side")))
        split = dimension_join(seen, counts, F.col("key") == F.col("_key")).select(*names, F.inline(cells)).select(*names, "side", "cell")
        sides = dimension_join(sides, counts, F.col("key") == F.col("_key"), "left_anti").unionByName(split)
    # the blocks of a diagonal cell are compared inside, as side 0; others across

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(own: list[tuple]) -> pa.RecordBatch:
            nodes = [r[2] for r in own]
            i, j = nearest(np.array([r[4] for r in own]), np.array([r[3] for r in own]), np.array([np.frombuffer(r[5], np.uint8) for r in own]),
                           np.array([r[6] for r in own]), own[0][7], rows, near, least, asked)
            if len(i) and own[0][8] is not None:
                whole = np.array([np.frombuffer(r[5] + r[8], np.uint8) for r in own])
                alike = np.concatenate([(whole[i[k:k + 8192]] == whole[j[k:k + 8192]]).mean(1) for k in range(0, len(i), 8192)])
                close = alike >= bound(whole.shape[1])
                i, j = i[close], j[close]
            found = {(nodes[x], nodes[y]) if nodes[x] < nodes[y] else (nodes[y], nodes[x]) for x, y in zip(i.tolist(), j.tolist())}
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "node", "size", "part", "sketch", "side", "band", "more"))):
                if held and held[-1][:2] != row[:2]:
                    yield pairs(held)
                    held = []
                held.append(row)
        if held:
            yield pairs(held)

    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sides.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "node", "size", "part", "sketch", "side", "band", "more")
    return map_arrow(dealt, run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in (a, b): the least node of the connected part.

    Labels spread to neighbours and then jump to their label's label, so a path shrinks by half
    a round; a node with very many links is met by an equi-join and a pre-aggregated minimum.
    Labels are broadcast where few nodes have links, by their count, and else shuffled.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = old = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    how = "broadcast" if labels.count() <= BROADCAST_ROWS else "merge"
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label").hint(how), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = near.join(labels.hint(how), "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        jumped = (spread.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")).hint(how), "next")
                  .select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("old")).alias("moved")))
        jumped = staged(jumped)
        forget(old)
        old, labels = jumped, jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            forget(both)
            return labels


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the labels that the links join are relabelled."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = staged(ends.join(labels.hint("merge"), "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    how = "broadcast" if every.count() <= BROADCAST_ROWS else "merge"
    of = every.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    pairs = links.join(every.select(F.col("node").alias("a"), F.col("label").alias("_la")).hint(how), "a").join(of.hint(how), "b")
    pairs = staged(pairs.filter("_la != _lb").select(F.col("_la").alias("a"), F.col("_lb").alias("b")).distinct())
    if pairs.isEmpty():
        return every
    merged = components(pairs).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return staged(every.join(merged.hint(how), "label", "left").select("node", F.coalesce("_to", "label").alias("label")))


def linked(signs: DataFrame, docs: DataFrame, *, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id",
           weighted: bool = False, exact: bool = False, growth: int = GROWTH, bands: int = BANDS, rows: int = ROWS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, first: least id) and the label of each node that has a link.  `signs` is staged."""
    nodes = staged(signs.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    met = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = met.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = staged(met.join(shared.hint("merge"), "key"))

    def close(size: str, other: str):
        return F.least(size, other) >= least * F.greatest(size, other)

    firsts = nodes.select(F.col("node").alias("centre"), F.col("size").alias("centre_size"))
    pairs = buckets.filter(F.col("n") <= STAR).filter("node != centre").select(F.col("centre"), "node", "size").distinct()
    pairs = staged(pairs.join(firsts.hint("merge"), "centre").filter(close("size", "centre_size")).select(F.col("centre").alias("a"), F.col("node").alias("b")))
    ids = staged(buckets.select("node").distinct().join(nodes.select("node", "first").hint("merge"), "node").select(F.col("first").alias("_first")).distinct())
    sets = staged(shingle_sets(
        dimension_join(docs.select(doc_id, text), ids, F.col(doc_id).eqNullSafe(F.col("_first")), "left_semi"), text=text, weighted=weighted)
        .groupBy("node").agg(F.first("elements").alias("elements"), F.first("weights").alias("weights")))
    links = verified(pairs, sets, least)
    labels = components(links)
    rest, met_before = buckets.filter((F.col("n") > STAR) | (F.col("node") != F.col("centre"))).select("key", "band", "node", "size"), pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for asked in () if exact else ASKED:
        of = labels.select(F.col("node").alias("_n"), "label")
        seen = dimension_join(rest, of, F.col("node") == F.col("_n"), "left").select("key", "band", "node", "size", F.coalesce("label", "node").alias("part"))
        mixed_up = seen.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("key")
        seen = staged(seen.join(mixed_up.hint("merge"), "key").join(nodes.select("node", "sketch").hint("merge"), "node"))
        if not asked:
            seen = staged(finer(seen, sets))
        again = staged(likely(seen, least=least, asked=asked, bands=bands, rows=rows, most=most).join(met_before.hint("merge"), ["a", "b"], "left_anti"))
        forget(seen)
        if again.isEmpty():
            break
        met_before = met_before.union(again)
        more = verified(again, sets, least)
        if not more.isEmpty():
            labels = joined_by(labels, more)
        forget(more)
    if not exact:
        return nodes.select("node", "first"), labels
    open_ = None
    for turn in count():
        most = growth ** turn
        seen = rest.join(labels.hint("merge"), "node", "left").select("key", "node", "size", "label", F.coalesce("label", "node").alias("part"))
        mixed_up = seen.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("key")
        seen = staged(seen.join(mixed_up.hint("merge"), "key"))
        if seen.isEmpty():
            return nodes.select("node", "first"), labels
        # what a node can share at all decides whether it can have a link to a node not yet compared
        members = staged(seen.select("node").distinct())
        bound = staged(common_at_most(members, sets))
        able = seen.join(bound.hint("merge"), "node").withColumn("common", F.col("size") - F.col("alone")).filter(F.col("common") >= least * F.col("size") - 1e-6)
        order = Window.partitionBy("key").orderBy(F.col("label").isNull(), F.col("alone") / F.col("size"), "node")  # linked and plain members reach further
        before = open_
        open_ = staged(able.withColumn("at", F.row_number().over(order)))
        forget(seen, members, bound, *([before] if before is not None else []))
        centre = open_.filter(F.col("at") <= most).select("key", *[F.col(c).alias(f"{c}0") for c in ("node", "at", "part", "size", "common")])
        near = (1 + least) * F.least("common", "common0") >= least * (F.col("size") + F.col("size0")) - 1e-6
        again = (open_.join(centre.hint("merge"), "key").filter("at > at0 and part != part0").filter(close("size", "size0") & near)
                       .select(F.least("node0", "node").alias("a"), F.greatest("node0", "node").alias("b")).distinct())
        again = staged(again.join(met_before.hint("merge"), ["a", "b"], "left_anti"))
        met_before = met_before.union(again)
        more = verified(again, sets, least)
        if not more.isEmpty():
            labels = joined_by(labels, more)
        forget(more)
        rest = open_.filter(F.col("at") > most).select("key", "node", "size")


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: doc_id, text_md5, class_id (least id in its class), class_texts (different
    shingle sets in it), node and class_node (null without words)."""
    keys = {k: options.pop(k) for k in ("bands", "rows") if k in options}
    signs = staged(signed(docs, text=text, doc_id=doc_id, weighted=options.get("weighted", False), **keys))
    nodes, labels = linked(signs, docs, text=text, doc_id=doc_id, **keys, **options)
    named = staged(nodes.join(labels.hint("merge"), "node", "left").select("node", "first", "label"))
    of = staged(named.filter("label is not null").groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("class_id"), F.count("*").alias("class_texts")))
    named = staged(dimension_join(named, of, F.col("label") == F.col("_label"), "left").select(
        "node", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("class_id")).alias("class_id"), "class_texts", F.coalesce("label", "node").alias("class_node")))
    return (signs.select("doc_id", "text_md5", "node").join(named.hint("merge"), "node", "left")
            .select("doc_id", "text_md5", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_texts", F.lit(1)).alias("class_texts"), "node", "class_node"))


def one_each(docs: DataFrame, **options) -> DataFrame:
    """Docs with one row of each class: that of the least id, then of the least text digest.

    What is joined to the texts are the rows to leave out, by id and text digest, so texts stay
    where they are unless very many go.  Rows equal in id and text count once.
    """
    found = staged(classes(docs.select("doc_id", "text"), **options))
    rows = found.groupBy("doc_id", "text_md5", "class_node").count()
    best = staged(rows.filter("class_node is not null").groupBy(F.col("class_node").alias("_class")).agg(F.min(F.struct("doc_id", "text_md5")).alias("best"), F.count("*").alias("_rows"))
                  .filter("_rows > 1").select("_class", "best"))
    rows = staged(dimension_join(rows, best, F.col("class_node") == F.col("_class"), "left").select(
        F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), F.col("count").alias("_n"),
        (F.col("best").isNull() | F.struct("doc_id", "text_md5").eqNullSafe(F.col("best"))).alias("_stays")))
    d = docs.withColumn("_text_md5", F.md5("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text_md5").eqNullSafe(F.col("_md5"))
    out = dimension_join(d, staged(rows.filter("not _stays").select("_id", "_md5")), same, "left_anti")
    again = staged(rows.filter("_stays and _n > 1 and _md5 is not null").select("_id", "_md5"))
    if not again.isEmpty():
        out = dimension_join(out, again, same, "left_anti").union(dimension_join(out, again, same, "left_semi").dropDuplicates(["doc_id", "_text_md5"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts")
