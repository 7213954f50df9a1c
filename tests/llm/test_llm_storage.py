"""Fill-in-middle cuts, exact dedup and vector codes against plain forms on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import anchors, gracededup, skiplist

SCHEMA = "doc_id bigint, text string, row string, rec bigint, n bigint, form string, id string"
TEXTS = ["", None, " \n\t", "a", "ab", "a b", "a  b", "ba", "<P> x", "x<S>", "é🙂é İ", "日本語 テキスト", "word " * 40_000, "wo rd" * 40_000, "x y", "xy",
         *(f"the {i} quick brown fox jumps over the lazy dog" for i in range(30))]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "r", 1, None, "psm", "x") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "a b", None, None, None, None, None), (None, None, None, None, None, None, None), (100, "a\nb ", "r", 1, 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


# ---- fill in the middle ------------------------------------------------------------------

def brute_form(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return len(t), *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_forms_equal_plain_slicing_and_are_restored(spark, odd):
    made = skiplist.transformed(odd).withColumn("back", skiplist.restored(F.col("output"), F.col("form")))
    got = Counter(tuple(r) for r in made.collect())
    want = Counter((r.doc_id, *brute_form(r.doc_id, r.text), r.text or "") for r in odd.collect())
    assert got == want
    assert {"plain", "psm", "spm"} == {r.form for r in made.select("form").distinct().collect()}
    assert skiplist.transformed(odd.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [2, 5, 16])
def test_every_rank_is_found_in_units_of_any_width(spread):
    rng = random.Random(spread)
    for n in (0, 1, 2, 17, 400, 3000):
        widths = np.array([rng.choice((1, 1, 2, 3, 9)) for _ in range(n)], np.int64)
        cuts = skiplist.SkipList(widths, np.random.default_rng(n), spread)
        ends = [0, *np.cumsum(widths).tolist()]
        assert [cuts.at(r) for r in range(n + 1)] == ends


def test_units_of_a_pattern_are_never_cut(spark, odd):
    pattern = r"\s*\S+"
    rows = {(r.doc_id, r.output, r.form, r.prefix_chars, r.middle_chars) for r in skiplist.transformed(odd, unit=pattern).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    for doc_id, output, form, a, m in rows:
        if form == "plain" or doc_id is None:
            continue
        t = texts[doc_id]
        ends = [0, *[x.end() for x in re.finditer(pattern, t)][:-1], len(t)]
        assert a in ends and a + m in ends


# ---- exact dedup -------------------------------------------------------------------------

def brute_groups(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = Counter()
    for content, members in by.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out[(m[3], members[0][3], len(members), k == 0, hashlib.sha256(content.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("limit", [300, 64 << 20])
def test_groups_match_brute_force_at_every_depth(spark, odd, limit):
    got = Counter(tuple(r) for r in gracededup.groups(odd.repartition(7), limit=limit).collect())
    assert got == brute_groups([(r.doc_id, r.text) for r in odd.collect()])


def test_a_hot_text_over_many_blocks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same  text")).otherwise(
        F.concat(F.lit("text "), (F.col("id") % 700).cast("string"))).alias("text")).repartition(90)
    got = Counter(tuple(r) for r in gracededup.groups(docs, limit=120).collect())
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_one_row_of_each_group_stays_with_its_columns(spark, odd):
    left = gracededup.without_copies(odd)
    assert left.columns == odd.columns
    got = left.collect()
    want = {k[0:1] + k[4:] for k in brute_groups([(r.doc_id, r.text) for r in odd.collect()]) if k[3]}
    assert len(got) == len(want) and {r.doc_id for r in got} == {k[0] for k in want}
    assert not (Counter(map(tuple, got)) - Counter(map(tuple, odd.collect())))
    assert gracededup.without_copies(odd.limit(0)).count() == 0 and gracededup.groups(odd.limit(0)).count() == 0


def test_equal_hashes_are_told_apart_by_content():
    t = gracededup.ContentTable()
    found = [t.entry(7, c) for c in (b"x", b"y", b"x", b"", b"y", b"")]
    assert found == [0, 1, 0, 2, 1, 2]
    many = [str(i % 5000).encode() for i in range(20_000)]
    assert [t.entry(int(c) % 50, c) - 3 for c in many] == [i % 5000 for i in range(20_000)]


# ---- vector codes ------------------------------------------------------------------------

def brute_codes(rows, parts=4, entries=256, rounds=4):
    keep = [(i, v, lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(x * 1024) for x in r[1]]))
    keep = [r for r in keep if len(r[1]) == len(keep[0][1])]
    whole = np.array([[math.floor(x * 1024) for x in v] for _, v, _ in keep], np.int64)
    out, error, text = [""] * len(keep), np.zeros(len(keep), np.int64), []
    for p in np.split(whole, parts, axis=1):
        book = p[:entries].copy()
        for turn in range(rounds + 1):
            far = ((p[:, None, :] - book[None]) ** 2).sum(2)
            code = far.argmin(1)
            if turn < rounds:
                for e in range(len(book)):
                    if (code == e).any():
                        book[e] = p[code == e].sum(0) // (code == e).sum()
        out = [o + f"{c:02x}" for o, c in zip(out, code)]
        error += far[np.arange(len(p)), code]
        text += book.ravel().tolist()
    by_label = Counter()
    for (_, _, lab), e in zip(keep, error):
        by_label[lab] += int(e)
    digest = hashlib.sha256(",".join(map(str, text)).encode()).hexdigest()
    return Counter((i, o, int(e), by_label[lab], digest) for (i, _, lab), o, e in zip(keep, out, error))


def vector_rows(n, d=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (12, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(0, rng.choice([0.0, 0.01, 0.2]), d)
        rows.append((int(i * 7 % n), [float(np.float32(x)) for x in v], int(rng.integers(5)) if i % 11 else None))
    return rows


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, part int, trees string"


@pytest.mark.parametrize("n, chunk", [(700, 4096), (700, 100), (90, 33), (1, 8)])
def test_codes_match_brute_force(spark, tmp_path, n, chunk):
    rows = vector_rows(n)
    if n > 1:
        rows += [rows[3], rows[3], (None, rows[5][1], None), (n + 1, None, 1), (n + 2, [], 1), (n + 3, [1.0] * 63, 1), (n + 4, [1.0] * 60, 1),
                 (n + 5, [math.nan] * 64, 1), (n + 6, [math.inf] + [0.0] * 63, 1), (n + 7, [None] + [0.0] * 63, 1)]
    df = spark.createDataFrame([(*r, "c", 1, "t") for r in rows], VECTORS)
    found, books = anchors.compressed(df.repartition(3), chunk=chunk)
    got = Counter((r.vec_id, r.code, r.error) for r in found.collect())
    want = brute_codes(rows)
    assert got == Counter({k[:3]: 0 for k in want}) + Counter(k[:3] for k in want.elements())
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(tuple(r) for r in anchors.op13_vector_codes(spark, str(tmp_path)).collect()) == want


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert anchors.op13_vector_codes(spark, str(tmp_path)).count() == 0


def test_equal_vectors_far_values_and_narrow_parts(spark):
    rows = [(i, [1.0, -2.5, 3.0, 0.125], i % 2) for i in range(500)] + [(1000 + i, [1000.0 + i, 0.0, -1000.0, i / 7], None) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found, _ = anchors.compressed(df, chunk=256)
    assert Counter((r.vec_id, r.code, r.error) for r in found.collect()) == Counter(k[:3] for k in brute_codes(rows).elements())
    with pytest.raises(Exception, match="too large"):
        anchors.compressed(spark.createDataFrame([(1, [1e12, 0.0, 0.0, 0.0], 1)], "vec_id bigint, embedding array<double>, label int"))


def test_balls_are_owned_where_points_are_close_to_an_entry():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-20, 20, (300, 8)) + c for c in (0, 4000, -9000)])
    tree = anchors.Tree.unpacked(anchors.Tree.of(points).packed())
    balls, entries, places, theirs = anchors.Codebook(np.array([[0] * 8, [4000] * 8, [-9000] * 8, [9000] * 8])).owners(tree)
    assert len(places) == 0 and tree.counts[balls].sum() == len(points) and len(balls) <= 12
    assert np.array_equal(tree.sums[0], points.sum(0)) and sorted(tree.rows.tolist()) == list(range(len(points)))
