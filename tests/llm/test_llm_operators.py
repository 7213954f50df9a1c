"""The training-data operators against brute force, SQL and exact round trips on small fixtures."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bpe, chunks, dartminhash, langid, licenses, mixing, quality, rans, sharding, suite, warc
from rasterloom.llm.common import runs, shared_folder, staged

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", " \n\t", "one", "a b c", "x\n\nx\n x", "It's  DON'T ''s!'s", "日本語 テキスト ΣΑΣ", "é é İ 🙂🙂", "<|endoftext|> \x1c\x85",
       "a a a a a a a a", "word " * 5000, "\r\n\r\nWARC/1.1\r\n", "#*$%&|<>!?"]


def rows_of(texts, **more):
    return [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = rows_of([*ODD, None, "word " * 5000, *(f"the {i} quick brown fox jumps over the lazy dog {i % 5}" for i in range(20))])
    rows += [rows[5], rows[5], (None, "a lonely text", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = suite.QUERIES[name](spark, SF)
    cur = con.execute(suite.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def rounded(row):
        return tuple(round(x, 6) if isinstance(x, float) else x for x in row)

    assert Counter(rounded(tuple(r[c] for c in cols)) for r in df.collect()) == Counter(map(rounded, cur.fetchall()))


# ---- mixing ------------------------------------------------------------------------------

def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            goal[s] += share * w[s]
            if goal[s] >= 2 * sizes[s]:
                left += goal[s] - 2 * sizes[s]
                goal[s] = 2.0 * sizes[s]
                open_ = open_ - {s}
    return goal


def test_mix_reaches_targets_and_repeats_no_document_thrice(spark, odd):
    keyed = staged(mixing.with_keys(odd))
    out = mixing.take(keyed, staged(mixing.cuts(keyed))).collect()
    assert len(out) == odd.count()
    sizes = Counter()
    for r in out:
        n = len(WORDS.findall(r.text or ""))
        assert r.mix_size == n and r.taken == r.copies * n <= 2 * n
        sizes[r.source] += n
    goal = brute_targets(dict(sizes))
    most = Counter()
    for r in out:
        most[r.source] = max(most[r.source], r.mix_size)
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
    for s, target in goal.items():
        assert abs(sum(r.taken for r in out if r.source == s) - target) <= most[s]


def test_mix_repeats_rows_and_keeps_columns(spark, odd):
    clash = odd.withColumn("copies", F.lit("mine")).withColumn("mix_key", F.lit(7))
    a, b = (sorted(map(repr, mixing.mix(clash).collect())) for _ in range(2))
    assert a == b and mixing.mix(clash).columns == clash.columns
    assert mixing.mix(empty(odd)).count() == 0


# ---- near duplicates ---------------------------------------------------------------------

def brute_classes(texts, least=0.8):
    sets = {}
    for i, t in texts:
        w = WORDS.findall(t or "")
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common and common >= least * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_classes_match_brute_force(spark, documents):
    got = {r.doc_id: r.class_id for r in dartminhash.op2_near_duplicates(spark, SF).collect()}
    assert got == brute_classes([(i, t) for i, t, _, _ in documents])


def near_copies(n, most, words=150):
    """Texts of one base with up to `most` words changed, so their similarities spread over the wanted one."""
    rng = np.random.default_rng(1)
    base, rows = [f"w{i}" for i in range(words)], []
    for i in range(n):
        mine = list(base)
        for at in rng.choice(words, int(rng.integers(0, most)), replace=False):
            mine[at] = f"x{i}_{at}"
        rows.append((i, " ".join(mine)))
    return rows + [(n + i, rows[3][1]) for i in range(50)]


@pytest.mark.parametrize("options", [{"exact": True, "growth": 2}, {"exact": True, "growth": 64}, {}, {"most": 20}])
def test_classes_of_a_large_group_of_near_copies(spark, options):
    rows = near_copies(120, 6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.classes(df, **options).collect()}
    assert got == brute_classes(rows)


def test_sketches_lose_hardly_a_link_of_a_group_around_the_threshold(spark):
    rows = near_copies(500, 12)  # most pairs are between 0.5 and 0.9 similar
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.classes(df).collect()}
    want = brute_classes(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert len(set(want.values())) > 3 and all(want[i] == want[got[i]] for i in got)


def test_cells_of_two_blocks_meet_all_members(spark):
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 4, (60, 240)).astype(np.uint8)
    sketch[1::2] = sketch[::2]
    for most, band in ((7, 0), (60, 0), (60, 3)):
        seen = spark.createDataFrame([(7, band, bytes([i]), 100.0, bytes([i]), sketch[i].tobytes()) for i in range(60)],
                                     "key bigint, band int, node binary, size double, part binary, sketch binary")
        got = {(r.a[0], r.b[0]) for r in dartminhash.likely(seen, least=0.8, asked=0, most=most).collect()}
        assert got == ({(i, i + 1) for i in range(0, 60, 2)} if band == 0 else set())  # pairs count in the first band they share
    more = spark.createDataFrame([(7, 0, bytes([i]), 100.0, bytes([i]), sketch[i].tobytes(), bytes([0 if i % 4 < 2 else i]) * 1200) for i in range(60)],
                                 "key bigint, band int, node binary, size double, part binary, sketch binary, more binary")
    got = {(r.a[0], r.b[0]) for r in dartminhash.likely(more, least=0.8, asked=0).collect()}
    assert got == {(i, i + 1) for i in range(0, 60, 4)}  # the finer coordinates refuse the others


def test_signature_agrees_as_weighted_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    u = rng.uniform(0.1, 4, 60)
    v = u * rng.uniform(0.4, 1.6, 60)
    agree = (dartminhash.signature(x, u, 3000) == dartminhash.signature(x, v, 3000)).mean()
    assert agree == pytest.approx(np.minimum(u, v).sum() / np.maximum(u, v).sum(), abs=0.04)
    packed = dartminhash.similarity(np.sort(x).tobytes(), u.tobytes(), np.sort(x).tobytes(), v.tobytes())
    assert packed == pytest.approx(np.minimum(u, v).sum() / np.maximum(u, v).sum())


def test_one_document_of_each_class_stays(spark, odd):
    clash = odd.withColumn("class_id", F.lit(1)).withColumn("node", F.lit("mine"))
    kept = dartminhash.one_each(clash)
    assert kept.columns == clash.columns
    words = Counter(tuple(WORDS.findall(r.text or "")) for r in kept.collect())
    assert all(n == 1 for w, n in words.items() if w)
    everything = {tuple(WORDS.findall(r.text or "")) for r in odd.collect()}
    assert len(words) == len(everything) - 0 and set(words) <= everything
    assert dartminhash.one_each(empty(odd)).count() == 0


def test_weighted_classes(spark):
    df = spark.createDataFrame([(1, "a b c d e " * 40), (2, "a b c d e " * 20), (3, "a b c d e " * 39)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in dartminhash.classes(df, weighted=True).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


# ---- quality -----------------------------------------------------------------------------

def brute_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    seen3 = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if seen3[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_measures_match_brute_force(spark, odd):
    out = quality.judged(staged(quality.with_votes(odd))).collect()
    assert len(out) == odd.count()
    for r in out:
        want = brute_measures(r.text)
        assert tuple(r[k] for k in quality.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judged(staged(quality.with_votes(empty(odd)))).count() == 0


def test_quality_finds_labelled_documents(spark):
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.connect().execute("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    good = [got[i][1] for i, q in labels if q == 1 and not got[i][0]]
    bad = [got[i][1] for i, q in labels if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_estimation_distrusts_a_noisy_rule():
    rng = np.random.default_rng(3)
    counts = Counter()
    for _ in range(4000):
        y = 1 if rng.random() < 0.8 else -1
        counts[tuple(int(v) for v in (*(y if rng.random() < 0.95 else -y for _ in range(4)), rng.choice([1, -1])))] += 1
    prior, odds = quality.estimate(sorted(counts.items()), 5)
    assert abs(odds[4][1] - odds[4][-1]) < 0.5 * min(o[1] - o[-1] for o in odds[:4])
    right = sum(n for p, n in counts.items() if (sum(p[:4]) > 0) == (prior + sum(o[v] for o, v in zip(odds, p)) > 0))
    assert right > 0.9 * 4000


# ---- tokenizers --------------------------------------------------------------------------

def test_bpe_equals_the_library_and_decodes(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path)) if t})
    clash = odd.withColumn("ids", F.lit("mine"))
    both = bpe.decode(bpe.encode(clash, path, public_tokenizers.PATTERN, keep=["doc_id", "text"]), path).collect()
    trip = bpe.digests(bpe.round_trip(odd, path, public_tokenizers.PATTERN, keep=("text",))).collect()
    assert len(both) == len(trip) == odd.count()
    for r in both:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") and r.decoded == (r.text or "").encode()
    for r in trip:
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(empty(odd), path, public_tokenizers.PATTERN).count() == 0


def test_replay_takes_a_smaller_rank_first():
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"cd"]
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    texts = [b"abcd", b"ababcabcd", b"cdcdbcab", b"aabbccdd"]
    assert bpe.Replay(tokens).encode(texts) == [library.encode_ordinary(t.decode()) for t in texts]


def brute_files(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows]


def test_token_files_round_trip(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    folder = shared_folder(spark)
    tokens = staged(rans.tokenized(odd, public_tokenizers.path("word_bpe_49k.json"), 2))
    rans.write_tokens(tokens, folder, block_tokens=2000)
    got = rans.read_tokens(spark, folder).collect()
    want = brute_files(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, x.tobytes()) for (i, _), x in zip(rows, want))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    nothing = shared_folder(spark)
    rans.write_tokens(staged(rans.tokenized(empty(odd), public_tokenizers.path("word_bpe_49k.json"), 2)), nothing)
    assert rans.read_tokens(spark, nothing).count() == 0


def test_one_range_of_long_documents_is_cut_into_files(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "if(id between 100 and 120, repeat(concat('word ', id, ' '), 3000), 'short') as text")
    folder = shared_folder(spark)
    made = staged(rans.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"), 2))
    rans.write_tokens(made, folder, block_tokens=4096, file_tokens=8192)
    sizes = [r.length for r in spark.read.format("binaryFile").load(f"{folder}/blocks").select("length").collect()]
    assert max(sizes) < 200_000 and len(sizes) > 10  # a block has its states besides its words
    got = {r.doc_id: r.ids for r in rans.read_tokens(spark, folder).collect()}
    assert got == {r.doc_id: np.frombuffer(r.ids, "<u2").astype("<u4").tobytes() for r in made.filter("ids is not null").collect()}


def test_token_file_query(spark, documents):
    want, start = {}, 0
    for (i, _, _, _), x in zip(documents, brute_files([d[:2] for d in documents])):
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.op8_token_files(spark, SF).collect()} == want


def test_token_texts_of_any_characters_equal_the_library():
    characters = [chr(c) for c in [*range(0x280), 0x301, 0x3A3, 0x416, 0x1E9E, 0x2028, 0x3000, 0x4E2D, 0xFB01, 0x1F600]]
    texts = [f"Ab{c}Cd{c} {c}, {c}'S x{c}." for c in characters] + [None, "", " ", "\n\t", "plain again", "don't (stop), 'twas l'été. \u00a0A1b2", "<|endoftext|>x"]
    tokens = rans.Tokens(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"), 2)
    want = [x.astype(tokens.kind).tobytes() for x in brute_files([(0, t) for t in texts])]
    for column in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array(texts[40:90])):
        data, ends = tokens.encode(column)
        assert np.diff(ends, prepend=0).tolist() == [len(x) for x in (want if len(column) == len(texts) else want[40:90])]
        assert data.tobytes() == b"".join(want if len(column) == len(texts) else want[40:90])
    assert not len(tokens.encode(pa.array([], pa.string()))[0])


def test_a_different_word_is_looked_up_once_in_a_run_of_batches():
    tokens = rans.Tokens(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"), 2)
    merged, found, merge, find = [], [], tokens.merge, tokens.find
    tokens.merge = lambda piece: merged.append(piece) or merge(piece)
    tokens.find = lambda word: found.append(word) or find(word)
    texts = [f"qword{chr(97 + k % 7)}, other{chr(97 + k % 5)}! L'été 2x" for k in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k:k + 10])], names=["text"]) for k in range(0, 100, 10)]
    run, = runs(iter(batches), "text", 1 << 20)
    data, _ = tokens.encode(run.column("text"))
    assert data.tobytes() == b"".join(x.astype(tokens.kind).tobytes() for x in brute_files([(0, t) for t in texts]))
    assert len(merged) == len(set(merged)) and sorted(found) == ["2x", "l'été"]
    assert [r.num_rows for r in runs(iter(batches), "text", 1)] == [1] * 100


def test_words_kept_are_bounded_within_a_run(monkeypatch):
    monkeypatch.setattr(rans, "KEPT_BYTES", 100_000)
    tokens = rans.Tokens(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"), 2)
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}x{j % 10}, z{j}" for j in range(60)) for k in range(100)]
    data, _ = tokens.encode(pa.array(texts))
    assert data.tobytes() == b"".join(x.astype(tokens.kind).tobytes() for x in brute_files([(0, t) for t in texts]))
    assert len(tokens.known) + len(tokens.older) <= 2 + 100_000 // rans.ENTRY_BYTES
    empty_rows = pa.RecordBatch.from_arrays([pa.nulls(50_000, pa.string())], names=["text"])
    assert len(list(runs(iter([empty_rows] * 4), "text", 1 << 21))) > 1


def test_blocks_decode_from_checkpoints_and_show_damage():
    ids = np.minimum(np.random.default_rng(4).zipf(1.4, 300_001), 30_000)
    coder = rans.Coder(*rans.scaled(dict(Counter(ids.tolist()))))
    data = rans.pack(coder, 0, 0, [7, None], [300_000, 1], ids) + rans.TRAILER.encode()
    block = next(rans.unpack(data))
    span = rans.LANES * rans.STRIDE
    assert (block.decode(coder) == ids).all() and block.doc_ids == [7, None]
    assert (block.decode(coder, 1) == ids[span:]).all() and (block.decode(coder, 1, 2) == ids[span:2 * span]).all()
    with pytest.raises(ValueError):
        list(rans.unpack(data[:500] + bytes([data[500] ^ 1]) + data[501:]))


# ---- language, licences, shards -----------------------------------------------------------

def test_language_of_held_out_documents(spark):
    got = langid.op5_language(spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.connect().execute("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, odd):
    known = langid.learn(odd)
    out = langid.predict(odd.withColumn("score", F.lit("mine")), known).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.learn(empty(odd)) == {} and langid.predict(empty(odd), known).count() == 0


def test_licence_forms(spark, odd):
    texts = [(1, "Copyright (c) 2020 Someone\n\n" + licenses.MIT.replace("\n", " ").upper()), (2, "intro\n\nLicenced under the Apache Licence, v2.0\n\nrest"),
             (3, licenses.ISC), (4, None), (5, "© 2001"), (6, "nothing licensed here")]
    got = {(r.doc_id, r.unit, r.license) for r in licenses.scan(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {(1, "text", "MIT"), (1, "paragraph", "MIT"), (1, "line", "MIT"), (2, "paragraph", "Apache-2.0"), (2, "line", "Apache-2.0"), (3, "text", "ISC")}
    assert licenses.scan(odd.withColumn("digest", F.lit(1))).count() == 0 == licenses.scan(empty(odd)).count()


def test_licences_inside_documents_with_their_blank_lines(spark):
    mit, isc = licenses.MIT, licenses.ISC
    first, rest = mit.split("\n\n", 1)
    texts = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, f"before\n\n{mit}\n\nafter"), (3, f"a\n\n{isc}\n \n\n{mit}\n\n{isc}\n\nb"),
             (4, f"{first}\n\nCopyright 2020 Someone\n\n----\n\n{rest}\n\nafter"), (5, mit), (6, f"{first}\n\nother\n\n{rest}"), (7, f"{rest}\n\n{first}"),
             (8, f"a\n\n{first}"), (8, f"{rest}\n\nb"), (9, f"{first}\n\n{mit}")]
    got = {(r.doc_id, r.unit, r.license, r.n) for r in licenses.scan(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got == {(1, "passage", "MIT", 1), (2, "passage", "MIT", 1), (3, "passage", "MIT", 1), (3, "passage", "ISC", 2), (4, "passage", "MIT", 1),
                   (5, "text", "MIT", 1), (9, "passage", "MIT", 1)}


def test_spellings_longer_than_the_notice(spark):
    docs = spark.createDataFrame([(1, "GPL version 3"), (2, "GPLv3")], "doc_id int, text string")
    assert {r.doc_id for r in licenses.scan(docs, notices=(("GPL-3.0", "GPLv3"),)).collect()} == {1, 2}


def test_shards_hold_even_parts_and_move_little(spark, odd):
    names = [f"n{i}" for i in range(11)]
    table = sharding.fill(tuple(names), 10_007)
    held = Counter(table)
    assert len(held) == 11 and max(held.values()) - min(held.values()) <= 1
    less = sharding.fill(tuple(names[:-1]), 10_007)
    assert sum(a != b for a, b in zip(table, less) if a != 10) < 0.1 * 10_007
    small, at = sharding.fill(("a", "b", "c"), 7), {}
    for k, s in enumerate("abc"):
        at[k] = [(sharding.number(f"start:{s}") + j * (1 + sharding.number(f"step:{s}") % 6)) % 7 for j in range(7)]
    taken = [-1] * 7
    for turn in range(7):
        taken[next(x for x in at[turn % 3] if taken[x] < 0)] = turn % 3
    assert small == taken
    with pytest.raises(ValueError):
        sharding.fill(("a",), 10)
    out = sharding.place(odd.withColumn("shard", F.lit("mine")), F.col("doc_id")).collect()
    assert len(out) == odd.count() and len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.place(empty(odd), F.col("doc_id")).count() == 0


# ---- archives and fingerprints --------------------------------------------------------------

def test_archives_round_trip(spark):
    rows = [(1, "http://www.A.com/x y#q", "z" * 1000), (2, None, "z" * 1000), (None, "u", "z" * 1000), (3, "u", None), (3, "u", None),
            (5, "u", "\r\n\r\nWARC/1.1\r\n" * 3 + "é"), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "v", "é" * 600), (4, "v", "é" * 600)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id bigint, url string, html string, digest string")
    folder = shared_folder(spark)
    warc.write_archives(warc.planned(pages), f"{folder}/a")
    got = warc.merged(staged(warc.read_archives(spark, f"{folder}/a")), rows=3).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, h in rows if (h or "").encode() == data and j is not None), default=None)
        revisit = len(data) >= 1000 and i != last
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    got.sort(key=lambda r: r.index_pos)
    assert [r.index_pos for r in got] == list(range(len(rows)))
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and keys[-1][0] == "v)/"
    nothing = shared_folder(spark)
    warc.write_archives(warc.planned(pages.limit(0)), f"{nothing}/a")
    assert warc.merged(staged(warc.read_archives(spark, f"{nothing}/a"))).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 6, 9])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 40, rng.integers(0, 30)).tolist()) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_fingerprints_of_neighbours(spark, documents):
    got = {r.doc_id: r for r in chunks.op10_fingerprints(spark, SF).collect()}
    down = sorted(documents, reverse=True)
    assert len(got) == len(down)
    for k, (i, t, _, _) in enumerate(down):
        after, third = down[(k + 1) % len(down)][1], len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        mine, other = chunks.fingerprint(t), chunks.fingerprint(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (chunks.written(mine), chunks.written(other))
        assert r.near_edited == chunks.contained(mine, other) and r.near_next == chunks.contained(mine, chunks.fingerprint(after))


def test_fingerprints_in_many_buckets(spark, odd):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spread = chunks.with_next(df, rows=10).collect()
    assert len({r.bucket for r in spread}) > 50 and sum(not r.ahead for r in spread) == 1000
    by = {}
    for r in spread:
        by.setdefault(r.bucket, []).append(r)
    last = None
    for b in sorted(by):
        here = [r.doc_id for r in by[b] if not r.ahead]
        assert here == sorted(here, reverse=True) and (last is None or here[0] == last)
        last = [r.doc_id for r in by[b] if r.ahead][0]
    assert last == 999
    assert chunks.neighbours(odd).count() == odd.count()
    assert chunks.neighbours(empty(odd)).count() == 0
    only = chunks.neighbours(df.limit(1)).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_a_shift_leaves_most_chunks():
    words = [f"w{n}" for n in np.random.default_rng(5).integers(0, 5000, 2000)]
    a, b = " ".join(words), "something new in front " + " ".join(words)
    assert chunks.contained(chunks.fingerprint(a), chunks.fingerprint(b)) > 0.95
    data = a.encode()
    ends = chunks.boundaries(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunks.MOST and sizes[:-1].min() >= chunks.LEAST


def test_columns_named_like_the_operators_own(spark, odd):
    """Neither mix nor licence scan trips over them."""
    clash = odd.withColumns({c: F.lit(7) for c in ("epochs", "copies", "target", "_cut", "taken", "license", "unit", "digest", "digests", "n", "row")})
    keyed = staged(mixing.with_keys(clash))
    got = mixing.take(keyed, staged(mixing.cuts(keyed)))
    plain = staged(mixing.with_keys(odd))
    want = mixing.take(plain, staged(mixing.cuts(plain)))
    assert Counter(r.taken for r in got.collect()) == Counter(r.taken for r in want.collect())
    assert {r.epochs for r in got.select("epochs").collect()} == {7}
    docs = spark.createDataFrame([(1, dict(licenses.NOTICES)["MIT"] if "MIT" in dict(licenses.NOTICES) else licenses.NOTICES[0][1])], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(7) for c in ("license", "unit", "digest", "digests", "n")})
    found = licenses.scan(docs, keep=("doc_id", "license", "unit", "digest", "digests", "n"))
    assert found.columns == ["doc_id", "digest", "digests", "unit", "license", "n"] and found.count() >= 1


def plain_fingerprint(text):
    """The same chunking byte by byte: the gear hash of the last 32 bytes, cut where its upper bits are zero."""
    data, ends, start = text.encode(), [], 0
    while start < len(data):
        end = min(len(data), start + chunks.MOST)
        for at in range(start + chunks.LEAST, end + 1):
            if len(data) - start <= chunks.LEAST:
                break
            h = 0
            for back in range(32):
                if at - 1 - back >= 0:
                    h = (h + (int(chunks.GEAR[data[at - 1 - back]]) << back)) % (1 << 64)
            bits = chunks.STRICT_BITS if at < start + chunks.NORMAL else chunks.LOOSE_BITS
            if h >> (64 - bits) == 0:
                end = at
                break
        ends.append((start, end))
        start = end
    return {xxhash.xxh64_digest(data[a:b]): b - a for a, b in ends}


def test_fingerprint_equals_a_plain_loop(documents):
    for text in [*(t for _, t, _, _ in documents[:12] if t and len(t) < 6000), "", "x", "ab" * 300, "y" * 500, "é🙂" * 40]:
        assert chunks.fingerprint(text) == plain_fingerprint(text)


def test_an_encoder_forgets_rare_pieces_and_keeps_those_in_use(monkeypatch):
    from rasterloom.llm import bpe
    tokens = [bytes([b]) for b in range(256)]
    encoder = bpe.kept_encoder(tokens, r"\S+")
    assert bpe.kept_encoder(list(tokens), r"\S+") is encoder and bpe.kept_encoder(tokens, r"\s+|\S+") is not encoder
    encoder.kept, asked = 20, []
    replay = encoder.replay.encode
    monkeypatch.setattr(encoder.replay, "encode", lambda pieces: asked.extend(pieces) or replay(pieces))
    for i in range(100):
        text = f"often w{i} v{i}"
        assert encoder.encode([text, None]) == [np.frombuffer(text.replace(" ", "").encode(), np.uint8).astype("<u4").tobytes(), b""]
        assert len(encoder.known) + len(encoder.older) <= 20 + 6
    assert asked.count(b"often") == 1 and len(asked) == 201
