"""The pipeline stage by stage, and what happens without its subpackage."""

import hashlib
import random
import sys
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rasterloom.llm import bpe, dartminhash, mixing, stages
from rasterloom.llm.common import KEPT, kept_by_worker, map_arrow, staged

SF = "/root/testdata/sf0.001"


def test_stages_decide_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("quality", F.lit("mine")).withColumn("score", F.lit(7))
    docs = staged(docs.union(docs.limit(1)).union(docs.limit(1).withColumn("text", F.lit("12 34 !"))))
    ids, stages = [], dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "quality", "near_duplicates", "mix", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF))
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "tokens":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            classes = dartminhash.classes(before).collect()
            assert sorted(ids[-1]) == sorted({r.class_id for r in classes}) and max(ids[-1].values()) == 1
        if name == "mix":
            keyed = staged(mixing.with_keys(before))
            plan = {r.doc_id: r.copies for r in mixing.take(keyed, staged(mixing.cuts(keyed))).collect()}
            assert ids[-1] == Counter({k: v for k, v in plan.items() if v})
        if name == "tokens":
            texts = Counter(r.text or "" for r in before.collect())
            assert ids[-1] == ids[-2]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))) if t})
    want = Counter()
    for t, n in texts.items():
        x = np.array(library.encode_ordinary(t), "<u4")
        want[len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == want


def test_language_drops_unlearned_scripts_and_keeps_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rnd, planted = random.Random(4), []
    for a, b in ((0x3B1, 0x3CA), (0x430, 0x450), (0x627, 0x64B), (0x4E00, 0x5E00)):
        planted += [" ".join("".join(chr(rnd.randrange(a, b)) for _ in range(rnd.randrange(1, 8))) for _ in range(n)) for n in (1, 3, 30, 300) for _ in range(15)]
    short = ["Von.", "Yes", "no", "the", "und", "Où ?", "año", "a", "Zz", "Quiz x", "jazz 3"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(planted)] + [(-1001 - i, t, None) for i, t in enumerate(short)], docs.schema)
    left = {r.doc_id for r in stages.language(spark, docs.union(more), SF).select("doc_id").collect()}
    assert not [i for i in left if -1000 <= i < 0]
    assert {i for i in left if i < -1000} == {-1001 - i for i in range(len(short))}
    assert {i for i in left if i >= 0} == {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        assert docs.count() == 0


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert Counter(docs.collect()) == Counter(corpus_pipeline.run(spark, SF).collect())


def test_new_pieces_are_merged_in_little_memory():
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(tokens) if t})
    rnd = random.Random(11)
    texts = [" ".join("".join(chr(rnd.randrange(97, 123)) for _ in range(rnd.randrange(6, 14))) for _ in range(60_000)), "", "x" * (bpe.MERGED_BYTES + 9), None, "é ü " * 9]
    encoder = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    tracemalloc.start()
    found = encoder.encode(texts)
    after, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for t in texts]
    assert len(encoder.known) > 59_000 and peak - after < 32 << 20


def test_a_task_drops_what_other_operators_kept_in_its_worker():
    def rows(run, **options):
        conf = SimpleNamespace(get=lambda _: "10")
        return map_arrow(SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), mapInArrow=lambda task, _: list(task(iter([])))), run, "n long", **options)

    def keeping(batches):
        yield kept_by_worker(("mine",), lambda: [len(made)])
        made.append(1)

    def plain(batches):
        yield KEPT in sys.modules

    made = []
    assert rows(keeping, keeps=True) == [[0]] and rows(keeping, keeps=True) == [[0]]  # kept between tasks
    assert rows(plain) == [False]
    assert rows(keeping, keeps=True) == [[2]]
    assert rows(plain) == [False]


def test_entry_without_the_subpackage(monkeypatch):
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k[:k.find("_") + 1] for k in entry.queries()}
    import rasterloom

    for name in [m for m in sys.modules if m.startswith("rasterloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(rasterloom, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "rasterloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = entry.queries()
    assert "levels" in left and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in left)
