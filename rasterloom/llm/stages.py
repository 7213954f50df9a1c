"""The stages of the pipeline; each takes (spark, docs, sf_dir) and works on all of docs.

Other columns of docs pass through under any name; the operators' own columns never reach the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, dartminhash, langid, mixing
from rasterloom.llm.common import staged
from rasterloom.llm.quality import judged, with_votes

PIECES = 350_000  # kept by a worker of the last stage: its executor's heap has grown with the stages before


def fresh(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a letter, or of chance score and mostly in scripts that no language of docs has."""
    out = (fresh("lang_pred", docs.columns), fresh("score", docs.columns))
    found = langid.predict(docs, langid.learn(docs), out=out, own_scripts=langid.scripts(docs))
    return found.filter(F.col(out[0]) != langid.UNKNOWN).drop(*out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that fail the base measures or are more likely bad than good."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_row"))
    return judged(staged(with_votes(rows, text="doc_row.text"))).filter("kept").select("doc_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class."""
    return dartminhash.one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of the ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    trip = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, most=PIECES)
    return bpe.digests(trip).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
