"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its letters'
vectors, each permuted (rolled) by its place; a text is the bundle (sum) of its n-grams'
vectors, a language's prototype the bundle of all its learning texts.  The language of a
text is that of the prototype with the largest cosine, and the cosine is the score.

Vectors come from the letter's code point, so they need no table and agree everywhere.
Bundles are sums of whole numbers: prototypes do not depend on partitions or order.  Only
one vector per task and language is shuffled; prototypes are languages x dimensions.

A cosine below NOISE deviations of chance (1 / sqrt(dimensions)) says nothing about the language.  Where predict is given
the scripts of the learning texts, such a text is `und` if fewer than half of its letters are of these scripts; a short
text of a known script keeps its answer.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties of the
cosine go to the first language in code point order; texts with a null language teach
nothing; without any learning text every answer is `und`; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rasterloom.llm.common import map_arrow, slices, table

DIMENSIONS, GRAM = 1024, 3
BLOCK = 512 << 10
UNKNOWN = "und"
NOISE = 5
OWN = 0.01  # part of a language's letters from which on their script is the language's own
GAP = 32  # what is no letter, as one space


class Profiles:
    """Counts n-grams of texts and bundles their vectors."""

    def __init__(self, dimensions: int, gram: int):
        self.dimensions, self.gram = dimensions, gram
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, n-gram number) of each n-gram in the texts, and the n-grams' code points.

        A text counts as one string of letters with single gaps between words and at both ends.
        """
        points = [np.frombuffer((t or "").lower().encode("utf-32-le"), "<u4") for t in texts]
        ends = np.cumsum([len(p) + 1 for p in points])
        codes = np.full(int(ends[-1]) + 1 if len(ends) else 1, GAP, np.int64)
        for p, e in zip(points, ends):
            codes[e - len(p):e] = p  # a gap before and after each text
        text = np.repeat(np.arange(len(points)), np.diff(ends, prepend=0))
        text = np.append(text, len(points) - 1)
        codes[~self.letter[codes]] = GAP
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        codes, text = codes[keep], text[keep]
        alphabet, small = np.unique(codes, return_inverse=True)
        n, g = len(codes) - self.gram + 1, self.gram
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, g), np.int64)
        key = np.zeros(n, np.int64)
        for k in range(g):
            key = key * len(alphabet) + small[k:k + n]
        inside = np.ones(n, bool)  # no gap in the middle: an n-gram lies in one word and its gaps
        for k in range(1, g - 1):
            inside &= codes[k:k + n] != GAP
        of, key = text[1:1 + n][inside], key[inside]
        kinds, which = np.unique(key, return_inverse=True)
        places = [alphabet[kinds // len(alphabet) ** (g - 1 - k) % len(alphabet)] for k in range(g)]
        return of, which, np.stack(places, axis=1) if len(kinds) else np.zeros((0, g), np.int64)

    def bound(self, kinds: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: the letter at place k is rolled by the places after it."""
        out = np.ones((len(kinds), self.dimensions), np.int8)
        for k in range(self.gram):
            codes, at = np.unique(kinds[:, k], return_inverse=True)
            if len(codes):
                out *= np.stack([np.roll(self.vector(int(c)), self.gram - 1 - k) for c in codes])[at]
        return out

    def bundles(self, groups: np.ndarray, n_groups: int, texts: list[str | None]) -> np.ndarray:
        """Per group of texts the sum of its n-grams' vectors; sums stay exact in double."""
        of, which, kinds = self.grams(texts)
        counts = np.bincount(groups[of] * len(kinds) + which, minlength=n_groups * len(kinds)).reshape(n_groups, len(kinds))
        vectors = self.bound(kinds)
        if counts.max(initial=0) * max(1, len(kinds)) < 1 << 24:  # exact in single precision too
            return (counts.astype(np.float32) @ vectors.astype(np.float32)).astype(np.float64)
        return counts.astype(np.float64) @ vectors.astype(np.float64)


def script(letter: str) -> str:
    """First word of a letter's Unicode name: LATIN, GREEK, CJK; none for what is no letter."""
    return unicodedata.name(letter, "").split(" ")[0] if letter.isalpha() else ""


def script_counts(text: str) -> dict[str, int]:
    """Letters of a text by script."""
    codes, times = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
    counts: dict[str, int] = {}
    for c, n in zip(codes.tolist(), times.tolist()):
        name = script(chr(c))
        if name:
            counts[name] = counts.get(name, 0) + n
    return counts


def scripts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> frozenset[str]:
    """Scripts that make up a part of OWN of the letters of a language; one row per task, language and script is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], int] = {}
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                texts: dict[str, list[str]] = {}
                for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    texts.setdefault(name, []).append(t)
                for name, own in texts.items():
                    for kind, n in script_counts("".join(own)).items():
                        sums[name, kind] = sums.get((name, kind), 0) + n
        yield pa.RecordBatch.from_pylist([{"lang": k, "script": v, "n": n} for (k, v), n in sums.items()],
                                         schema=pa.schema([("lang", pa.string()), ("script", pa.string()), ("n", pa.int64())]))

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    found = map_arrow(known, run, "lang string, script string, n long").groupBy("lang", "script").agg(F.sum("n").alias("n")).collect()
    total: dict[str, int] = {}
    for r in found:
        total[r.lang] = total.get(r.lang, 0) + r.n
    return frozenset(r.script for r in found if r.n >= OWN * total[r.lang])


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Prototype per language of all rows with a language: languages x dimensions on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions, gram), {}
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                groups = np.array([names.index(x) for x in langs], np.int64)
                made = profiles.bundles(groups, len(names), part.column("text").to_pylist())
                for name, v in zip(names, made):
                    sums[name] = sums.get(name, 0.0) + v
        if sums:
            yield pa.RecordBatch.from_pylist([{"lang": k, "v": v.tolist()} for k, v in sums.items()],
                                             schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    per_task = map_arrow(known, run, "lang string, v array<double>")
    summed = (per_task.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")))
    return {r.lang: np.array([x.x for x in r.v]) for r in summed.sort("lang").collect() if any(x.x for x in r.v)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", keep: list[str] | None = None,
            out: tuple[str, str] = ("lang_pred", "score"), dimensions: int = DIMENSIONS, gram: int = GRAM,
            own_scripts: frozenset[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with the language and the score, named by `out`."""
    keep = [c for c in docs.columns if c not in out] if keep is None else keep
    read = keep if text in keep else [*keep, text]
    names = sorted(prototypes)
    shown = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names], axis=1) if names else np.zeros((dimensions, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions, gram)
        for batch in batches:
            for part in slices(batch, text, BLOCK):
                texts = part.column(text).to_pylist()
                bundles = profiles.bundles(np.arange(len(texts)), len(texts), texts)
                norms = np.linalg.norm(bundles, axis=1)
                cosines = np.round(bundles @ shown / np.maximum(norms, 1e-9)[:, None], 9)
                best = cosines.argmax(axis=1) if names else np.zeros(len(texts), int)
                has = (norms > 0) & np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & bool(names)
                if own_scripts is not None:
                    for i in np.flatnonzero(has & (cosines.max(axis=1, initial=0) < NOISE / np.sqrt(dimensions))):
                        counts = script_counts(texts[i])
                        has[i] = 2 * sum(counts.get(k, 0) for k in own_scripts) >= sum(counts.values())
                score = np.where(has, np.clip(cosines.max(axis=1, initial=0), 0, 1), 0.0)
                pred = pc.if_else(pa.array(has), pa.array([names[b] for b in best] if names else [UNKNOWN] * len(texts), pa.string()), UNKNOWN)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pred, pa.array(score)], names=[*keep, *out])

    schema = StructType([*(docs.schema[c] for c in keep), StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    return map_arrow(docs.select(*read), run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = learn(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), known, keep=["doc_id", "held_out"])
