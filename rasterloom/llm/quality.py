"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes for a document (1), against it (-1) or abstains (0).  How far a rule can
be trusted is not set but estimated: expectation-maximisation over the vote patterns finds
for each rule how likely its votes are in good and in bad documents, and the share of good
documents.  The posterior probability that a document is good then replaces the demand
that it pass every rule; only documents that fail the base measures are out beforehand.

All measures are made within the row (no explode, no shuffle).  What is grouped are vote
patterns, at most 3 ** rules of them however large the table; the estimation runs over
their counts on the driver and returns a few numbers per rule as literals.

Defined cases: a null text has no words and fails the base; equal rows get equal results;
an empty table gives the starting estimates and no rows; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import staged, table, word_array

LEAST_WORDS, MOST_REPEATED = 50, 50
ROUNDS, START, LEAST, KEEP = 60, 0.9, 0.002, 0.5
SCRATCH = ("q_words", "q_sorted", "q_bits", "q_spots")


def measured(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters,
    n_alpha_words, n_ends, n_bangs.

    A word repeats if it lies in a 3-word window that occurs twice or more in the text.
    Windows are found by sorting 64-bit values that hold a window's hash in the high bits
    and its place in the low ones; neighbours with equal hash are compared word by word.
    """
    t = F.col(text)

    def count(pattern: str) -> Column:
        """Characters of a class."""
        return F.when(t.isNull(), 0).otherwise(F.length(F.regexp_replace(t, f"[^{pattern}]+", ""))).cast("long")

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("q_words", F.when(t.isNull(), F.array().cast("array<string>")).otherwise(word_array(t)))
    d = d.withColumn("n_words", F.size("q_words").cast("long")).withColumn("q_bits", F.expr("cast(ceil(log2(n_words + 1.0D)) as int)"))
    d = d.withColumn("q_sorted", F.expr("""
        case when n_words < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, cast(n_words as int) - 3),
         i -> shiftleft(shiftright(xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]), q_bits), q_bits) | cast(i as bigint))) end"""))
    same = """shiftright(q_sorted[{a}], q_bits) = shiftright(q_sorted[{b}], q_bits)
         and q_words[{pa}] = q_words[{pb}] and q_words[{pa} + 1] = q_words[{pb} + 1] and q_words[{pa} + 2] = q_words[{pb} + 2]"""
    spot = "cast(q_sorted[{}] & (shiftleft(1L, q_bits) - 1) as int)"

    def pair(a: str, b: str) -> str:
        return same.format(a=a, b=b, pa=spot.format(a), pb=spot.format(b))

    d = d.withColumn("q_spots", F.expr(f"""
        case when n_words < 4 then cast(array() as array<int>) else sort_array(transform(filter(sequence(0, cast(n_words as int) - 3),
         k -> (k > 0 and {pair('k', 'k - 1')}) or (k < n_words - 3 and {pair('k', 'k + 1')})), k -> {spot.format('k')})) end"""))
    d = d.withColumn("n_repeat_words", F.expr("""
        case when size(q_spots) = 0 then 0L else 3L + aggregate(sequence(1, size(q_spots)), 0L,
         (n, k) -> n + case when k = size(q_spots) then 0 else least(3, q_spots[k] - q_spots[k - 1]) end) end"""))
    return (d.withColumn("word_chars", F.when(t.isNull(), 0).otherwise(F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))).cast("long"))
            .withColumn("n_symbols", count(r"#*$%&|<>"))
            .withColumn("q_lines", lines).withColumn("n_lines", F.coalesce(F.size("q_lines"), F.lit(0)).cast("long"))
            .withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
            .withColumn("n_dup_lines", F.when(t.isNull(), 0).otherwise(F.col("n_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
            .withColumn("n_capitals", count(r"\p{Lu}")).withColumn("n_letters", count(r"\p{L}"))
            .withColumn("n_alpha_words", F.size(F.filter("q_words", lambda x: x.rlike(r"\p{L}"))).cast("long"))
            .withColumn("n_ends", count(".?")).withColumn("n_bangs", count("!")).drop(*SCRATCH, "q_lines"))


def band(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Vote of each rule from the measures; a rule that lacks what it looks at abstains."""
    n, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))
    per_word, length = F.col("n_symbols") / n, F.col("word_chars") / n
    capitals, repeated = F.col("n_capitals") / letters, F.col("n_repeat_words") / n
    ends, bangs, lines = F.col("n_ends") / n, F.col("n_bangs") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    alphabetic = F.col("n_alpha_words") / n
    pure = F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    rules = {
        "length": band(length, (length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        "symbols": band(per_word, per_word < 0.02, per_word > 0.1),
        "capitals": band(capitals, capitals < 0.15, capitals > 0.35),
        "repeats": band(repeated, repeated < 0.1, repeated > 0.3),
        "lines": F.when(F.col("n_lines") < 4, 0).otherwise(band(lines, lines < 0.1, lines > 0.5)),
        "stops": F.when(F.col("n_words") < 30, 0).otherwise(band(ends, (ends > 0.02) & (ends < 0.3), (ends < 0.005) | (ends > 0.5))),
        "bangs": band(bangs, bangs < 0.02, bangs > 0.1),
        "letters": band(pure, pure > 0.9, pure < 0.7),
        "alphabetic": band(alphabetic, alphabetic > 0.9, alphabetic < 0.8),
    }
    return {k: F.when(F.col("n_words") == 0, 0).otherwise(v) for k, v in rules.items()}


def estimate(counts: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of a good document, and per rule the log odds that each vote adds.

    `counts` has the vote patterns with their numbers.  The start trusts every rule: a document
    with a vote against it is bad with probability START.  Each round turns posteriors into the
    shares of votes for, among good and among bad documents, and these back into posteriors, so
    a rule whose votes the others do not bear out loses its weight.  Abstentions say nothing,
    and a vote never comes to speak against what it says.
    """
    posterior = [1 - START if -1 in pattern else START for pattern, _ in counts]
    prior, odds = 0.0, [{1: 0.0, -1: 0.0, 0: 0.0} for _ in range(rules)]
    for _ in range(rounds if counts else 0):
        total = sum(n for _, n in counts)
        goods = sum(n * p for (_, n), p in zip(counts, posterior))
        share = min(1 - LEAST, max(LEAST, goods / total))
        prior = math.log(share / (1 - share))
        for k, o in enumerate(odds):
            cast = [(pattern[k] == 1, n * p, n * (1 - p)) for (pattern, n), p in zip(counts, posterior) if pattern[k]]
            right = (sum(g for up, g, _ in cast if up) + 1) / (sum(g for _, g, _ in cast) + 2)  # votes for, among good
            wrong = (sum(b for up, _, b in cast if up) + 1) / (sum(b for _, _, b in cast) + 2)  # votes for, among bad
            right = min(1 - LEAST, max(LEAST, right))
            wrong = min(right, max(LEAST, wrong))
            o[1], o[-1] = math.log(right / wrong), math.log((1 - right) / (1 - wrong))
        odds_of = [prior + sum(o[v] for o, v in zip(odds, pattern)) for pattern, _ in counts]
        posterior = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in odds_of]
    return prior, odds


def with_votes(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the measures and vote_<rule> for each rule."""
    return measured(docs, text=text).withColumns({f"vote_{k}": v for k, v in votes().items()})


def judged(voted: DataFrame, *, keep: float = KEEP) -> DataFrame:
    """Add base_failed, quality (posterior) and kept; `voted` is from with_votes and staged, as it is read twice."""
    names = [f"vote_{k}" for k in votes()]
    patterns = voted.groupBy(*names).count().sort(*names).collect()  # at most 3 ** rules rows
    prior, odds = estimate([(tuple(r[n] for n in names), r["count"]) for r in patterns], len(names))
    x = F.lit(prior)
    for name, o in zip(names, odds):
        x = x + F.when(F.col(name) == 1, o[1]).when(F.col(name) == -1, o[-1]).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (voted.withColumn("base_failed", failed).withColumn("quality", F.round(1 / (1 + F.exp(-x)), 6))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    voted = staged(with_votes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return judged(voted).select("doc_id", *BASE, "base_failed", "kept", "quality")
