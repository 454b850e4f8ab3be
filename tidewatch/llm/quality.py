"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Four scores of a text, each the worse the greater, are compared with cutoffs: symbols per word, share of repeated
lines, share of words in repeated 3-word windows, characters per word. Cutoffs are chosen per stratum (language) from
labelled good documents, none of which took part in setting the grid: a cutoff is usable if the hypothesis "it
rejects more than ``risk / rules`` of the good documents" is refuted by the exact binomial tail of the rejections
seen, at ``level`` divided by all rules and strata. Along a rule's grid, from lenient to strict, the tests form a
fixed sequence, which needs no further correction; the strictest usable cutoff is taken. So with probability
``1 - level`` no stratum loses more than ``risk`` of its good documents to the rules. A stratum with too few labels
certifies nothing, and its documents are kept.

Base rules, which no label moves: fewer than 50 words, or over half of the words in repeated windows.

Defined results: null and empty texts have no words and fail; a null language is a stratum of its own; a document
with several labels is good only if all say so; labels of unknown documents do nothing; without labels nothing but
the base rules applies; working columns have names of their own, and ``keep`` returns the documents' columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Cutoffs of each rule, lenient to strict.
GRID = {
    "symbols": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25),
    "repeats": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "length": (14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.75, 6.5, 6.25),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def q(name: str) -> str:
    return f"__q_{name}"


def measured(docs: DataFrame) -> DataFrame:
    """The rows with the counts of their texts in working columns ``__q_*``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn(q("text"), text)
    df = df.withColumn(q("words"), F.array_remove(F.split(q("text"), SPACE), ""))
    df = df.withColumn(q("lines"), F.filter(F.split(q("text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn(q("n_words"), F.size(q("words")).cast("bigint"))
    # Hashes of 3-word windows, window i at place i.
    words, windows = F.col(q("words")), F.col(q("windows"))
    hashed = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn(q("windows"), F.when(F.col(q("n_words")) > 2, F.slice(hashed, 1, F.size(words) - 2)).otherwise(F.array().cast("array<bigint>")))
    # Only a text in which a window repeats has its windows sorted, with their places, to find where.
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(q("placed"), F.when(repeats, placed))
    sorted_windows = F.col(q("placed"))
    twice = F.filter(sorted_windows, lambda x, j: (F.get(sorted_windows, j - 1)["h"] == x["h"]) | (F.get(sorted_windows, j + 1)["h"] == x["h"]))
    df = df.withColumn(q("places"), F.transform(twice, lambda x: x["i"]))
    covered = F.array_distinct(F.flatten(F.transform(q("places"), lambda i: F.array(i, i + 1, i + 2))))
    length = lambda drop: F.length(F.translate(q("text"), drop, ""))
    df = df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(q("n_words")),
        length(BLANKS).cast("bigint").alias(q("word_chars")),
        (F.length(q("text")) - length(SYMBOLS)).cast("bigint").alias(q("n_symbols")),
        F.size(q("lines")).cast("bigint").alias(q("n_lines")),
        (F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("bigint").alias(q("n_dup_lines")),
        F.coalesce(F.size(covered), F.lit(0)).cast("bigint").alias(q("n_repeat_words")),
    )
    return df.withColumn(q("stratum"), F.coalesce(F.col("lang").cast("string"), F.lit("")))


def base_failed() -> Column:
    return (F.col(q("n_words")) < MIN_WORDS) | (100 * F.col(q("n_repeat_words")) > 50 * F.col(q("n_words")))


def scores() -> dict[str, Column]:
    count = lambda name: F.col(q(name))
    words, lines = F.greatest(count("n_words"), F.lit(1)), F.greatest(count("n_lines"), F.lit(1))
    return {
        "symbols": count("n_symbols") / words,
        "lines": count("n_dup_lines") / lines,
        "repeats": count("n_repeat_words") / words,
        "length": count("word_chars") / words,
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly: terms by recursion on their logarithms."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add)["total"]


def thresholds(rows: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Per stratum the strictest certified cutoff of each rule (null: none), from measured rows and their labels."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__q_id")).agg(F.min("quality").alias("quality")).where(F.col("quality") == 1)
    tried = [(rule, k, c) for rule, grid in GRID.items() for k, c in enumerate(grid)]
    held = rows.where(~base_failed()).select(F.col("doc_id").alias("__q_id"), q("stratum"), *[s.alias(r) for r, s in scores().items()]).join(good.select("__q_id"), "__q_id")
    counts = held.groupBy(q("stratum")).agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{k}") for r, k, c in tried])
    counts = cut(counts, "calibration")
    strata = max(1, counts.count())
    share = risk / len(GRID)
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{k}").alias("k")) for r, k, c in tried])
    cells = counts.select(q("stratum"), "n", F.inline(tests))
    # At or beyond the mean the tail is far over any level.
    tail = F.when(F.col("k") >= share * F.col("n"), F.lit(1.0)).otherwise(binomial_tail(F.col("n"), F.col("k"), share))
    passed = cells.where(tail <= level / (len(GRID) * strata))
    best = [F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(q(f"max_{r}")) for r in GRID]
    return cut(passed.groupBy(q("stratum")).agg(*best), "thresholds")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured rows with ``__q_failed`` (base rules) and ``__q_kept``."""
    joined = rows.join(limits, q("stratum"), "left")
    over = [F.coalesce(s > F.col(q(f"max_{r}")), F.lit(False)) for r, s in scores().items()]
    rejected = over[0] | over[1] | over[2] | over[3]
    return joined.withColumn(q("failed"), base_failed()).withColumn(q("kept"), ~base_failed() & ~rejected)


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """Per document ``doc_id``, its counts, ``base_failed`` and ``kept``."""
    rows = cut(measured(docs.select("doc_id", "text", "lang")).drop("text"), "measured")
    out = judged(rows, thresholds(rows, labels, risk, level))
    return out.select("doc_id", *[F.col(q(c)).alias(c) for c in COUNTS], F.col(q("failed")).alias("base_failed"), F.col(q("kept")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05) -> DataFrame:
    """The documents that base rules and certified cutoffs let pass, with their columns."""
    # Measured once and written: a filter pushed into the measuring would repeat it for every count it looks at.
    rows = cut(measured(docs), "measured")
    return judged(rows, thresholds(rows, labels, risk, level)).where(q("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
