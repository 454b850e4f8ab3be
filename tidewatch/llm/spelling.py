"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart, the shorter (of equal ones either) is cut into two disjoint chunks. One edit cannot
touch both, so one of them is a positional gram of the other word: at its own position, or one further if a code
point was inserted before it. What remains beside the intact chunk holds the edit, and is cut into two chunks
in the same way. So the key of a join is the chunk and a chunk of the rest: for a word as the shorter one its
four pairs of chunks, for a word as the other one its grams in the same places, shifted by none or one. Grams
elsewhere can match no chunk of a word one edit away and are left out. Joined pairs are verified by edit distance.

Keys hold three quarters of a word, so few words share one. A word has twelve keys however frequent it is, and the
join's sides are left to adaptive execution, which splits partitions that are large all the same.

``variants`` takes a word's form to be its near word of largest count, where that is at least ``times`` the word's
own; counts grow along forms, so following them ends after at most log2 of the largest count steps, and pointer
doubling finds the last one in as many rounds as that number has bits.

Defined results: null and empty texts have no words; rows without an id are read as ones of empty id; a text of
one long run is one word; repeated rows count again; other columns are neither used nor kept; no rows give no words.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, portions, texts_of

#: Byte by byte in Latin-1: A-Z lowered, other letters kept, anything else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
MOST_WORDS = 1 << 18


class Numbers(dict):
    """Words numbered in order of sight, with the length and the checksum of each."""

    def __init__(self):
        super().__init__()
        self.words, self.lengths, self.checks = [], [], []

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.lengths.append(len(word))
        self.checks.append(zlib.crc32(word if word.isascii() else word.decode("latin-1").encode()))
        number = self[word] = len(self.words) - 1
        return number


def utf8_lengths(words: list[bytes]) -> np.ndarray:
    return np.array([len(w) if w.isascii() else len(w.decode("latin-1").encode()) for w in words], np.int64)


class Tally:
    """Counts of words, with the deletions that the document's id and the word call for."""

    def __init__(self, every: int, least: int):
        self.every, self.least = every, least
        self.zeros = np.array([zlib.crc32(bytes(k)) for k in range(64)], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.number, self.changed = Numbers(), Counter()
        self.counts = np.zeros(MOST_WORDS, np.int64)
        self.known, self.checks, self.sizes = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, doc_id: str, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number.words) > self.known:
            fresh = self.number.words[self.known :]
            self.checks = np.concatenate([self.checks, np.array(self.number.checks[self.known :], np.uint32)])
            self.sizes = np.concatenate([self.sizes, utf8_lengths(fresh)])
            self.known = len(self.number.words)
        if self.known > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(max(self.known, len(self.counts)), np.int64)])
        # A checksum is linear: that of head and word is that of the word, and the head's carried over the word's length.
        head = zlib.crc32(f"{doc_id}:".encode())
        sizes = self.sizes[ids]
        used = np.bincount(np.minimum(sizes, 63), minlength=64)
        carried = np.array([zlib.crc32(bytes(k), head) if used[k] else 0 for k in range(64)], np.uint32) ^ self.zeros
        h = self.checks[ids] ^ carried[np.minimum(sizes, 63)]
        for at in np.flatnonzero(sizes >= 63).tolist():
            word = words[at]
            h[at] = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
        hit = h % np.uint32(self.every) == 0 if self.every else np.zeros(len(h), bool)
        for at in np.flatnonzero(hit).tolist():
            word = words[at]
            k = int(h[at]) % len(word)
            self.changed[word[:k] + word[k + 1 :]] += 1
        self.counts[: self.known] += np.bincount(ids[~hit], minlength=self.known)

    def rows(self) -> pa.RecordBatch:
        kept = [k for k, size in enumerate(self.number.lengths) if size >= self.least and self.counts[k]]
        more = [(w, n) for w, n in self.changed.items() if len(w) >= self.least]
        words = [self.number.words[k].decode("latin-1") for k in kept] + [w.decode("latin-1") for w, _ in more]
        counts = np.concatenate([self.counts[kept], np.array([n for _, n in more], np.int64)]) if words else np.zeros(0, np.int64)
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.astype(np.int64))], ["word", "n"])


def words_of(docs: DataFrame, every: int = 97, least_points: int = 5, least_count: int = 3) -> DataFrame:
    """Distinct ``word, n``: runs of letters, A-Z lowered, of at least so many code points and occurrences.

    Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run's code point at that number modulo its length is
    left out; 0 changes nothing. Each task sends one row for a word it has seen, or a few when it sees very many.
    """

    def run(batches: Batches) -> Batches:
        tally = Tally(every, least_points)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                for part in portions(text.encode("latin-1", "replace").translate(FOLD)):
                    tally.add(doc_id or "", part.split())
                    if len(tally.number.words) + len(tally.changed) > MOST_WORDS:
                        yield tally.rows()
        yield tally.rows()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def key(length: Column, kind: int, first: Column, second: Column) -> Column:
    return F.xxhash64(length, F.lit(kind), first, second)


def chunk_keys(length: Column, inserted: int) -> Column:
    """The four keys of a word as the shorter one of a pair of ``length``, or as the other one with so many code points
    more. Chunks before an insertion stay, those behind it are one further."""
    half = F.floor(length / 2).cast("int")
    a, b = F.floor(half / 2).cast("int"), F.floor((length - half) / 2).cast("int")
    part = lambda begin, size, moved: F.substring("word", begin + 1 + (inserted if moved else 0), size)
    zero = F.lit(0)
    return F.array(
        key(length, 0, part(zero, half, False), part(half, b, False)),  # the edit is in the last quarter
        key(length, 1, part(zero, half, False), part(half + b, length - half - b, True)),  # in the third
        key(length, 2, part(half, length - half, True), part(zero, a, False)),  # in the second
        key(length, 3, part(half, length - half, True), part(a, half - a, True)),  # in the first
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a, na, b, nb`` of words (``word, n``, of 4 code points or more) one edit apart, each once."""
    length = F.length("word")
    # A cheap bound before the edit distance: one edit changes at most two of the letters that occur.
    points = F.transform(F.split("word", ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64))))
    letters = F.aggregate(points, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
    words = words.select("word", "n", length.cast("int").alias("size"), letters.alias("letters"))
    shorter = words.select(F.explode(chunk_keys(F.col("size"), 0)).alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa"), F.col("letters").alias("la"))
    same, more = chunk_keys(F.col("size"), 0), chunk_keys(F.col("size") - 1, 1)
    other = words.select(F.explode(F.concat(same, more)).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"), F.col("letters").alias("lb"))
    ordered = ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))) | (F.col("sa") + 1 == F.col("sb"))
    alike = F.bit_count(F.col("la").bitwiseXOR(F.col("lb"))) <= 2
    joined = shorter.join(other, (shorter["key"] == other["key"]) & ordered & alike & (F.levenshtein("a", "b", 1) == 1))
    return joined.select("a", "na", "b", "nb").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words with a form: from ``word, form``, the last one by pointer doubling."""
    state = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = state.join(ahead, "root", "left")
        if further.where("next is not null").isEmpty():
            return state
        state = cut(further.select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Per word ``word, n, n_near, form, form_n, root``; form and its count are null where no near word is ``times``
    as frequent, and root is then the word itself."""
    words = cut(words, "words")
    pairs = cut(near_pairs(words), "pairs")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    # Least of (-count, word): the most frequent near word, of equals the first in code-point order.
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.less") >= F.col("n") * times
    chosen = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    chosen = cut(chosen, "forms")
    roots = last_forms(chosen.where("form is not null"))
    return chosen.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, every: int = 97, least_points: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """Words of all whole texts, each with its form and the last one of its forms."""
    return variants(words_of(docs, every, least_points, least_count), times)
