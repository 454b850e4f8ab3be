"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of word pairs are quantised to powers of two; a filter holds, for an n-gram of level q, the keys
(n-gram, 1) to (n-gram, q). Looking a count up is asking for level 1, 2, ... until one is missing, so a lookup can
err upwards only. The filter is split into blocks of 2**13 bits, built by the tasks that own the blocks' n-grams, and
written; it has ``BITS_PER_KEY`` bits a key and grows with the keys. It is broadcast in shares of about ``max_bits``
for words and pairs together, one share in each pass over the documents, so every count is used at every size.

All words and all pairs are counted in one scan, those seen once too. A pair's probability is its estimated share of its
first word's count, mixed with the word's own smoothed probability. A text begins after an end mark and ends with one.

The plain base score needs exact counts of words. Their table (hash and count) is broadcast in blocks of about
``block_words`` words, in the same passes. Usually that is one pass; else a table is written in between with the
documents' sums, eight bytes a token for its hash and a byte a token for its level in each filter; later passes read it
instead of the texts, and the table before is deleted.

Defined results: a null text is empty: it is its end mark alone; nothing learned gives probability 1; a null id counts
as empty text where rows are dealt by their ids' checksums; repeated rows count each; other columns are not kept.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, drop, hits_of, mixed, texts_of
from tidewatch.llm.langid import pieces

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MOST_WORDS = 200_000
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
LEVEL = 0x9E3779B97F4A7C15
BLOCK_BITS, PROBES, BITS_PER_KEY = 1 << 13, 4, 12
OWNERS = 4096  # groups of blocks; the filter has a multiple of so many blocks
#: Weight of the pair's share where its first word is frequent, and the count at which it has half of that.
MIX, HALF = 0.4, 10
#: Bytes of a share that the driver takes at once.
PORTION = 8 << 20


class Hashes(dict):
    """64-bit hashes by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def token_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text followed by the end mark, and the number of tokens of each."""
    parts, counts = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = word_hashes(text)
        counts[k] = len(words) + 1
        parts += [words, np.array([END])]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def pair_hashes(stream: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the first follows an end mark, as all texts' first ones do."""
    before = np.concatenate([[END], stream[:-1]]) if len(stream) else stream
    return mixed(before * PAIR + stream)


def counted(rows: DataFrame) -> DataFrame:
    """``pair, h, c`` of all words and pairs, summed over all rows; each piece of a batch sends every hash once. A
    partition has whole owners."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            texts = texts_of(batch)
            for begin, end in pieces(texts, 1 << 22):
                stream, _ = token_stream(texts[begin:end])
                for pair, grams in ((False, stream), (True, pair_hashes(stream))):
                    h, c = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), pair)), pa.array(h.view(np.int64)), pa.array(c)], ["pair", "h", "c"])

    found = rows.select(F.col("text").cast("string")).mapInArrow(count, "pair boolean, h bigint, c bigint")
    found = found.withColumn("owner", F.shiftrightunsigned("h", 52)).repartition("owner")
    return found.groupBy("owner", "pair", "h").agg(F.sum("c").alias("c")).select("pair", "h", "c")


def level_of(count: Column) -> Column:
    return F.floor(F.log2(count) + F.lit(1e-9)) + 1


class FrequencyFilter:
    """Quantised counts by n-gram hash, of the blocks from ``first`` to before ``last``."""

    def __init__(self, blocks: int, first: int, last: int):
        self.blocks, self.first, self.last = blocks, first, last
        self.bits = np.zeros((self.last - first) * (BLOCK_BITS // 64), np.uint64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels, 0 for what these blocks lack."""
        level, block = np.zeros(len(h), np.uint8), block_of(h, self.blocks)
        alive = np.flatnonzero((block >= np.uint64(self.first)) & (block < np.uint64(self.last)))
        q = 1
        while len(alive):
            here = np.ones(len(alive), bool)
            base = (block[alive] - np.uint64(self.first)) * np.uint64(BLOCK_BITS)
            for at in places(h[alive], q):
                bit = base + at
                here &= (self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            alive = alive[here]
            level[alive] = q
            q += 1
            if q > 64:
                break
        return level


#: The middle of each level, on the scale of logarithms; level 1 of single counts is exact, level 0 is no count.
MIDDLE = np.array([0.0, 1.0] + [2.0 ** (level - 1) * math.sqrt(2) for level in range(2, 66)])


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of one owner are together, and the owner is the hash's highest bits."""
    each = np.uint64(blocks // OWNERS)
    return (h >> np.uint64(52)) * each + ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFF)) % each


def places(h: np.ndarray, level: int) -> list[np.ndarray]:
    """PROBES bits in the block of the key (n-gram, level)."""
    key = mixed(h + np.uint64(LEVEL * level & 0xFFFFFFFFFFFFFFFF))
    return [(key >> np.uint64(16 * k)) & np.uint64(BLOCK_BITS - 1) for k in range(PROBES)]


def level_counts(grams: DataFrame) -> dict[int, int]:
    """How many n-grams have each level; a row per power of two."""
    return {r["q"]: r["n"] for r in grams.groupBy(level_of(F.col("c")).alias("q")).agg(F.count("*").alias("n")).collect()}


def blocks_for(keys: int) -> int:
    return OWNERS * max(1, -(-keys * BITS_PER_KEY // (BLOCK_BITS * OWNERS)))


def filled_blocks(grams: DataFrame, blocks: int) -> DataFrame:
    """Rows ``block, bits`` of the filter of ``h, c`` rows; a block has a row for each task with n-grams of its owner,
    which are few where files hold whole owners."""
    rows = grams.select("h", level_of(F.col("c")).cast("int").alias("q"))

    def filled(parts: list[tuple[np.ndarray, np.ndarray]]) -> Batches:
        h, q = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, at = np.unique(block_of(h, blocks), return_inverse=True)
        bits = np.zeros(len(own) * (BLOCK_BITS // 64), np.uint64)
        for level in range(1, int(q.max()) + 1):
            here = q >= level
            for place in places(h[here], level):
                bit = at[here].astype(np.uint64) * np.uint64(BLOCK_BITS) + place
                np.bitwise_or.at(bits, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        each = BLOCK_BITS // 64
        for begin in range(0, len(own), 4096):
            some = [bits[k * each : (k + 1) * each].tobytes() for k in range(begin, min(begin + 4096, len(own)))]
            ids = pa.array(own[begin : begin + 4096].astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(some, pa.binary())], ["block", "bits"])

    def fill(batches: Batches) -> Batches:
        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= 1 << 19:
                yield from filled(parts)
                parts, size = [], 0
        if parts:
            yield from filled(parts)

    return rows.mapInArrow(fill, "block bigint, bits binary")


def fetched(written: DataFrame, wanted: Column, size: int) -> Iterator[pa.Table]:
    """The wanted rows of a written table, ``size`` bytes in all, from a few of its files at a time: the driver holds
    about ``PORTION`` bytes of them at once."""
    files = sorted(written.inputFiles())
    times = max(1, min(len(files), math.ceil(size / PORTION)))
    for k in range(times if files else 0):
        yield written.sparkSession.read.schema(written.schema).parquet(*files[k::times]).where(wanted).toArrow()
        pa.default_memory_pool().release_unused()


def gathered(filled: DataFrame, found: FrequencyFilter) -> FrequencyFilter:
    """``found`` with the bits of its blocks."""
    words = BLOCK_BITS // 64
    for some in fetched(filled, F.col("block").between(found.first, found.last - 1), found.bits.nbytes):
        for block, data in zip(some["block"].to_pylist(), some["bits"], strict=True):
            begin = (block - found.first) * words
            found.bits[begin : begin + words] |= np.frombuffer(data.as_buffer(), np.uint64)
        some = data = None
    return found


class Written:
    """The whole filter of ``h, c`` rows, every count in it, in the shared folder; shares of it can be fetched."""

    def __init__(self, grams: DataFrame, name: str):
        self.blocks = blocks_for(sum(n * q for q, n in level_counts(grams).items()))
        self.filled = cut(filled_blocks(grams, self.blocks), name)

    def share(self, k: int, of: int) -> FrequencyFilter:
        return gathered(self.filled, FrequencyFilter(self.blocks, k * self.blocks // of, (k + 1) * self.blocks // of))


def log10(word_levels: np.ndarray, pair_levels: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 probability of every token of a stream of whole texts, from its level and that of its pair."""
    single, pair = MIDDLE[word_levels], MIDDLE[pair_levels]
    before = np.roll(single, 1)  # a stream ends with an end mark, as the one that its first token follows
    own = (single + 1) / (total + distinct + 1)
    share = np.minimum(1, pair / np.maximum(before, 1))
    weight = MIX * before / (before + HALF)
    return np.log10(weight * share + (1 - weight) * own)


SUMS = ("n_tokens", "n_known", "base_score", "score")
PER_TOKEN = ("tokens", "word_levels", "pair_levels")
SCORES = "doc_id bigint, text string, n_tokens bigint, n_known bigint, base_score double, score double"
SCORES += ", tokens binary, word_levels binary, pair_levels binary"


def portions_of(batches: Batches, column: str, step: int = 1 << 20) -> Batches:
    """The batches in portions of rows with about ``step`` bytes of a column, so that a task holds no more at once."""
    for batch in batches:
        group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) // step
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(begin, end - begin) for begin, end in zip(bounds, bounds[1:]) if end > begin)


def flat_values(column: pa.BinaryArray, kind: type) -> np.ndarray:
    """All values of a column of binaries, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values as a column of binaries, as many in each as counted."""
    ends = values.itemsize * np.concatenate([[0], np.cumsum(counts)])
    data = values.tobytes()
    return pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())


def score(docs: DataFrame, train: DataFrame, max_bits: int = 1 << 29, block_words: int = 8_000_000) -> DataFrame:
    """Per document ``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    both = cut(counted(train), "counts")
    single = cut(both.where(~F.col("pair")).select("h", "c"), "words")
    totals = single.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = totals["n"], totals["v"]
    words, pairs = Written(single, "word-filter"), Written(both.where("pair").select("h", "c"), "pair-filter")
    drop(both)
    passes = max(1, math.ceil(distinct / block_words), math.ceil((words.blocks + pairs.blocks) * BLOCK_BITS / max_bits))
    empty = [F.lit(0).cast(f"{'double' if c.endswith('score') else 'bigint'}").alias(c) for c in SUMS]
    empty += [F.lit(None).cast("binary").alias(c) for c in PER_TOKEN]
    out, before = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *empty), None
    for k in range(passes):
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for mine in fetched(single, F.pmod("h", F.lit(passes)) == k, 16 * distinct // passes):
            parts.append((mine["h"].to_numpy().view(np.uint64).copy(), mine["c"].to_numpy().copy()))
            del mine
        h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # Half the bytes for counts that need no more: each worker has a copy.
        c = c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c
        order = np.argsort(h)
        known = spark.sparkContext.broadcast((h[order], c[order]))
        filters = spark.sparkContext.broadcast((words.share(k, passes), pairs.share(k, passes)))
        del h, c, order
        last = k == passes - 1

        def add(batches: Batches, known=known, filters=filters, k=k, last=last) -> Batches:
            gc.collect()  # a worker that is used again lets go of the pass before, and only then loads this one
            (hashes, counts), (word_filter, pair_filter) = known.value, filters.value
            for batch in portions_of(batches, "text" if k == 0 else "tokens"):
                sums = {c: batch.column(c).to_numpy().copy() for c in SUMS}
                rows = batch.num_rows
                if k == 0:
                    stream, sums["n_tokens"] = token_stream(texts_of(batch))
                else:
                    stream = flat_values(batch.column("tokens"), np.uint64)
                each_count = sums["n_tokens"]
                owner = np.repeat(np.arange(rows), each_count)
                each, which = np.unique(stream, return_inverse=True)
                has, at = hits_of(each, hashes)
                seen = np.where(has, counts[at], 0).astype(np.int64) if len(counts) else np.zeros(len(each), np.int64)
                # A word of another block adds there what it has over a count of zero.
                plain = np.log10(seen + 1.0) - (math.log10(total + distinct + 1) if k == 0 else 0)
                sums["n_known"] += np.bincount(owner, (seen > 0)[which], rows).astype(np.int64)
                sums["base_score"] += np.bincount(owner, plain[which], rows)
                # An n-gram has its level in the share of its block and 0 in the others.
                mine = [word_filter.levels(each)[which], pair_filter.levels(pair_hashes(stream))]
                if k:
                    mine = [m + flat_values(batch.column(c), np.uint8) for m, c in zip(mine, PER_TOKEN[1:], strict=True)]
                if last:
                    sums["score"] += np.bincount(owner, log10(*mine, total, distinct), rows)
                    per_token = [pa.nulls(rows, pa.binary())] * 3
                else:
                    per_token = [binaries(m, each_count) for m in (stream, *mine)]
                columns = [batch.column(0), pa.nulls(rows, pa.string()), *[pa.array(v) for v in sums.values()], *per_token]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(add, SCORES)
        out = cut(out.select("doc_id", *SUMS) if last else out, "scores")
        # The table is written, so nobody reads a share again, and the driver need not keep its blocks.
        known.destroy()
        filters.destroy()
        drop(before)
        before = out
    for done in (single, words.filled, pairs.filled):
        drop(done)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
