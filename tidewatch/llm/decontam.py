"""Benchmark decontamination: token windows of documents against a broadcast set of benchmark n-grams.

Words are runs of characters other than ASCII punctuation, controls and space, with A-Z lowered. A window is ``n``
consecutive words of a benchmark item; an item of fewer words is one window. Windows are compared by rolling hashes
of word numbers, and every hit is verified word by word. Spans or whole documents can be removed.

The set is broadcast in blocks of at most ``block_bytes`` of benchmark text. Usually that is one block; a larger
benchmark is scanned block by block over all documents, with the table written in between.

Defined results: null and empty texts have no words and no hits; items without words have no windows; a null item id
is empty text; repeated items count once; documents keep all their columns, and working columns have names of
their own; an empty table on either side gives no hits.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, hits_of, mixed, text_bytes, texts_of

#: Byte by byte: A-Z lowered, what cannot be in a word becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
N, SPANS, ITEMS = "__n_words", "__spans", "__items"
FOUND = f"{N} bigint, {SPANS} array<struct<begin:bigint,end:bigint>>, {ITEMS} array<string>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Windows:
    """Distinct windows of one length: word numbers, sorted hashes, and the items each is in."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.items = items[order]
        self.bounds = np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))
        hashes = self.hashed(self.rows.T)
        by_hash = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[by_hash], by_hash
        if len(hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two benchmark windows share a hash")

    @staticmethod
    def hashed(columns) -> np.ndarray:
        total = np.uint64(0)
        for column in columns:
            total = total * ODD + column.astype(np.uint64)
        return mixed(total)

    def find(self, ids: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a window begins, and which window it is. unknown: running count of zeros in ``ids``."""
        n = self.rows.shape[1]
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.concatenate([[0], unknown[: len(ids) - n]])
        at = np.flatnonzero(unknown[n - 1 :] == before)
        known, where = hits_of(self.hashed(ids[at + j] for j in range(n)), self.hashes)
        at, which = at[known], self.of_hash[where[known]]
        same = (ids[at[:, None] + np.arange(n)] == self.rows[which]).all(axis=1)
        return at[same], which[same]


class NgramSet:
    """All windows of some items, as word numbers over the items' own words."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int64)
            if len(ids):
                size = min(n, len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                by_length.setdefault(size, []).append((rows, np.full(len(rows), k)))
        self.windows = [Windows(np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found])) for found in by_length.values()]

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, the merged ranges of words that are hit, and the items found."""
        number, parts, counts = self.numbers.get, [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        unknown = np.cumsum(ids == 0)
        results = [(c, [], set()) for c in counts]
        for w in self.windows:
            at, which = w.find(ids, unknown)
            owner = np.searchsorted(first, at, "right") - 1
            size = w.rows.shape[1]
            for a, k, d in zip(at.tolist(), which.tolist(), owner.tolist(), strict=True):
                begin = a - int(first[d])
                results[d][1].append((begin, begin + size))
                results[d][2].update(self.names[i] for i in w.items[w.bounds[k] : w.bounds[k + 1]])
        return results


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def blocks(benchmark: DataFrame, n: int, block_bytes: int):
    """The benchmark's n-gram sets, one block at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    many = max(1, math.ceil(text_bytes(rows) / block_bytes))
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k) if many > 1 else rows
        yield NgramSet([(r["item"], r["text"]) for r in part.distinct().collect()], n), k == many - 1


def scanned(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """The documents with their number of words, hit ranges of words and items found, in working columns."""
    spark, schema = docs.sparkSession, ", ".join([docs._jdf.schema().toDDL(), FOUND]) if docs.columns else FOUND
    out = docs
    for ngrams, last in blocks(benchmark, n, block_bytes):
        shared = spark.sparkContext.broadcast(ngrams)

        def scan(batches: Batches, shared=shared) -> Batches:
            for batch in batches:
                found = shared.value.scan(texts_of(batch))
                spans, items = [s for _, s, _ in found], [i for _, _, i in found]
                if SPANS in batch.schema.names:
                    for own, old in zip(spans, batch.column(SPANS).to_pylist(), strict=True):
                        own += [(x["begin"], x["end"]) for x in old]
                    for own, old in zip(items, batch.column(ITEMS).to_pylist(), strict=True):
                        own.update(old)
                kept = [c for c in batch.schema.names if c not in (N, SPANS, ITEMS)]
                span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = [
                    pa.array([c for c, _, _ in found], pa.int64()),
                    pa.array([[{"begin": b, "end": e} for b, e in merged(s)] for s in spans], span_type),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in kept] + columns, [*kept, N, SPANS, ITEMS])

        out = out.mapInArrow(scan, schema)
        if not last:
            out = cut(out, "decontam")
    return out


def hit_words() -> Column:
    return F.aggregate(F.transform(SPANS, lambda s: s["end"] - s["begin"]), F.lit(0).cast("bigint"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, items`` (sorted ids of items with a window in it)."""
    found = scanned(docs.select("doc_id", F.col("text").cast("string")), benchmark, n, block_bytes)
    return found.select("doc_id", F.col(N).alias("n_words"), hit_words().alias("n_hit"), F.array_sort(ITEMS).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, unit: str = "document", n: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Remove hit documents (``unit="document"``), or the hit spans from their texts (``unit="span"``)."""
    found = scanned(docs, benchmark, n, block_bytes)
    if unit == "document":
        return found.where(F.size(SPANS) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

    def remove(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True):
                if spans:
                    words = [m.span() for m in WORD.finditer(text)]
                    for s in reversed(spans):
                        text = text[: words[s["begin"]][0]] + text[words[s["end"] - 1][1] :]
                out.append(text)
            names = [c for c in batch.schema.names if c not in (N, SPANS, ITEMS)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return found.mapInArrow(remove, docs.schema)
