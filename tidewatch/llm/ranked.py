"""Ranked lexical search: items against all documents by dense blocked matrix products.

Terms are runs of characters other than ASCII punctuation, controls and space, with A-Z lowered. One scan keeps of
every document its number of terms and how often it has each term of the items, as a compact table in the shared
folder; document frequencies and totals come from that table. A second scan reads it in tiles of documents: of the
items' terms those that occur in the tile are its columns, whose weights (items x terms) are multiplied with the
tile's impacts (terms x documents) in float64 by BLAS. All entries are whole numbers and a weight tile has so few
columns that no sum can reach 2^53, so every product is exact; tiles of columns are added up as 64-bit integers.

Each task keeps the best ``k`` documents per item over its tiles: all scores at or above the item's k-th best so far
go on, ties included, and are cut by score and then id. The tasks' lists, at most ``k`` rows an item and task, are
joined by two ranked steps, first in shares.

Items are read in blocks of at most ``block_bytes`` of text, each with its own scans; that bounds what is broadcast,
whatever the number of items.

Defined results: null and empty texts have no terms; items without terms, or without a document scoring above 0,
have no rows; items with one id and one text are one item, a null item id stays null; documents without an id count
in N, L and df, but cannot be ranked; of rows with one id each is a document; other columns are neither used nor kept.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, hits_of, portions, ranges, text_bytes, texts_of
from tidewatch.llm.decontam import FOLD

#: Above any impact: (10^9 * tf) div (1000 * tf + 12 * m) is below 10^6.
MOST_IMPACT, EXACT = 10**6, 1 << 53
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 512, 4096, 1024
SHARES = 64


def term_counts(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Per row ``doc_id, n`` (terms with repeats), and the items' terms it has: ``terms, times``. Rows without any
    term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Batches) -> Batches:
        known = shared.value.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in texts_of(batch):
                size, found = 0, np.zeros(len(shared.value), np.int64)
                for part in portions(text.encode("utf-8", "surrogatepass").translate(FOLD)):
                    words = part.split()
                    size += len(words)
                    ids = np.fromiter(map(known, words, repeat(-1)), np.int64, len(words))
                    found += np.bincount(ids[ids >= 0], minlength=len(found))
                sizes.append(size)
                terms.append(np.flatnonzero(found).astype(np.int32))
                times.append(found[terms[-1]])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (terms, times)] if terms else []
            if lists:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<bigint>").where("n > 0")


class Weights:
    """Some items by their terms: what the occurrences in an item are worth, in tiles of columns whose sums stay exact."""

    def __init__(self, first: int, items: list[Counter], number: dict[bytes, int], worth: np.ndarray):
        entries = [(i, number[t], q) for i, item in enumerate(items) for t, q in item.items()]
        self.first, self.count = first, len(items)
        self.row, self.term, q = np.array(entries, np.int64).reshape(-1, 3).T
        self.value = q * worth[self.term]
        self.known = np.unique(self.term)

    def tiles(self, present: np.ndarray):
        """The columns ``present`` (sorted terms), tile by tile, with their dense weights. A weight too large for an
        exact product, as of a term an item repeats a million times, comes in portions, each in a tile of its own."""
        at = np.searchsorted(present, self.term)
        at[at == len(present)] = 0
        here = present[at] == self.term
        row, column, rest = self.row[here], at[here], self.value[here]
        limit = EXACT // MOST_IMPACT - 1
        while len(rest):
            value, begin = np.minimum(rest, limit), 0
            while begin < len(present):
                end = min(begin + TILE_TERMS, len(present))
                while True:
                    inside = (column >= begin) & (column < end)
                    dense = np.zeros((self.count, end - begin))
                    dense[row[inside], column[inside] - begin] = value[inside]
                    if dense.sum(axis=1).max(initial=0) <= limit or end - begin == 1:
                        break
                    end = begin + (end - begin) // 2
                yield begin, end, dense
                begin = end
            more = rest > limit
            row, column, rest = row[more], column[more], rest[more] - limit


def scores(weights: Weights, doc: np.ndarray, docs: int, terms: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Items by documents of one tile, as whole numbers, from the entries of a sparse matrix of impacts."""
    own, _ = hits_of(terms, weights.known)
    present, column = np.unique(terms[own], return_inverse=True)
    doc, impact = doc[own], impact[own]
    total = np.zeros((weights.count, docs), np.int64)
    if len(present):
        for begin, end, dense in weights.tiles(present):
            inside = (column >= begin) & (column < end)
            tile = np.zeros((end - begin, docs))
            tile[column[inside] - begin, doc[inside]] = impact[inside]
            total += (dense @ tile).astype(np.int64)
    return total


class Best:
    """The best documents of every item so far."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.least = np.ones(items, np.int64)
        self.pool: list[np.ndarray] = []
        self.size = 0

    def add(self, first: int, total: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the items from ``first`` on."""
        item, doc = np.nonzero(total >= self.least[first : first + len(total), None])
        self.pool.append(np.stack([first + item, total[item, doc], ids[doc]]))
        self.size += len(item)
        if self.size > max(1 << 16, 4 * self.items * self.k):
            self.rows()

    def rows(self) -> np.ndarray:
        """Item, score and document of the best, by falling score and rising id; the pool is cut to them."""
        item, score, doc = np.concatenate([np.zeros((3, 0), np.int64), *self.pool], axis=1)
        order = np.lexsort((doc, -score, item))
        place = ranges(np.bincount(item, minlength=self.items))
        order = order[place < self.k]
        kept = np.stack([item[order], score[order], doc[order]])
        last = place[place < self.k] == self.k - 1
        self.least[kept[0][last]] = kept[1][last]
        self.pool, self.size = [kept], kept.shape[1]
        return kept


def best_in_tasks(counts: DataFrame, weights: list[Weights], documents: int, length: int, k: int) -> DataFrame:
    """``item`` (its number), ``score, doc_id``: each task's best."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Batches) -> Batches:
        best = Best(sum(w.count for w in shared.value), k)
        for batch in batches:
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            norm = 75 + (25 * n * documents) // length
            ends = batch.column("terms").offsets.to_numpy()
            terms, times = (batch.column(c).values.to_numpy() for c in ("terms", "times"))
            for at in range(0, len(n), TILE_DOCS):
                to = min(at + TILE_DOCS, len(n))
                span = slice(ends[at], ends[to])
                doc, tf = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), times[span]
                impact = (10**9 * tf) // (1000 * tf + 12 * norm[at:to][doc])
                for w in shared.value:
                    best.add(w.first, scores(w, doc, to - at, terms[span], impact), ids[at:to])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["item", "score", "doc_id"])

    rows = counts.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "times")
    return rows.mapInArrow(run, "item bigint, score bigint, doc_id bigint")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows per item, in shares first."""
    order = [F.desc("score"), "doc_id"]
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    some = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order)))
    return some.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """Per item its ``k`` documents of highest score above 0: ``item_id, rank, doc_id, score``.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 75 + (25 n N) div L, and the score
    sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.
    """
    spark, out = docs.sparkSession, None
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    many = max(1, math.ceil(text_bytes(rows) / block_bytes))
    for block in range(many):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == block) if many > 1 else rows
        found = part.toArrow()  # about block_bytes
        bags = [Counter(t.encode("utf-8", "surrogatepass").translate(FOLD).split()) for t in found["text"].to_pylist()]
        number = {t: j for j, t in enumerate(dict.fromkeys(t for bag in bags for t in bag))}
        counts = cut(term_counts(docs, number), "terms")
        totals = counts.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not totals["N"] or not number:
            continue
        df = np.zeros(len(number), np.int64)
        have = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row per term of the block
        df[have["t"].to_numpy()] = have["df"].to_numpy()
        worth = np.array([math.floor(1000 * math.log((2 * totals["N"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        weights = [Weights(at, bags[at : at + TILE_ITEMS], number, worth) for at in range(0, len(bags), TILE_ITEMS)]
        best = ranked(best_in_tasks(counts, weights, totals["N"], totals["L"], k), k)
        ids = pa.table({"item": pa.array(range(len(bags)), pa.int64()), "item_id": found["item_id"]})
        named = spark.createDataFrame(ids).join(best, "item")
        named = named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        out = spark.createDataFrame([], f"item_id {rows.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return out
