"""Best-fit packing of documents into sequences of a fixed size, from a configuration linear program.

The lengths' histogram (at most ``size`` numbers, whatever the table's size) is the whole problem: choose
configurations, multisets of lengths that fit one sequence, so that every length is covered. The covering program
is solved by multiplicative weights over ranges of lengths: a range that is covered already loses weight, and a
knapsack by dynamic programming prices the next configuration. The fractional solution is rounded down; what it
leaves, and the shortest lengths, are placed best-fit, longest first, in bulk on the histogram. Documents then take the places of their length by rank; ranks
come from counts per written partition, so no length is gathered in one task.

Defined results: a null text is empty (its end id alone is one piece); repeated rows and ids are documents of their
own; an empty table gives no row; other columns are not kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, texts_of
from tidewatch.llm.tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, kind: str | None) -> DataFrame:
    """Pieces of at most ``size`` ids, with their partition and their rank there among pieces of one length."""

    def pieces(batches: Batches) -> Batches:
        encode = encoder(tokenizer, kind).ids
        end, step = np.array([end_id], "<u4").tobytes(), 4 * size
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    schema = PIECES.replace(", part int", "")
    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pieces, schema)
    return cut(found.withColumn("part", F.spark_partition_id()), "pieces")


def best_knapsack(values: np.ndarray, weights: np.ndarray, rooms: int) -> np.ndarray:
    """How often each kind is in the most valuable multiset of kinds of total weight at most ``rooms``.

    A kind is offered once, twice, four times and so on, each offer taken or left, so any number of it can be had.
    """
    best, offers = np.zeros(rooms + 1), []
    for kind in np.flatnonzero(values > 0):
        times = 1
        while (weight := int(weights[kind]) * times) <= rooms:
            gain = best[: rooms + 1 - weight] + values[kind] * times
            better = gain > best[weight:]
            best[weight:] = np.maximum(best[weight:], gain)
            offers.append((kind, times, weight, better))
            times *= 2
    chosen, room = np.zeros(len(values), np.int64), rooms
    for kind, times, weight, better in reversed(offers):
        if room >= weight and better[room - weight]:
            chosen[kind] += times
            room -= weight
    return chosen


def configuration_program(need: np.ndarray, weights: np.ndarray, rooms: int, steps: int, rate: float, spread: float = 0.3) -> list[tuple[np.ndarray, float]]:
    """A fractional covering of ``need`` pieces of each kind: configurations and how often each is used."""
    covered, used = np.zeros(len(need)), {}
    for _ in range(steps):
        left = covered < 1
        if not left.any():
            break
        # Prices start at the lengths, which no full sequence can beat, and fall as a kind is covered; then there is none.
        values = np.where(left, weights * np.exp(-(covered - covered.min()) / spread), 0)
        times = best_knapsack(values, weights, rooms)
        inside = times > 0
        if not inside.any():
            break
        # A step covers at most the share ``rate`` of any kind, and no more than is missing.
        amount = float((np.minimum(rate, 1 - covered[inside]) * need[inside] / times[inside]).min())
        covered[inside] += amount * times[inside] / need[inside]
        covered[covered > 1 - 1e-9] = 1
        key = times.tobytes()
        used[key] = used.get(key, 0.0) + amount
    return [(np.frombuffer(k, np.int64), x) for k, x in used.items()]


def kinds_of(counts: np.ndarray, size: int, kinds: int) -> list[tuple[int, int]]:
    """Ranges of lengths (first, last) with about as many pieces each; the shortest lengths are left out as filling."""
    least = max(1, size // 8)
    lengths = np.flatnonzero(counts[least:]) + least
    if not len(lengths):
        return []
    upto = np.cumsum(counts[lengths])
    group = np.minimum((upto - counts[lengths]) * kinds // upto[-1], kinds - 1)
    return [(int(lengths[group == g].min()), int(lengths[group == g].max())) for g in np.unique(group)]


def taken(left: np.ndarray, first: int, last: int, many: int) -> list[tuple[int, int]]:
    """Take ``many`` pieces of the range out of ``left``, longest first: runs of (length, pieces)."""
    runs = []
    for length in range(last, first - 1, -1):
        if many and left[length]:
            n = min(many, int(left[length]))
            left[length] -= n
            many -= n
            runs.append((length, n))
    return runs


def filled(slots: list[list[tuple[int, int]]], many: int, size: int) -> list[list]:
    """Groups of sequences alike, from the runs of lengths that each place has over ``many`` sequences."""
    ends = sorted({int(e) for runs in slots for e in np.cumsum([n for _, n in runs])})
    lengths = [[n for n, _ in runs] for runs in slots]
    bounds = [np.cumsum([n for _, n in runs]) for runs in slots]
    groups, begin = [], 0
    for end in ends:
        content: dict[int, int] = {}
        for own, bound in zip(lengths, bounds, strict=True):
            length = int(own[np.searchsorted(bound, begin, "right")])
            content[length] = content.get(length, 0) + 1
        groups.append([size - sum(k * v for k, v in content.items()), end - begin, content])
        begin = end
    assert begin == many
    return groups


def best_fit(left: np.ndarray, groups: list[list]) -> list[list]:
    """Place the remaining lengths best-fit, longest first. A group: [free, number of sequences alike, {length: times}]."""
    size = len(left) - 1
    by_room: list[list] = [[] for _ in range(size + 1)]
    for g in groups:
        by_room[g[0]].append(g)
    for length in range(size, 0, -1):
        n = int(left[length])
        room = length
        while n:
            while room <= size and not by_room[room]:
                room += 1
            if room > size:
                each = min(size // length, n)
                whole = n // each
                by_room[size].append([size, whole, {}])
                room = size
            group = by_room[room].pop()
            each = min(room // length, n)
            many = min(group[1], n // each)
            if many < group[1]:
                by_room[room].append([room, group[1] - many, dict(group[2])])
            content = group[2] | {length: group[2].get(length, 0) + each}
            by_room[room - each * length].append([room - each * length, many, content])
            n -= each * many
            room = length
    return [g for room in by_room for g in room if g[2]]


def plan(counts: np.ndarray, size: int, steps: int = 600, kinds: int = 64, rate: float = 0.05) -> list[tuple[int, dict[int, int]]]:
    """Groups of sequences alike: how many, and how often each length is in one.

    The program is solved over ``kinds`` ranges of lengths, each counted as its longest; the
    pieces that then take the places keep their own lengths. Lengths over the program's room are left to best fit.
    """
    left, groups = counts.copy(), []
    ranges_of = kinds_of(counts, size, kinds)
    if ranges_of:
        weights = np.array([last for _, last in ranges_of])
        need = np.array([counts[a : b + 1].sum() for a, b in ranges_of])
        stock = need.copy()
        # Every sequence keeps room for its share of the filling.
        tokens = counts * np.arange(size + 1)
        share = tokens[: ranges_of[0][0]].sum() / tokens.sum()
        rooms = int((1 - share) * size)
        for times, amount in configuration_program(need.astype(float), weights, rooms, steps, rate):
            inside = np.flatnonzero(times)
            many = min(int(amount), int((stock[inside] // times[inside]).min()))
            if many:
                stock[inside] -= many * times[inside]
                slots = [taken(left, *ranges_of[k], many) for k in inside for _ in range(times[k])]
                groups += filled(slots, many, size)
    return [(g[1], g[2]) for g in best_fit(left, groups)]


def places(groups: list[tuple[int, dict[int, int]]]) -> dict[int, tuple]:
    """By length: first rank, first sequence, offset in it and places in one sequence of each run of places."""
    runs: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for many, content in groups:
        offset = 0
        for length, times in sorted(content.items(), reverse=True):
            runs.setdefault(length, []).append((taken.get(length, 0), first, offset, times))
            taken[length] = taken.get(length, 0) + times * many
            offset += times * length
        first += many
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, kind: str | None = None, steps: int = 600) -> DataFrame:
    """One row per piece with its sequence and its offset there. ``steps`` bounds the pricing steps on the driver."""
    pieces = cut_pieces(docs, tokenizer, end_id, size, kind)
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    spots = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size, steps)))

    def place(batches: Batches) -> Batches:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                begin, first, at, times = spots.value[int(length)]
                run = np.searchsorted(begin, ranks[mine], "right") - 1
                within = ranks[mine] - begin[run]
                sequence[mine] = first[run] + within // times[run]
                offset[mine] = at[run] + within % times[run] * length
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # Rank of a piece among all of its length: pieces in earlier partitions, then its rank in its own.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
