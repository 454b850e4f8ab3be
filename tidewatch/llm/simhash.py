"""Near-duplicate documents by SimHash: fingerprints of 64 bits, joined by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of the XXH64 hashes of the text's word n-grams have it, repeats
counted each. Two documents link when their fingerprints differ in at most ``radius`` bits.

Every bit position gets a non-zero vector of ``radius + 1`` bits. A mask, one for each non-zero vector v, holds the
positions whose vector has an odd inner product with v. Whatever ``radius`` positions two fingerprints differ in, some
v is orthogonal to the vectors of all of them, so under that mask both agree: every pair within the radius meets in
some table, with certainty. Fingerprints that share a table's key are one bucket, compared in numpy.

No bucket is compared while it has more than ``most`` fingerprints. It is dealt again: all its fingerprints agree on
the mask's positions, and the others, about half, get vectors and masks of their own, which cover them alike. A few
such steps leave so few free positions that a bucket cannot be large. So nothing is dropped, and a group of k near
copies costs no k * k pairs.

Fingerprints are distinct before they are dealt, so exact copies cost nothing there. Buckets give links to one
member of each of their linked groups, not all pairs; components over them are those of all links.

Defined results: null and empty texts have fingerprint zero, linked like any other; fewer words than ``n`` are one
n-gram; rows without an id get a fingerprint and a null component, and link nothing; repeated rows are rows of one
document; other columns are neither used nor kept; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, portions, texts_of
from tidewatch.llm.components import components

BITS, SEED = 64, 42
#: Byte by byte: A-Z lowered, white space as one kind.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
STEP = 1 << 16


def hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of every run of ``n`` words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], SEED) for b, e in spans), np.uint64, len(words) - n + 1)


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, the lowest first."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(values), STEP):
        part = np.ascontiguousarray(values[at : at + STEP], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, n: int = 3) -> int:
    total, count, carried = np.zeros(BITS, np.int64), 0, []
    for part in portions(text.encode("utf-8", "surrogatepass").translate(FOLD)):
        words = carried + part.split()
        if len(words) >= n:
            found = hashes(words, n)
            total += bit_counts(found)
            count += len(found)
        carried = words[max(0, len(words) - n + 1) :]
    if not count and carried:
        total, count = bit_counts(hashes(carried, len(carried))), 1
    return sum(1 << int(b) for b in np.flatnonzero(2 * total > count))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """Per row ``doc_id, bits``, the fingerprint as a signed number."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = np.array([fingerprint(t, n) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, bits bigint")


@lru_cache(maxsize=None)
def mask(table: int, radius: int) -> int:
    """Bits that fingerprints of one bucket of a table agree in. Table 0 has one bucket; the tables that deal the
    buckets of table t anew are ``t << (radius + 1) | v`` for each non-zero vector v."""
    if not table:
        return 0
    kinds = (1 << (radius + 1)) - 1
    before = mask(table >> (radius + 1), radius)
    free = [b for b in range(BITS) if not before >> b & 1]
    chosen = [b for k, b in enumerate(free) if (1 + k % kinds & table & kinds).bit_count() % 2]
    return before | sum(1 << b for b in chosen)


def dealt(rows: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint of ``table, bits, rep`` in all tables below its own, with its key there."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            tables, bits, rep = (batch.column(c).to_numpy() for c in ("table", "bits", "rep"))
            for v in range(1, 1 << (radius + 1)):
                below = tables << (radius + 1) | v
                kept = np.zeros(len(below), np.int64)
                for t in np.unique(below):
                    kept[below == t] = np.uint64(mask(int(t), radius)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (below, bits & kept, bits, rep)], ["table", "key", "bits", "rep"])

    return rows.select("table", "bits", "rep").mapInArrow(run, "table bigint, key bigint, bits bigint, rep bigint")


def groups(bits: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a bucket the first one it is linked to, over any number of links."""
    first, left = np.full(len(bits), -1), np.arange(len(bits))
    while len(left):
        seed, reached, left = left[0], left[:1], left[1:]
        while len(reached):
            first[reached] = seed
            near = np.zeros(len(left), bool)
            for at in range(0, len(reached), 256):
                near |= (np.bitwise_count(bits[reached[at : at + 256], None] ^ bits[None, left]) <= radius).any(axis=0)
            reached, left = left[near], left[~near]
    return first


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links ``u, v`` between documents from buckets of bounded size, ``members`` being structs of bits and rep."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            bits, rep = flat.field("bits").to_numpy().view(np.uint64), flat.field("rep").to_numpy()
            ends = np.cumsum(np.fromiter(map(len, members), np.int64, len(members)))
            us, vs = [rep[:0]], [rep[:0]]
            for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                first = groups(bits[begin:end], radius)
                other = first != np.arange(end - begin)
                us.append(rep[begin:end][other])
                vs.append(rep[begin:end][first[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return buckets.select("members").mapInArrow(run, "u bigint, v bigint")


def links(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """Links ``u, v`` that join all fingerprints (``bits, rep``) within the radius, directly or over others."""
    rows, found = distinct.select(F.lit(0).cast("bigint").alias("table"), "bits", "rep"), None
    while rows is not None:
        entries = dealt(rows, radius)
        # Map-side combined: two members of a bucket and how many it has. Most buckets have one or two.
        low, high = F.min(F.struct("bits", "rep")).alias("low"), F.max(F.struct("bits", "rep")).alias("high")
        buckets = cut(entries.groupBy("table", "key").agg(F.count("*").alias("k"), low, high).where("k > 1"), "buckets")
        near = F.bit_count(F.col("low.bits").bitwiseXOR(F.col("high.bits"))) <= radius
        new = [buckets.where((F.col("k") == 2) & near).select(F.col("high.rep").alias("u"), F.col("low.rep").alias("v"))]
        shared = entries.join(buckets.where("k > 2").select("table", "key", "k"), ["table", "key"])
        small = shared.where(F.col("k") <= most).groupBy("table", "key").agg(F.collect_list(F.struct("bits", "rep")).alias("members"))
        new.append(bucket_links(small, radius))
        part = cut(new[0].union(new[1]).distinct(), "links")
        found = part if found is None else found.union(part)
        rows = None if buckets.where(F.col("k") > most).isEmpty() else cut(shared.where(F.col("k") > most).select("table", "bits", "rep"), "large")
    return found


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, most: int = 2048) -> DataFrame:
    """Per row ``doc_id, fingerprint`` (hex digits) and ``component_id``, the least id it is linked to over any number of links.

    ``most`` is how many fingerprints a bucket may have to be compared; larger ones are dealt again, so it decides
    about work and memory, never about links. It must hold what three dealings leave, 2 ** 8 fingerprints.
    """
    if most < 256 or not 0 <= radius <= 3:
        raise ValueError("the masks are made for a radius of 0 to 3; a bucket that cannot be dealt further may have 256 fingerprints")
    marked = cut(fingerprints(docs, n), "fingerprints")
    distinct = cut(marked.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, radius, most))
    named = distinct.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("bits").alias("own"), F.coalesce("root", "rep").alias("component_id"))
    whole = marked.join(named, F.col("bits") == F.col("own"), "left")
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return whole.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
