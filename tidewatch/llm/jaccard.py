"""Near-duplicate documents: an exact Jaccard join on sets of word n-grams, as a blocked sparse matrix product.

Rows of the matrix are distinct sets of n-grams (documents with one set are one row), columns are n-grams, dealt to
tasks by hash: the blocks. For a similarity of ``num/den`` a row of size n shares one of its first
``n - ceil(n * num / den) + 1`` columns with every row it links to, in any order of columns that all rows keep. The
order here puts columns first that have a word of no other document, which need no entry as they match nothing, and
columns last that a sample of the rows shows to be frequent, the most frequent at the very end. The sample is a fixed
share of the rows, so a column counts as frequent from about the same number of rows on at every size; filters and
sample decide about speed alone. Products of these leading parts are accumulated per pair of rows, and a pair is
discarded as soon as its sizes, or its overlap so far plus all that can still come, miss the bound. A sketch of each
set, a bit for whether an odd number of its n-grams have a value, then bounds what two sets differ by from below: where
sketches differ, so do the sets. Only pairs that this leaves are completed with the rows' whole sets.

A group of k near copies never makes k * k pairs: in rounds, each column's rows are paired with one of them, found
links join rows to components, and only pairs across components go on. Pairs that no round has joined are all
compared in the last one, so no link that changes a component is lost. Where few pairs have a column in common, they come
straight from the columns, without blocks, behind one round on the first columns of each row.

Defined results: null and empty texts have an empty set and are linked with nothing, as are rows without an id; a
text of fewer words is one n-gram; rows with one id and one text are one document; other columns are not needed,
and are kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, cut, drop, mixed, ranges, texts_of
from tidewatch.llm.components import components
from tidewatch.llm.langid import pieces
from tidewatch.llm.lm import portions_of

#: Odd multipliers, one for each word of an n-gram.
STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: An odd multiplier of a word's portions of eight bytes, and masks of the bytes that its last one has.
PORTION = np.uint64(0x9FB21C651E98DF25)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of words that are hashed all at once; longer ones are hashed one by one.
LONG_WORD = 256
#: Characters of whole texts that are taken apart at once.
TEXT_STEP = 1 << 20
#: Bits of a filter that is broadcast: 8 MB whatever the input's size; a fuller filter lets more pass, never less.
FILTER_BITS = 26
#: The share of rows in the sample, and the hits in it from which a column is frequent, or very frequent.
SAMPLE, SAMPLE_HITS = 1 / 16, (3, 64)
BLOCK_ROWS = 2048
#: At most so many rounds of one pair per entry; the last one, of all pairs left, begins once they are few: so many for
#: each entry, or so many in all, which take less time than another round.
ROUNDS, PAIRS_PER_ENTRY, FEW_PAIRS = 4, 8, 1 << 23
#: Columns besides one that a pair has to share among those first in both rows, where their sizes allow it: more of them
#: leave fewer pairs that do not link, and take longer leading parts.
MORE_IN_COMMON = 3
#: Columns of a row that the round before pairs straight from the columns looks at.
FIRST_COLUMNS = 16


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, one after the other, and where each text's words end.

    A word's bytes are taken eight at a time, for all words together; words of up to eight bytes have no hash in common.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" " + b" ".join(parts) + b" " * 9).lower(), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = mixed(size.astype(np.uint64))
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        some = eights[begin[left] + at] & MASKS[np.minimum(size[left] - at, 8)]
        hashes[left] = mixed(hashes[left] + some * PORTION)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[begin[k] : begin[k] + size[k]])
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begin, ends + 1)


def distinct(values: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the marks that they have."""
    order = np.argsort(values)
    values = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first], mark[order][first]


def shingles(texts: list[str], n: int, seen: Filter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its n-grams; with a filter of words that more texts have, also whether
    an n-gram has a word that no other text has."""
    for first, last in pieces(texts, TEXT_STEP):
        words, ends = word_hashes(texts[first:last])
        own = np.concatenate([[0], np.cumsum(~seen.may_have(words))]) if seen else np.zeros(len(words) + 1, np.int64)
        many = max(len(words) - n + 1, 0)
        total = np.full(many, n, np.uint64)
        for j in range(n):
            total += words[j : j + many] * STEPS[j]
        total, alone = mixed(total), own[n:] > own[: len(own) - n] if many else np.zeros(0, bool)
        begin = 0
        for end in ends.tolist():
            size = end - begin
            if size >= n:
                yield distinct(total[begin : end - n + 1], alone[begin : end - n + 1])
            elif size:
                whole = np.uint64(size) + (words[begin:end] * STEPS[:size]).sum(dtype=np.uint64)
                yield mixed(np.array([whole])), np.array([own[end] > own[begin]])
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, bool)
            begin = end


def key_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch_of(hashes: np.ndarray) -> bytes:
    """A bit for each value of the hashes modulo a power of two above their number: whether an odd number have it."""
    bits = max(256, 1 << len(hashes).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """The least number of hashes that are in one of two sets only, by their sketches."""
    while len(a) != len(b):  # the halves of a sketch, taken together, are the sketch of half its size
        a, b = sorted((a, b), key=len)
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def tag_of(key: bytes, doc_id: int) -> int:
    """A signed 64-bit mark of one document's set."""
    return xxhash.xxh3_64_intdigest(key + doc_id.to_bytes(8, "little", signed=True)) - (1 << 63)


def flat(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as one column of lists of signed numbers."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


class Filter:
    """A bit per hash value modulo its size: what is not in it was not put in."""

    def __init__(self, values: DataFrame, column: str):
        bit = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        words = values.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Join:
    """The join of one table of documents; each step is a table in the shared folder."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.spark = docs.sparkSession
        self.rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        self.written: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """A written table that :meth:`clear` deletes."""
        self.written.append(cut(df, name))
        return self.written[-1]

    def clear(self, *still_read: DataFrame) -> None:
        """Delete the join's tables but those that are still to be read."""
        for done in self.written:
            if all(done is not df for df in still_read):
                drop(done)
        self.written = [df for df in self.written if any(df is other for other in still_read)]

    def scan(self, schema: str, make: Callable[[list, list[np.ndarray]], list], rows: DataFrame | None = None) -> DataFrame:
        n, names = self.n, [c.split()[0] for c in schema.split(", ")]

        def run(batches: Batches) -> Batches:
            for batch in portions_of(batches, "text"):
                sets = [h for h, _ in shingles(texts_of(batch), n)]
                yield pa.RecordBatch.from_arrays(make(batch.column("doc_id").to_pylist(), sets), names)

        return (self.rows if rows is None else rows).mapInArrow(run, schema)

    def frequent(self) -> list[Filter]:
        """Filters of the columns that are frequent and very frequent in a sample of the documents."""
        found = self.scan("h array<bigint>", lambda ids, sets: [flat(sets)], self.rows.sample(SAMPLE, seed=7))
        counts = found.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("k"))
        often = cut(counts.where(F.col("k") >= SAMPLE_HITS[0]), "frequent")
        filters = [Filter(often.where(F.col("k") >= hits), "h") for hits in SAMPLE_HITS]
        drop(often)
        return filters

    def seen_words(self) -> Filter:
        """A filter of the words that more than one document has."""

        def count(batches: Batches) -> Batches:
            for batch in batches:
                texts = texts_of(batch)
                for begin, end in pieces(texts, 1 << 24):
                    own = []
                    for first, last in pieces(texts[begin:end], TEXT_STEP):
                        words, ends = word_hashes(texts[begin + first : begin + last])
                        own += map(np.unique, np.split(words, ends[:-1]))
                    h, c = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        counts = self.rows.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
        return Filter(counts.where("c > 1"), "h")

    def marked(self) -> DataFrame:
        """Every document's set: ``doc_id, n`` (its size), ``key`` (null: an empty set or no id), ``tag``, ``sketch``, and the
        leading columns that another row may have, behind ``own`` ones that none has."""
        shared = self.spark.sparkContext.broadcast((self.frequent(), self.seen_words()))
        num, den, size = self.num, self.den, self.n

        def make(batches: Batches) -> Batches:
            frequent, seen = shared.value
            for batch in portions_of(batches, "text"):
                ids, keys, tags, sizes, owns, leads, sketches = batch.column(0), [], [], [], [], [], []
                for i, (hashes, alone) in zip(ids.to_pylist(), shingles(texts_of(batch), size, seen), strict=True):
                    named = i is not None and len(hashes) > 0
                    # All but the overlap it needs with any set, and one; columns of its own come first and match nothing.
                    lead = len(hashes) + len(hashes) * -num // den + 1 - int(alone.sum()) if named else 0
                    rest = hashes[~alone] if lead > 0 else hashes[:0]
                    late = sum(level.may_have(rest).astype(np.int8) for level in frequent)
                    leads.append(rest[np.argsort(late, kind="stable")[: max(lead, 0)]])
                    keys.append(key_of(hashes) if named else None)
                    tags.append(tag_of(keys[-1], i) if named else 0)
                    sizes.append(len(hashes))
                    owns.append(int(alone.sum()))
                    sketches.append(sketch_of(hashes) if named else None)
                columns = [ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tags, pa.int64()), pa.array(sketches, pa.binary()), pa.array(owns, pa.int32()), flat(leads)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "tag", "sketch", "own", "lead"])

        return self.cut(self.rows.mapInArrow(make, "doc_id bigint, n bigint, key binary, tag bigint, sketch binary, own int, lead array<bigint>"), "marked")

    def classes(self, marked: DataFrame) -> DataFrame:
        """Distinct sets: ``cid, key, rep`` (least id), ``tag`` of its document, ``n``, ``sketch``, ``own``, and their leading columns."""
        first = F.min(F.struct("doc_id", "tag"))
        one = marked.where("key is not null").groupBy("key").agg(first.alias("d"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), F.first("lead").alias("lead"))
        named = F.monotonically_increasing_id().alias("cid"), "key", F.col("d.doc_id").alias("rep"), F.col("d.tag").alias("tag")
        return self.cut(one.select(*named, "n", "sketch", "own", "lead"), "classes")

    def columns(self, classes: DataFrame) -> DataFrame:
        """Leading columns that more than one row has: ``s``, and how many rows have it (``k``)."""
        entries = classes.select(F.explode("lead").alias("s"))
        return self.cut(entries.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") > 1), "columns")

    def shared_entries(self, classes: DataFrame, often: DataFrame) -> DataFrame:
        """``cid, n, s`` for the leading columns of rows that more than one row has, and for few others; ``at`` is a
        column's place among those of the row, ``turn`` its place among these leading ones, of which there are ``shared``."""
        shared = self.spark.sparkContext.broadcast(Filter(often, "s"))

        def likely(batches: Batches) -> Batches:
            for batch in batches:
                lead = batch.column("lead")
                counts = pc.list_value_length(lead).to_numpy()
                values, owner = lead.flatten().to_numpy(), np.repeat(np.arange(len(lead)), counts)
                at = (ranges(counts) + batch.column("own").to_numpy()[owner]).astype(np.int32)
                pick = shared.value.may_have(values)
                rows, mine = pa.array(owner[pick]), np.bincount(owner[pick], minlength=len(lead))
                columns = [batch.column("cid").take(rows), batch.column("n").take(rows), pa.array(values[pick]), pa.array(at[pick])]
                columns += [pa.array(x.astype(np.int32)) for x in (ranges(mine), np.repeat(mine, mine))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "n", "s", "at", "turn", "shared"])

        # Most entries are of columns that no other row has; the filter spares them the shuffle of the joins.
        return classes.select("cid", "n", "own", "lead").mapInArrow(likely, "cid bigint, n bigint, s bigint, at int, turn int, shared int")

    def postings(self, some: DataFrame, often: DataFrame) -> DataFrame:
        """Rows with their leading columns that more than one row has: ``cid, n, lead``, how many these are (``shared``)
        and how many rows they have in all (``weight``)."""
        per_row = some.join(often, "s").groupBy("cid").agg(F.first("n").alias("n"), F.collect_list(F.struct("s", "at")).alias("lead"), F.count("*").alias("shared"), F.sum("k").alias("weight"))
        return self.cut(per_row, "postings")

    def sizes_fit(self) -> Column:
        return F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num

    def can_reach(self, overlap: Column) -> Column:
        """Whether a pair with this overlap of leading columns can still link: whatever else both have lies behind the
        leading columns of one of them."""
        behind = F.floor((F.greatest("na", "nb") * self.num + (self.den - 1)) / self.den) - 1
        # overlap >= num / den * union, with union = na + nb - overlap
        return (overlap + behind) * (self.num + self.den) >= (F.col("na") + F.col("nb")) * self.num

    def with_roots(self, rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("cid"))
        named = roots.select(F.col("node").alias("cid"), "root")
        return rows.join(named, "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    def entries(self, postings: DataFrame, roots: DataFrame | None) -> DataFrame:
        """A row for each column of a row, its root joined once a row."""
        return self.with_roots(postings, roots).select("cid", "n", "shared", "weight", "root", F.inline("lead"))

    def star_pairs(self, entries: DataFrame, turn: int) -> DataFrame:
        """Each column's rows with one of them, across components: first the row that shares most, then any."""
        mark = F.xxhash64("cid", F.lit(turn)) if turn else -F.col("weight")
        lead = entries.groupBy("s").agg(F.min(F.struct(mark.alias("mark"), "cid", "n", "shared", "root")).alias("lead"))
        pairs = entries.join(lead, "s").where(F.col("root") != F.col("lead.root"))
        pairs = pairs.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("lead.cid").alias("b"), F.col("lead.n").alias("nb"), F.least("shared", "lead.shared").alias("overlap"))
        return pairs.where(self.sizes_fit() & self.can_reach(F.col("overlap"))).select(*ordered()).distinct()

    def first_pairs(self, some: DataFrame) -> DataFrame:
        """Each column's rows with the one of them that shares most, by the first columns of every row.

        Copies have most of these in common, so nearly all of a group are linked here by a pair or a few a row; what
        is not, the pairs of all columns find."""
        first = some.where(F.col("turn") < FIRST_COLUMNS).select("s", "cid", "n", "shared")
        lead = first.groupBy("s").agg(F.max(F.struct("shared", "cid", "n")).alias("lead"))
        pairs = first.join(lead, "s").where(F.col("cid") != F.col("lead.cid"))
        pairs = pairs.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("lead.cid").alias("b"), F.col("lead.n").alias("nb"))
        return pairs.where(self.sizes_fit()).select(*ordered()).distinct()

    def few_left(self, entries: DataFrame) -> bool:
        """Whether the pairs across components are no more than a few for each entry."""
        own = entries.groupBy("s", "root").agg(F.count("*").alias("c"))
        open_pairs = own.groupBy("s").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same"))
        sums = open_pairs.agg(F.sum("k").alias("entries"), F.sum((F.col("k") * F.col("k") - F.col("same")) / 2).alias("pairs")).first()
        return self.few(sums["pairs"] or 0, sums["entries"] or 0)

    def few(self, pairs: float, entries: int) -> bool:
        """Whether so many pairs are no more than a few for each of the entries, or few at any size."""
        return pairs <= max(FEW_PAIRS, PAIRS_PER_ENTRY * entries)

    def column_pairs(self, entries: DataFrame) -> DataFrame:
        """All pairs of rows with enough columns in common that are in different components, each column's rows with each
        other: for columns whose pairs are few.

        Rows of sizes na and nb link with ``need`` columns in common. Behind the first ``more + 1`` of these are the others
        in both rows, so these have places up to ``na - need + more`` and ``nb - need + more``, which are leading ones.
        """
        one, other = ([F.col(c).alias(x) for c, x in (("cid", i), ("n", "n" + i), ("root", "r" + i), ("at", "at" + i))] for i in "ab")
        ceiled = lambda x, by: F.floor((x + (by - 1)) / by)
        need = ceiled((F.col("na") + F.col("nb")) * self.num, self.num + self.den)
        more = F.least(F.lit(MORE_IN_COMMON), need - ceiled(F.greatest("na", "nb") * self.num, self.den))
        leading = (F.col("ata") <= F.col("na") - need + more) & (F.col("atb") <= F.col("nb") - need + more)
        both = entries.select("s", *one).join(entries.select("s", *other), "s")
        both = both.where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & self.sizes_fit() & leading)
        overlaps = both.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("overlap"))
        return overlaps.where(F.col("overlap") > more).select("a", "na", "b", "nb")

    def all_pairs(self, entries: DataFrame) -> DataFrame:
        """All pairs of rows with a column in common that are still in different components, by blocks of the product.

        A column's largest component needs no comparing among its own, so only the other rows are multiplied, with
        all. Rows that share their heaviest column's central row are multiplied together, in blocks of at most about
        BLOCK_ROWS rows on either side; a block's task accumulates overlaps and emits what its bound leaves.
        """
        entries = entries.drop("at")
        many = entries.groupBy("s").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("s")
        rows = cut(entries.join(many, "s", "left_semi"), "open")
        largest = rows.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.max(F.struct("c", "root")).alias("top"))
        central = rows.groupBy("s").agg(F.count("*").alias("k"), F.max(F.struct("weight", "cid")).alias("center"))
        outside = rows.join(largest, "s").where(F.col("root") != F.col("top.root")).join(central, "s")
        homes = cut(outside.groupBy("cid").agg(F.max(F.struct("k", "center.cid")).alias("h")).select("cid", F.col("h.cid").alias("home")), "homes")
        total = homes.count()
        if not total:
            return self.spark.createDataFrame([], "a bigint, na bigint, b bigint, nb bigint")
        per_home = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("left_parts"))
        together = F.when(F.col("left_parts") > 1, F.col("home")).otherwise(-1 - F.pmod(F.xxhash64("home"), F.lit(-(-total // BLOCK_ROWS))))
        named = homes.join(per_home, "home").select("cid", together.alias("block"), "left_parts")
        left = rows.join(named, "cid").select("block", "left_parts", "s", "cid", "n", "root")
        right = rows.join(left.select("block", "s").distinct(), "s").select("block", "s", "cid", "n", "root")
        parts = right.groupBy("block").agg(F.ceil(F.count_distinct("cid") / BLOCK_ROWS).alias("right_parts"))
        shape = left.groupBy("block").agg(F.max("left_parts").alias("left_parts")).join(parts, "block")
        part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("bigint")
        zero = F.lit(0).cast("bigint")
        row = ["block", "i", "j", "s", "cid", "n", "root"]
        left = cut(left.drop("left_parts").join(shape, "block").withColumn("i", part("left_parts")), "block-rows")
        right = cut(right.join(shape, "block").withColumn("j", part("right_parts")), "block-rows")
        # An entry goes to those parts of the other side that have its column; to the only one there is without a look.
        at_right, at_left = right.where("right_parts > 1").select("block", "s", "j").distinct(), left.where("left_parts > 1").select("block", "s", "i").distinct()
        left_rows = left.where("right_parts = 1").withColumn("j", zero).select(row).union(left.where("right_parts > 1").join(at_right, ["block", "s"]).select(row))
        right_rows = right.where("left_parts = 1").withColumn("i", zero).select(row).union(right.where("left_parts > 1").join(at_left, ["block", "s"]).select(row))
        num, den = self.num, self.den
        keys = ["block", "i", "j"]
        found = left_rows.groupBy(*keys).cogroup(right_rows.groupBy(*keys)).applyInArrow(lambda x, y: product(x, y, num, den), "a bigint, na bigint, b bigint, nb bigint")
        pairs = self.cut(found.distinct(), "pairs")
        for table in (rows, homes, left, right):
            drop(table)
        return pairs

    def ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()

    def likely(self, pairs: DataFrame, rows: DataFrame) -> DataFrame:
        """The pairs whose sketches leave it open whether they link; any that does link is among them."""
        num, den = self.num, self.den

        def keep(batches: Batches) -> Batches:
            for batch in batches:
                differ = np.array([apart(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
                both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                # The overlap is at most half of what both have less what they differ by.
                yield batch.select(["a", "na", "b", "nb"]).filter(pa.array((both - differ) * (num + den) >= 2 * both * num))

        mine, other = rows.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), rows.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
        both = pairs.join(mine, "a").join(other, "b").select("a", "na", "b", "nb", "sa", "sb")
        return self.cut(both.mapInArrow(keep, "a bigint, na bigint, b bigint, nb bigint"), "likely")

    def sets_of(self, pairs: DataFrame, rows: DataFrame, known: DataFrame | None) -> DataFrame | None:
        """Whole sets ``cid, hashes`` of all rows in pairs; those not known yet are read from their documents."""
        ends = self.ends(pairs)
        if known is not None:
            ends = ends.join(known.select("cid"), "cid", "left_anti")
        wanted = self.cut(ends.join(rows.select("cid", "tag", "rep"), "cid"), "wanted")
        if wanted.isEmpty():
            return known
        shared, n = self.spark.sparkContext.broadcast(Filter(wanted, "rep")), self.n

        def make(batches: Batches) -> Batches:
            for batch in portions_of(batches, "text"):
                ids = np.array([0 if i is None else i for i in batch.column(0).to_pylist()], np.int64)
                pick = np.flatnonzero(shared.value.may_have(ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
                texts = batch.column(1)
                sets = [h for h, _ in shingles([texts[k].as_py() or "" for k in pick.tolist()], n)]
                tags = np.array([tag_of(key_of(s), i) for s, i in zip(sets, ids[pick].tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tags), flat(sets)], ["tag", "hashes"])

        found = self.rows.mapInArrow(make, "tag bigint, hashes array<bigint>").join(wanted.drop("rep"), "tag")
        new = self.cut(found.groupBy("cid").agg(F.first("hashes").alias("hashes")), "sets")
        return new if known is None else known.union(new)

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that link, their overlaps completed from whole sets, as edges."""
        sets = sets.join(self.ends(pairs), "cid", "left_semi")
        mine, other = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
        overlap = F.size(F.array_intersect("ha", "hb"))
        both = pairs.join(mine, "a").join(other, "b")
        linked = both.where(overlap * (self.num + self.den) >= (F.col("na") + F.col("nb")) * self.num)
        return linked.select(F.col("a").alias("u"), F.col("b").alias("v"))

    def roots(self, classes: DataFrame) -> DataFrame:
        """``node, root`` for every row that links to another."""
        often = self.columns(classes)
        some = self.shared_entries(classes, often)
        k = F.col("k")
        sums = often.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("entries"), F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0)).alias("pairs")).first()
        few = self.few(sums["pairs"], sums["entries"])
        postings = None if few else self.postings(some, often)
        edges = tested = roots = sets = None
        # Where hardly a column has more than two rows, a round would only repeat the pairs.
        turn = 0 if not few else max(0, ROUNDS - 1) if sums["pairs"] > sums["entries"] else ROUNDS
        while turn <= ROUNDS:
            entries = self.with_roots(some, roots) if postings is None else self.entries(postings, roots)
            if postings is not None and 0 < turn < ROUNDS and self.few_left(entries):
                few, turn = True, ROUNDS
            if turn == ROUNDS:
                pairs = self.column_pairs(entries) if few else self.all_pairs(entries)
            else:
                pairs = self.star_pairs(entries, turn) if postings is not None else self.first_pairs(some)
            if tested is not None:
                pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
            pairs = self.cut(pairs, "pairs")
            if pairs.isEmpty():
                turn = ROUNDS if turn < ROUNDS else turn + 1
                continue
            turn += 1
            tested = pairs if tested is None else tested.union(pairs)
            rows = self.cut(self.ends(pairs).join(classes.select("cid", "tag", "rep", "sketch"), "cid"), "ends")
            likely = self.likely(pairs, rows)
            sets = self.sets_of(likely, rows, sets)
            if sets is None:  # no pair so far may link
                continue
            found = self.cut(self.links(likely, sets), "links")
            edges = found if edges is None else edges.union(found)
            roots = components(edges)
            self.written.append(roots)
        return self.spark.createDataFrame([], "node bigint, root bigint") if roots is None else roots

    def run(self) -> DataFrame:
        marked = self.marked()
        classes = self.classes(marked)
        roots = self.roots(classes)
        self.clear(marked, classes, roots)
        rooted = self.with_roots(classes.select("cid", "key", "rep"), roots)
        least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        names = rooted.join(least, "root").select("key", "component_id")
        joined = marked.select("doc_id", F.col("n").alias("n_shingles"), "key").join(names, "key", "left")
        return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def product(left: pa.Table, right: pa.Table, num: int, den: int) -> pa.Table:
    """One block: overlaps of each left row with all right rows, and the pairs that their bound leaves."""
    if not left.num_rows or not right.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "na", "b", "nb")})
    ls, lc, rs, rc = (t[c].to_numpy() for t in (left, right) for c in ("s", "cid"))
    names, first, which = np.unique(rc, return_index=True, return_inverse=True)
    n, root = right["n"].to_numpy()[first], right["root"].to_numpy()[first]
    order = np.argsort(rs, kind="stable")
    columns, which = rs[order], which[order]
    begin, end = np.searchsorted(columns, ls, "left"), np.searchsorted(columns, ls, "right")
    by_row = np.argsort(lc, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(lc[by_row])) + 1, len(lc))
    own_n, own_root, out, at = left["n"].to_numpy(), left["root"].to_numpy(), [], 0
    for stop in ends:
        mine = by_row[at:stop]
        at = stop
        a, na, ra = lc[mine[0]], own_n[mine[0]], own_root[mine[0]]
        overlap = np.bincount(np.concatenate([which[begin[k] : end[k]] for k in mine]), minlength=len(names))
        small, large = np.minimum(n, na), np.maximum(n, na)
        behind = -(-large * num // den) - 1
        keep = (overlap > 0) & (root != ra) & (small * den >= large * num) & ((overlap + behind) * (num + den) >= (n + na) * num)
        for b in np.flatnonzero(keep):
            x, y = (a, na), (names[b], n[b])
            out.append((*min(x, y), *max(x, y)))
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "na", "b", "nb"), columns, strict=True)})


def ordered() -> list[Column]:
    """The pair with its lesser row first."""
    swap = F.col("a") > F.col("b")
    return [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))]


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``, the least id it is linked to over any number of links.

    Two documents link when ``den`` times the size of the intersection is at least ``num`` times that of the union.
    """
    return Join(docs, n, num, den).run()


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, the one of least id, with all columns. Documents without an id all stay."""
    join = Join(docs, n, num, den)
    per_id = join.run().groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("__stays"), F.count("*").alias("__rows"))
    # Only ids that go, and the few that more rows have, are joined: the texts of all others stay where they are.
    others = per_id.where("doc_id IS NOT NULL AND (NOT __stays OR __rows > 1)").select(F.col("doc_id").alias("__kept"), "__stays")
    others = cut(others, "kept")
    join.clear()
    named, same = docs.where(F.col("doc_id").isNotNull()), F.col("doc_id") == F.col("__kept")
    kept = named.join(others, same, "left_anti").unionByName(docs.where(F.col("doc_id").isNull()))
    repeated = others.where("__stays")
    return kept if repeated.isEmpty() else kept.unionByName(named.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
