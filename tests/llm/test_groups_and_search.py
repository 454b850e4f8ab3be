"""SimHash groups, spelling variants and ranked search against brute force, on odd tables too."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import queries, ranked, simhash, spelling
from tidewatch.llm.common import portions, table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, word string, key string, n string, bits string, terms string"
LONG = " ".join(f"word{k % 700}" for k in range(30_000))
TEXTS = [None, "", "One two, three.", "One two, three.", "  spaced \n\n out\t ", LONG, LONG + " and more", "naïve Ünïcode — “quoted” 日本語", "a" * 30_000, "x\0y", "a b", "a  B"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "w", "k", "n", "b", "t") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], (None, "No id here, none here.", "w", None, "n", "b", "t")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def plain_components(ids, prints, radius=3):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(zip(ids, prints, strict=True), 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in ids}


def test_portions_end_at_spaces():
    data = b"ab cd  efgh i " * 50
    for step in (1, 3, 10, 10_000):
        assert b"".join(portions(data, step)) == data
        assert [w for p in portions(data, step) for w in p.split()] == data.split()


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_masks_cover_every_difference(radius):
    kinds = range(1, 1 << (radius + 1))
    rng = random.Random(radius)
    for table_ in [0, *kinds, *((v << (radius + 1) | 1) for v in kinds)]:
        inside = simhash.mask(table_, radius)
        free = [b for b in range(64) if not inside >> b & 1]
        for _ in range(60):
            differ = sum(1 << b for b in rng.sample(free, min(radius, len(free))))
            assert any(not simhash.mask(table_ << (radius + 1) | v, radius) & differ for v in kinds)


def test_covering_tables_find_all_links_however_large_the_buckets(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 1 << 63))
    prints = {center}
    while len(prints) < 1500:  # one dense cloud: its buckets are dealt again and again
        x = center
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 500)}
    for x in list(prints)[:100]:
        prints.add(x ^ 7)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = spark.createDataFrame([(b, k) for k, b in enumerate(signed)], "bits bigint, rep bigint")
    want = plain_components(range(len(prints)), prints)
    for most in (256, 2048):
        edges = {(r["u"], r["v"]) for r in simhash.links(rows, 3, most).collect()}
        assert all((prints[u] ^ prints[v]).bit_count() for u, v in edges)
        root = {k: k for k in range(len(prints))}

        def top(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        for u, v in edges:
            a, b = sorted((top(u), top(v)))
            root[b] = a
        assert {k: top(k) for k in root} == want


def test_simhash_query(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    want = plain_components(list(prints), list(prints.values()))
    got = queries.op11_simhash_covering(spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all((r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]]) for r in got)


def test_simhash_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    ids = [k for k in range(len(TEXTS))]
    prints = [plain_fingerprint(t) for t in TEXTS]
    want = plain_components(ids, prints)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["fingerprint"] == f"{plain_fingerprint('No id here, none here.'):016x}"
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert prints[0] == 0 and want[1] == 0  # nothing at all is linked like any other fingerprint
    assert simhash.near_duplicates(none).count() == 0


def plain_words(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    by_part = {}
    for w in words:  # one edit leaves a common deletion
        for k in range(len(w)):
            by_part.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        by_part.setdefault(w, set()).add(w)
    near = {w: {x for p in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))] for x in by_part.get(p, ()) if x != w and one_edit(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def test_spelling_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    want = plain_variants(plain_words(rows))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op12_spelling_variants(spark, SMALL).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_chunks_find_every_edit(spark):
    rng = random.Random(3)
    words = {}
    for size in range(4, 14):
        for _ in range(12):
            base = "".join(rng.choice("abcÿé×") for _ in range(size))
            words[base] = rng.randint(1, 90)
            for k in range(size + 1):
                words[base[:k] + rng.choice("abcÀ") + base[k:]] = rng.randint(1, 90)
                words[base[:k] + rng.choice("xyz") + base[k + 1 :]] = rng.randint(1, 90)
                words[base[:k] + base[k + 1 :]] = rng.randint(1, 90)
    words = {w: n for w, n in words.items() if len(w) >= 4}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}
    assert got == plain_variants(words)


def test_long_chains_of_forms(spark):
    words = [("a" * (5 + k), 1 << k) for k in range(21)]
    got = spelling.variants(spark.createDataFrame(words, "word string, n bigint")).collect()
    assert {r["root"] for r in got} == {"a" * 25} and sum(r["form"] is None for r in got) == 1


@pytest.mark.parametrize("every", [0, 3, 97])
def test_words_of_odd_rows(spark, odd, none, every):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    more = [(7, "straße Straße STRASSE élan Élan ÷×÷×÷ " + "z" * 200 + " " + "ß" * 100) for _ in range(3)]
    frame = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r["word"]: r["n"] for r in spelling.words_of(frame, every).collect()}
    assert got == plain_words(rows + more, every)
    assert spelling.spelling_variants(none).count() == 0


def test_a_full_tally_is_sent_on(spark, monkeypatch):
    tally = spelling.Tally(97, 5)
    texts = [(k, " ".join(f"{'abcdefgh'[j % 8]}{'xyzuvw'[j * k % 6]}longer" for j in range(40))) for k in range(30)]
    total = Counter()
    for k, (doc_id, text) in enumerate(texts):
        tally.add(str(doc_id), text.encode("latin-1").translate(spelling.FOLD).split())
        if k % 4 == 3 or k == len(texts) - 1:
            rows = tally.rows()
            total.update(dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)))
    assert {w: n for w, n in total.items() if n >= 3} == plain_words(texts)


def plain_search(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    count, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for i, bag, n in bags:
            m = 100 - 25 + 25 * n * count // total
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in Counter(terms(text)).items() if bag[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item_id, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_search_of_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "One two"), (1, "One two"), (2, "word1 word2 word2 more"), (3, None), (4, "- ! -"), (5, "absent"), (None, "spaced OUT"), (6, "one " * 5000 + "日本語")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, rank string, score int")
    want = plain_search(docs, items)
    assert found(ranked.search(odd, frame)) == want
    assert found(ranked.search(odd, frame, block_bytes=64)) == want
    assert ranked.search(none, frame).count() == 0 and ranked.search(odd, frame.limit(0)).count() == 0
    assert ranked.search(none, frame).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_and_small_tiles(spark, monkeypatch):
    docs = [(k, f"tie {'pad ' * (k % 3)}word{k % 5}") for k in range(400)]
    items = [(k, f"tie word{k % 7} pad") for k in range(9)]
    want = plain_search(docs, items, 7)
    counts = [Counter(t.encode().split()) for _, t in items]
    number = {t: j for j, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
    df = Counter(t for _, text in docs for t in set(text.encode().split()))
    worth = np.array([math.floor(1000 * math.log((2 * 400 + 2) / (2 * df[t] + 1))) for t in number], np.int64)
    total = sum(len(t.split()) for _, t in docs)
    monkeypatch.setattr(ranked, "TILE_TERMS", 2)
    best = ranked.Best(len(items), 7)
    for at in range(0, 400, 16):
        bags = [Counter(t.encode().split()) for _, t in docs[at : at + 16]]
        entries = np.array([(d, number[t], c, sum(b.values())) for d, b in enumerate(bags) for t, c in b.items() if t in number])
        doc, term, tf, n = entries.T
        impact = 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * 400 // total))
        for first in (0, 4, 8):
            w = ranked.Weights(first, counts[first : first + 4], number, worth)
            best.add(first, ranked.scores(w, doc, len(bags), term, impact), np.arange(at, at + len(bags)))
        if at % 64 == 0:
            best.rows()
    rows = best.rows()
    got = sorted(((int(i), int(d), int(s)) for i, s, d in rows.T), key=str)
    assert got == sorted(((i, d, s) for i, _, d, s in want), key=str)
    assert found(ranked.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), 7)) == want


def test_weights_beyond_the_exact_bound_come_in_portions():
    number, worth = {b"a": 0, b"b": 1}, np.array([20_000, 3], np.int64)
    w = ranked.Weights(0, [Counter({b"a": 3_000_000, b"b": 2}), Counter({b"b": 1})], number, worth)
    total = ranked.scores(w, np.array([0, 0, 1]), 2, np.array([0, 1, 1]), np.array([999_983, 7, 11]))
    assert total.tolist() == [[3_000_000 * 20_000 * 999_983 + 42, 66], [21, 33]]
    assert all(d.sum(axis=1).max() * ranked.MOST_IMPACT < ranked.EXACT for _, _, d in w.tiles(np.array([0, 1])))


def test_search_query_returns_whole_lists(spark):
    rows = queries.op13_ranked_search(spark, SMALL)
    assert rows.groupBy("item_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).where("n <> r or n > 20").count() == 0
