"""Text operators on small tables with nulls, empty and long texts, repeated rows, other columns, and on none."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import common, decontam, html, jaccard, langid, lm, packing, pii, records
from tidewatch.llm.tokens import LONGEST_KEPT, Encoder, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{k % 700}" for k in range(40_000))
TEXTS = [None, "", "One two, three.", "One two, three.", "  spaced \n\n out\t ", LONG, "naïve Ünïcode — “quoted” 日本語", "a" * 30_000, "x\0y<|endoftext|>"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_tokens string, __spans_ string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None, len(t or ""), "s", "n", "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], (None, "No id here.", None, None, 3, "s", "n", "x")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def exact(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "led"), (WORD, "bare"), (BYTE, None)])
def test_words_alone_give_the_ids_of_the_text(path, kind):
    more = ["a  b", " a", "a ", "a \n b", "it's  I'M", "x　y z", "1²½ 12", "ßẞ İI", "é ́", "é.\nÀ", "\x1c a\x1cb"]
    for text in [t or "" for t in TEXTS] + more:
        got = np.frombuffer(encoder(path, kind).ids(text), "<u4").tolist()
        assert got == exact(path)(text), text[:60]


def test_records_read_back(spark, docs, tmp_path):
    folder = str(tmp_path / "records")
    records.write_records(docs, folder, BYTE, 0, 50_257, "led")
    index = records.write_index(spark, folder)
    rows = index.orderBy("start").collect()
    ids = [None, 0, 1, 2, 2, *range(3, len(TEXTS))]
    assert [r["doc_id"] for r in rows] == ids
    start = 0
    for r in rows:
        text = "No id here." if r["doc_id"] is None else TEXTS[r["doc_id"]]
        want = np.array([*exact(BYTE)(text), 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    fetched = records.fetch(spark, folder, index.where("doc_id in (4, 6)")).collect()
    assert {r["doc_id"]: r["ids"] for r in fetched} == {k: [*exact(BYTE)(TEXTS[k]), 0] for k in (4, 6)}


def test_a_damaged_record_is_found():
    data = bytearray(records.frame(7, np.arange(5, dtype="<u4").tobytes(), 4) + b"\n")
    assert records.unframe(memoryview(bytes(data)), 0)[0] == 7
    for k in (0, 9, 15, len(data) - 3):
        broken = data.copy()
        broken[k] ^= 1
        with pytest.raises(Exception):  # noqa: B017 - a length may also point past the end
            records.unframe(memoryview(bytes(broken)), 0)


def test_records_of_no_rows(none):
    assert records.token_records(none, BYTE, 0, 50_257, "led").count() == 0


def test_packing_is_exact_and_gapless(docs):
    size = 512
    rows = packing.pack(docs, WORD, 1, size, "bare").collect()
    lengths = {}
    for r in rows:
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in lengths.values():
        found.sort()
        assert [o for o, _ in found] == [0, *itertools.accumulate(n for _, n in found[:-1])]
        assert sum(n for _, n in found) <= size
    want = []
    for doc_id, text in [*enumerate(TEXTS), (2, TEXTS[2]), (None, "No id here.")]:
        ids = np.array([*exact(WORD)(text), 1], "<u4")
        want += [(doc_id, k, k * size, len(p := ids[k * size : (k + 1) * size]), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // size))]
    key = lambda r: str(tuple(r)[:5])
    assert sorted(map(key, rows)) == sorted(map(key, want))


def test_packing_of_no_rows(none):
    assert packing.pack(none, WORD, 1, 4096, "bare").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_the_plan_covers_every_length_within_reach_of_the_bound(seed):
    random = np.random.default_rng(seed)
    lengths = [np.minimum(random.lognormal(5, 1, 3000).astype(int) + 1, 1024), random.integers(200, 520, 2000), np.full(999, 341), random.integers(1, 1025, 7)][seed]
    counts = np.bincount(lengths, minlength=1025)
    groups, seen = packing.plan(counts, 1024), np.zeros(1025, np.int64)
    for many, content in groups:
        assert sum(k * v for k, v in content.items()) <= 1024
        for k, v in content.items():
            seen[k] += many * v
    assert (seen == counts).all()
    bound = -(-lengths.sum() // 1024)
    used = sum(many for many, _ in groups)
    assert used <= 1.1 * bound + 3
    assert seed != 2 or used == 333


def test_knapsack_is_best():
    random = np.random.default_rng(3)
    for _ in range(20):
        weights = np.sort(random.choice(np.arange(1, 12), 4, replace=False))
        values = random.random(4)
        times = packing.best_knapsack(values, weights, 15)
        best = max(values @ np.array(t) for t in itertools.product(range(16), repeat=4) if weights @ np.array(t) <= 15)
        assert weights @ times <= 15 and values @ times == pytest.approx(best)


def test_languages(spark, docs, none):
    words = {"en": "the of and to in is that", "de": "der die und das ist nicht ein", "fr": "le la et les des est une"}
    random = np.random.default_rng(0)
    rows = [(k, " ".join(random.choice(words[x].split(), 30)), x) for k, x in enumerate(list(words) * 40)]
    model = langid.fit(spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", None)], "doc_id long, text string, lang string"))
    test = [(k, " ".join(random.choice(words[x].split(), 8)), x) for k, x in enumerate(list(words) * 10)]
    found = langid.predict(spark.createDataFrame([(k, t) for k, t, _ in test], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in found] == [x for _, _, x in test] and all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 3"), (4, "é")], "doc_id long, text string"), model).collect()}
    assert [odd[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] != "und"
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_hashed_grams_are_all_there():
    bucket, owner, has = langid.grams(["Ab1c", "", "zz"], 1 << 20)
    # "ab c": 4 + 3 + 2 n-grams; the bound between texts stays inside the first two.
    assert has.tolist() == [True, False, True]
    assert np.bincount(owner, minlength=3)[2] == 2 + 1 and len(bucket) == len(owner)


BENCH = [("a", "One two three four five six seven eight nine ten eleven"), ("b", "naïve ÜNÏCODE"), ("c", None), ("d", "..."), ("a2", "one TWO three")]


def brute_hits(text, items, n):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[k : k + size]:
                    hit.update(range(j, j + size))
                    found.add(name)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_decontamination_in_one_or_many_blocks(spark, none, block_bytes):
    texts = [None, "", "one two, three", BENCH[0][1].upper() + " twelve", "x one two three four five six seven eight nine ten", "Naïve? Ünïcode! naïve ünïcode", "four five"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([*BENCH, BENCH[0]], "item_id string, text string")
    for r in decontam.report(docs, bench, block_bytes=block_bytes).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], BENCH, 10), r
    kept = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 5, 6}
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, "span", block_bytes=block_bytes).collect()}
    assert cut[3] == " twelve" and cut[4] == "x " and cut[6] == "four five" and cut[0] is None
    assert decontam.report(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id string, text string")
    assert {r["n_hit"] for r in decontam.report(docs, empty).collect()} == {0}


def test_personal_data_against_plain_patterns(spark, docs, none):
    text = "a.b@c.de x@y z@@a.b 1.2.3.4.5 300.1.1.1, then 4111 1111 1111 1111 and 4111111111111112 +49 (30) 123-4567 +1 2 DE89370400440532013000 ssn 123-45-6789, or call 555-123-4567"
    found = pii.spans_of(text, 0.8)
    assert [(s["kind"], text[s["begin"] : s["end"]]) for s in found] == [
        ("email", "a.b@c.de"),
        ("ip", "1.2.3.4"),
        ("card", "4111 1111 1111 1111"),
        ("phone", "+49 (30) 123-4567"),
        ("iban", "DE89370400440532013000"),
        ("national_id", "123-45-6789"),
        ("local_phone", "555-123-4567"),
    ]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    random = np.random.default_rng(5)
    for _ in range(400):
        t = "".join(random.choice(list("a1.@-+ 2(9"), 60))
        got = pii.base_spans(t)
        assert [(b, e) for b, k, e in got if k == 0] == [m.span() for m in re.finditer(plain["email"], t)]
        assert [(b, e) for b, k, e in sorted(got) if k == 1] == [m.span() for m in re.finditer(plain["ip"], t) if all(int(p) <= 255 for p in m[0].split("."))]
    for hostile in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "+9" + "(" * 200_000, "AB12 " * 40_000):
        pii.spans_of(hostile, 0.8)
    spans = pii.find(docs)
    assert spans.count() == docs.count() and pii.find(none).count() == 0
    out = pii.redact(spark.createDataFrame([(1, "mail a@b.cc now", 9), (2, None, 0)], "doc_id long, text string, n_chars int"))
    assert out.collect()[0]["text"] == "mail [EMAIL] now" and out.collect()[0]["n_chars"] == 16 and out.collect()[1]["text"] is None
    assert pii.redact(docs).columns == docs.columns


def brute_components(rows, n=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed=0):
    random = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(random.choice(vocabulary, 30))
    rows, k = [], 0
    for base in range(12):
        words = list(random.choice(vocabulary, int(random.integers(6, 120))))
        for _ in range(int(random.integers(1, 14))):
            copy = words.copy()
            for _ in range(int(random.integers(0, 1 + len(words) // 25))):
                copy[int(random.integers(0, len(copy)))] = str(random.choice(vocabulary))
            rows.append((k, (passage + " " if base % 2 else "") + " ".join(copy)))
            k += 1
    for t in (None, "", " \n", "one", "One", "one two", "one two three four five", "a a a a a a a a", "a a a a a"):
        rows.append((k, t))
        k += 1
    return rows


@pytest.mark.parametrize(("seed", "rounds", "few"), [(0, 0, 8), (1, 2, -1), (2, 4, 8)])
def test_groups_are_those_of_all_pairs(spark, seed, rounds, few, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)  # also with no round before all pairs, and with all of them
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", few)
    rows = near_copies(seed)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


@pytest.mark.parametrize(("seed", "more", "few"), [(3, 0, True), (4, 3, True), (5, 1000, True), (6, 3, False)])
def test_few_pairs_come_straight_from_columns(spark, seed, more, few, monkeypatch):
    monkeypatch.setattr(jaccard, "MORE_IN_COMMON", more)
    if not few:
        monkeypatch.setattr(jaccard, "FEW_PAIRS", 0)
        monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", -1)
    monkeypatch.setattr(jaccard.Join, "all_pairs" if few else "column_pairs", None)
    rows = near_copies(seed)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)


def test_a_group_of_copies_is_not_paired_column_by_column(spark, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*words[: 5 * i], f"x{i}", *words[5 * i + 1 :]] if i else words)) for i in range(30)]
    seen, pairs = [], jaccard.Join.column_pairs
    monkeypatch.setattr(jaccard.Join, "column_pairs", lambda self, entries: seen.append(pairs(self, entries).count()) or pairs(self, entries))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows)
    assert sum(seen) < len(rows)


def test_one_of_a_group_is_kept_without_dealing_out_texts(spark):
    rows = [(i, f"{i // 2} " + " ".join(f"w{i // 2}x{k}" for k in range(30))) for i in range(10)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "hashpartitioning(doc_id" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6, 8]
    again = [*rows, rows[0], (0, "other words"), (1, "more of these"), (None, "a b"), (None, "a b"), (None, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(again, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([*[rows[i] for i in (0, 2, 4, 6, 8)], (0, "other words"), (1, rows[1][1]), (1, "more of these"), (None, "a b"), (None, "a b"), (None, None)], key=str)


def test_word_hashes_of_many_texts(monkeypatch):
    long = "x" * 1000
    texts = ["", " ", "a", "A b\tB a", "\ud800 x", "É é    b", f"{long} {long}y {long[1:]}", "a\x1cb c\x85d", "\x0b\x0c\ta", "ab" * 4, "ab" * 4 + "c", "a b c d e a b c d e f", "\x00 \x00\x00"]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode("utf-8", "surrogatepass")).split() for t in texts]
    hashes, ends = jaccard.word_hashes(texts)
    assert ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
    flat = [w for some in words for w in some]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    whole = [h.tolist() for h, _ in jaccard.shingles(texts, 3)]
    assert [len(h) for h in whole] == [len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) if w else 0 for w in words]
    monkeypatch.setattr(jaccard, "TEXT_STEP", 1)  # each text by itself
    assert whole == [h.tolist() for h, _ in jaccard.shingles(texts, 3)]


def test_groups_of_odd_tables(spark, docs, none):
    found = jaccard.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r["component_id"] for r in found}
    assert by_id[2] == by_id[3] == 2 and by_id[0] == 0 and by_id[None] is None
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 4, 5, 6, 7, 8] and kept.where("doc_id is null").count() == 1


def test_the_join_leaves_only_tables_that_are_still_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    rows = near_copies(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda: {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()}
    found = jaccard.near_duplicates(docs)
    assert left() == {"marked", "classes", "edges"}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_components(rows)
    again = tmp_path / "again"
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(again))
    kept = jaccard.keep_one(docs)
    assert {f.name.rsplit("-", 1)[0] for f in again.iterdir()} == {"kept"}
    assert kept.count() == len({c for _, c in brute_components(rows).values()})


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies, as all do.</div><{tag}><h1>Head &amp; line</h1><p>First <b>bold</b>
 text, with stops. And   more.<p>Second&nbsp;one &lt;tag&gt;.<br>Line.</p><p>Ok.</p><ul><li>Item one<li>Item two</ul></{tag}>
<aside><p>Side, bar. Very long text, with stops, and more of it.</p></aside><section class="comments"><p>First! Nice, really.</p></section>
<form><p>Send</p></form><script>if (a < b) { "<p>no</p>" }</script><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst bold text, with stops. And more.\nSecond one <tag>. Line.\nOk.\nItem one\nItem two"
    assert html.main_text(PAGE.replace("{tag}", "article")) == want
    assert html.main_text(PAGE.replace("{tag}", "div")).split("\n")[:4] == want.split("\n")[:4]
    for odd in ("", "<", "<p", "<!--", "<script>", "<p>" * 3000, "<" * 30_000, '<a href="' * 3000, "</p></div>", "<p>only"):
        html.main_text(odd)
    rows = [(1, "u", None), (2, None, "<p>Text, here.</p>"), (2, None, "<p>Text, here.</p>")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in out] == [("", 0), ("Text, here.", 11), ("Text, here.", 11)]


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_base_scores_are_exact_in_one_or_many_blocks(spark, docs, none, block_words):
    found = lm.score(docs, docs.where("doc_id % 2 = 0"), block_words=block_words).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = [w for i, t in rows if i is not None and i % 2 == 0 for w in words(t)]
    count = {w: train.count(w) for w in set(train)}
    for r in found:
        if r["doc_id"] is None:
            continue
        w = words(TEXTS[r["doc_id"]])
        base = sum(np.log10((count.get(x, 0) + 1) / (len(train) + len(count) + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), len(train))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] <= 0
    assert lm.score(none, none).count() == 0
    assert {r["base_score"] for r in lm.score(docs, none).collect()} == {0.0}


def test_the_filter_never_underestimates(spark):
    random = np.random.default_rng(1)
    h = random.integers(-(1 << 63), (1 << 63) - 1, 3000)
    c = np.maximum(1, random.pareto(1, 3000).astype(int))
    grams = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, c, strict=True)], "h long, c long")
    found = lm.Written(grams, "test-filter").share(0, 1)
    estimate = lm.MIDDLE[found.levels(h.view(np.uint64))]
    level = np.floor(np.log2(c)).astype(int)
    assert (estimate >= 2.0**level).all() and (estimate == np.where(level == 0, 1, 2.0**level * np.sqrt(2))).mean() > 0.97
    other = random.integers(-(1 << 63), (1 << 63) - 1, 3000).view(np.uint64)
    assert (found.levels(other) > 0).mean() < 0.03


def test_every_count_is_used_beyond_one_share(spark, docs, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs, docs).collect()}
    monkeypatch.setattr(lm, "BITS_PER_KEY", 1 << 17)  # few words then need more than ``max_bits``
    shared = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs, docs, max_bits=1 << 27).collect()}
    assert shared == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("max_bits", [1 << 29, 1 << 24])
def test_scores_equal_those_of_exact_counts_by_level(spark, max_bits):
    random = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(80)]
    lines = [" ".join(vocabulary[int(x) % 80] for x in random.pareto(0.7, random.integers(0, 60)) * 5) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm.score(docs, docs.where("doc_id % 3 > 0"), max_bits=max_bits).collect()}
    tokens = [[*t.split(), None] for t in lines]
    train = [(b, w) for k, t in enumerate(tokens) if k % 3 for b, w in zip([None, *t], t, strict=False)]
    single, pair = Counter(w for _, w in train), Counter(train)
    level = lambda c: c if c < 2 else 2 ** (int(c).bit_length() - 1) * np.sqrt(2)
    for k, t in enumerate(tokens):
        total = 0
        for b, w in zip([None, *t], t, strict=False):
            before, both = level(single[b]), level(pair[b, w])
            weight = lm.MIX * before / (before + lm.HALF)
            own = (level(single[w]) + 1) / (len(train) + len(single) + 1)
            total += np.log10(weight * min(1, both / max(before, 1)) + (1 - weight) * own)
        assert found[k] == pytest.approx(total, rel=1e-9)


def test_shares_are_the_whole_filter(spark):
    h = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 2000)
    written = lm.Written(spark.createDataFrame([(int(x), 1 + k % 5) for k, x in enumerate(h)], "h long, c long"), "test-filter")
    level = sum(written.share(k, 7).levels(h.view(np.uint64)) for k in range(7))
    assert (level == written.share(0, 1).levels(h.view(np.uint64))).all() and (level >= 1).all()


def test_the_driver_takes_shares_in_portions_and_keeps_none(spark, monkeypatch):
    h = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, 4000)
    grams = spark.createDataFrame([(int(x), 1 + k % 3) for k, x in enumerate(h)], "h long, c long")
    written = lm.Written(grams.repartition(8, "h"), "test-filter")
    whole, sizes, kind = written.share(0, 1).bits, [], type(grams)
    take = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: sizes.append(take(self).nbytes) or take(self))
    monkeypatch.setattr(lm, "PORTION", 1 << 19, raising=False)
    assert (written.share(0, 1).bits == whole).all()
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
    kept, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: kept.append(send(value)) or kept[-1])
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    assert lm.score(docs, docs).count() == 2
    assert len(kept) == 2 and not any(Path(b._path).exists() for b in kept)


def test_pairs_seen_once_count(spark):
    train = spark.createDataFrame([(1, "alpha beta gamma alpha delta beta")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha")], "doc_id long, text string")
    seen, unseen = (r["score"] for r in lm.score(docs, train).orderBy("doc_id").collect())
    # By hand: tokens 7, words 5; "alpha" begins the text once, "alpha beta" and "beta end" are seen once.
    chance = lambda pair, before, word: (w := lm.MIX * before / (before + lm.HALF)) * pair / before + (1 - w) * (word + 1) / 13
    two = 2 * np.sqrt(2)  # the middle of the level of two and three
    assert seen == pytest.approx(np.log10([chance(1, 1, two), chance(1, two, two), chance(1, two, 1)]).sum(), rel=1e-9)
    assert unseen == pytest.approx(np.log10([chance(0, 1, two), chance(0, two, two), chance(0, two, 1)]).sum(), rel=1e-9)


def test_sketches_bound_what_sets_differ_by_and_spare_pairs_their_whole_sets(spark):
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for size, shared in ((1, 0), (40, 40), (200, 150), (300, 299), (600, 500), (2000, 1000)):
        one, other = pool[:size], pool[size - shared : 2 * size - shared + size // 7]
        differ = len(np.setxor1d(one, other))
        assert 0 <= jaccard.apart(jaccard.sketch_of(one), jaccard.sketch_of(other)) <= differ
        assert jaccard.apart(jaccard.sketch_of(one), jaccard.sketch_of(one)) == 0
    sets = [pool[:400], pool[20:400], pool[150:550]]  # the second links with the first, the third with neither
    rows = spark.createDataFrame([(k, bytearray(jaccard.sketch_of(x))) for k, x in enumerate(sets)], "cid long, sketch binary")
    pairs = spark.createDataFrame([(0, 400, 1, 380), (0, 400, 2, 400), (1, 380, 2, 400)], "a long, na long, b long, nb long")
    join = jaccard.Join(spark.createDataFrame([], "doc_id long, text string"), 5, 80, 100)
    assert [tuple(r) for r in join.likely(pairs, rows).collect()] == [(0, 400, 1, 380)]
    join.clear()


def test_a_pass_over_the_documents_holds_a_portion_of_a_batch_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 700, None, "b" * 700, "", "c" * 5000, "d"])], ["doc_id", "text"])
    parts = list(lm.portions_of(iter([batch, batch.slice(0, 0)]), "text", step=1000))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3], [4, 5]]
    values = np.arange(5, dtype=np.uint64)
    kept = lm.binaries(values, np.array([2, 0, 3]))
    assert [len(x) for x in kept.to_pylist()] == [16, 0, 24]
    assert lm.flat_values(kept.slice(1), np.uint64).tolist() == [2, 3, 4]


def test_main_text_without_content_elements():
    want = "Head & line\nFirst bold text, with stops. And more.\nSecond one <tag>. Line.\nOk.\nItem one\nItem two"
    assert html.main_text(PAGE.replace("{tag}", "div")) == want
    page = """<body><nav><p>Home, of all. And more, of it.</p></nav><div class="post"><h2>Title</h2><p>A long text, with stops. And more of it, so it scores.</p><p>Short.</p>
<blockquote><p>Said</p></blockquote><table><tr><td>Cell<td>Two</table><ol><li>One</ol></div><div class="bottom"><span>Top</span></div></body>"""
    assert html.main_text(page) == "Title\nA long text, with stops. And more of it, so it scores.\nShort.\nSaid\nCell\nTwo\nOne"


def test_main_text_within_noisy_names():
    text = "A long text, with stops. And more of it."
    for marks in ("has-sidebar", "no-sidebar", "single-post comments-open", "page sticky-header", "sidebar"):
        assert html.main_text(f'<body class="{marks}"><div id="page"><article class="post with-comments"><p>{text}</p></article></div></body>') == text
        assert html.main_text(f'<body><div class="{marks}"><nav>Home</nav><article class="post"><p>{text}</p></article></div></body>') == text
    page = """<header>Site</header><article><header class="header"><h1>Head</h1></header><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be, here. And more text.</p>
<figure><figcaption>Caption</figcaption></figure><section class="comment-list"><article class="comment"><p>First, yes.</p></article></section></article>
<div class="sidebar"><p>Side, bar.</p></div><div class="site-footer"><p>Foot, here.</p></div>"""
    assert html.main_text(page) == "Head\nLet x=1 be, here. And more text.\nCaption"
    assert html.main_text(f'<div class="post"><p>{text}</p></div><div class="comments"><article class="comment"><p>First, yes.</p></article></div>') == text


def test_ibans_end_before_what_follows():
    one, two = "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    for text in (f"on {one} 12 March", f"to {two} BIC COBADEFF now", f"{two} {one}", f"AB12 CD34 EF56 GH78 {two}", f"{one}, {two} 5"):
        got = [text[s["begin"] : s["end"]] for s in pii.spans_of(text, 0.8) if s["kind"] == "iban"]
        assert got == sorted((x for x in (one, two) if x in text), key=text.index), text
        assert not any(x in pii.redacted(text, pii.spans_of(text, 0.8)) for x in (one, two))
    assert not pii.spans_of(one + "x", 0.8) and not pii.spans_of("GB82WEST12345698765431 12", 0.8)


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "led"), (WORD, "bare")])
def test_ids_stay_exact_when_words_fall_out_of_the_cache(path, kind):
    random = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "B", "é", "中", "12", "'s", "Ġ", ".", "<|endoftext|>", "​", "foo"]
    texts = ["".join(random.choice(signs, random.integers(0, 30))) for _ in range(2000)] + ["x" * 3000 + " " + "y " * 50, ""]
    encode, want = Encoder(path, kind), exact(path)
    encode.words.most = 50
    for _ in range(2):
        got = encode.many(texts, 400)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want(t) for t in texts]
        assert all(len(w) <= LONGEST_KEPT for w in encode.words)


LONG = "The river rose in the night, and by morning it had reached the mill. Nobody had expected it, but all were ready."
PARAGRAPHS = "".join(f"<p>{k}. {LONG}</p>" for k in range(6))
TEXT = "\n".join(f"{k}. {LONG}" for k in range(6))
LINKS = "".join(f'<div><a href="/{k}">Other story {k}</a></div>' for k in range(12))
LINK_TEXT = "\n".join(f"Other story {k}" for k in range(12))

LAYOUTS = {
    "links after the text in main": (f"<main><h1>Head</h1>{PARAGRAPHS}<div>{LINKS}</div></main>", f"Head\n{TEXT}"),
    "links before the text in main": (f"<main><div>{LINKS}</div>{PARAGRAPHS}</main>", TEXT),
    "links between paragraphs": (f"<main>{PARAGRAPHS}<ul><li><a>See also</a></li></ul><p>{LONG}</p></main>", f"{TEXT}\nSee also\n{LONG}"),
    "a paragraph that is one link": (f'<main>{PARAGRAPHS}<p><a href="/x">All of it is here.</a></p></main>', f"{TEXT}\nAll of it is here."),
    "several articles": (f"<article>{PARAGRAPHS}</article><aside>Ad</aside><article><h2>Two</h2><p>{LONG}</p></article>", f"{TEXT}\nTwo\n{LONG}"),
    "divs only": (f"<div id=top>Home</div><div class=post><h1>Head</h1>{PARAGRAPHS}<ul><li>One</li></ul></div><footer>End</footer>", f"Head\n{TEXT}\nOne"),
    "divs and a list of links": (f"<div class=post>{PARAGRAPHS}</div><div>{LINKS}</div>", TEXT),
    "a table": (f"<article>{PARAGRAPHS}<table><tr><td>A</td><td>1</td></tr></table></article>", f"{TEXT}\nA\n1"),
    "a quotation": (f"<article>{PARAGRAPHS}<blockquote>Said so</blockquote></article>", f"{TEXT}\nSaid so"),
    "a list that ends the text": (f"<article>{PARAGRAPHS}<ul><li>Flour</li><li>Salt</li></ul></article>", f"{TEXT}\nFlour\nSalt"),
    "a related section of text": (f'<article>{PARAGRAPHS}<section class="related"><p>{LONG}</p></section></article>', f"{TEXT}\n{LONG}"),
    "a related section of links": (f'<article>{PARAGRAPHS}<section class="related">{LINKS}</section></article>', TEXT),
    "a banner between paragraphs": (f'<article>{PARAGRAPHS}<p class="banner">Flood of the year</p><p>{LONG}</p></article>', f"{TEXT}\nFlood of the year\n{LONG}"),
    "comments": (f'<article>{PARAGRAPHS}</article><section class="comments"><p>{LONG}</p></section>', TEXT),
    "notices and adverts": (f'<main><div class="notice">{LONG}</div>{PARAGRAPHS}<div class="ad-slot">{LONG}</div></main>', TEXT),
    "links only": (f"<main>{LINKS}</main>", LINK_TEXT),
    "long attributes": (f'<main><p data-x="{"a" * 20_000}> {"a" * 2000}">{LONG}</p></main>', LONG),
    "an unclosed quote": (f'<main><p title="x>{LONG}</p></main>', LONG),
    "a sign in quotes": (f"""<main><p title='a > "b"'>{LONG}</p></main>""", LONG),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts(name):
    page, want = LAYOUTS[name]
    assert html.main_text(f"<html><body><nav>Home</nav>{page}</body></html>") == want


def test_pages_of_unclosed_quotes_are_read_in_linear_time():
    for sign in ('<img "x>" ', "<img 'x", '<img "', "<img '\">"):
        small, large = sign * 10_000 + '"', sign * 40_000 + '"'
        begin = time.process_time()
        html.blocks(small)
        middle = time.process_time()
        html.blocks(large)
        assert time.process_time() - middle < 12 * (middle - begin) + 1


def test_main_text_with_other_columns_and_ties(spark):
    rows = [(1, "u", f"<main><p>{LONG}</p><div>{LONG}</div></main>", "text", 7), (1, "u", None, None, None), (2, None, "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = html.extract(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [(1, "", 0), (1, f"{LONG}\n{LONG}", 2 * len(LONG) + 1), (2, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_words_met_again_after_as_many_others_are_not_encoded_again():
    words, many = Encoder(BYTE, "led").words, 260_000
    for kind in "ab":
        words.fill({f"{kind}{k}" for k in range(0, many, 2)})
        words.fill({f"{kind}{k}" for k in range(1, many, 2)})
    calls, words.encode = [], lambda texts: calls.extend(texts) or []
    assert words.fill({f"a{k}" for k in range(many)}) == [] and not calls


def test_long_words_are_not_kept():
    words, long = Encoder(BYTE, "led").words, "y" * (LONGEST_KEPT + 1)
    assert words.fill({"x", long}) == [long] and set(words) == {"x", long}
    words.forget([long])
    assert set(words) == {"x"}
