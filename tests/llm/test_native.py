"""Operators in DataFrame functions, on tables with nulls, odd texts, repeated rows and other columns."""

import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, quality

TURNS = "conv_id bigint, turn bigint, role string, text string, window string, t string"
ODD = [None, "", "\\### Assistant: </turn> ok", "a\n</turn>\n### user:\nb", "\\", "\\\\n###\\", "####", "</turn></turn>", "x\n", "é 日本 " * 30]


def conversations():
    rows = [(1, k, ("user", "assistant")[k % 2], t, "w", "t") for k, t in enumerate(ODD)]
    rows += [(2, 0, "system", "Be brief.", "w", "t")] + [(2, k, ("user", "assistant")[k % 2], f"turn {k} " + "word " * (k * 7 % 60), "w", "t") for k in range(1, 90)]
    rows += [(3, None, None, None, None, None), (3, 0, "tool:x (context)\n### a", "y", None, None), (3, 0, "assistant", "same", None, None), (3, 0, "assistant", "same", None, None)]
    rows += [(None, 0, "user", "no id", None, None), (4, 0, "assistant", "long " * 3000, None, None), (4, 1, "user", "after", None, None), (4, 2, "system", "late system", None, None)]
    return rows


@pytest.mark.parametrize(("budget", "history"), [(2048, 256), (200, 40), (60, 0)])
def test_windows_read_back_to_the_conversation(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS)
    found = chat.windows(df, budget, history)
    windows = found.orderBy("conv_id", "window").collect()
    read = {}
    for r in chat.read_back(found).orderBy("conv_id", "window").collect():
        turns, targets = read.setdefault(r["conv_id"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        targets += r["targets"]
        assert targets == [x for role, x in turns if role == "assistant"]
    want = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {k: v[0] for k, v in read.items()} == want
    system = df.where("role = 'system' AND turn = 0").select(chat.tokens(F.col("text"))).first()[0]
    for r in windows:
        alone = len(re.findall(r"\n</turn>\n", r["formatted"])) - r["formatted"].count("### (context) ") == 1
        assert alone or r["n_tokens"] <= budget + system
        if r["conv_id"] == 2 and "### system:" not in r["formatted"]:
            assert r["formatted"].startswith("### (context) system:\nBe brief.\n</turn>\n")


def test_history_is_repeated_and_masked(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"say {k} " + "word " * 20, "", "") for k in range(12)]
    found = chat.windows(spark.createDataFrame(rows, TURNS), 120, 40).orderBy("window").collect()
    assert len(found) > 2
    for before, r in zip(found, found[1:], strict=False):
        context = re.findall(r"### \(context\) \w+:\n(say \d+)", r["formatted"])
        assert context and all(c in before["formatted"] for c in context)
    targets = [r["formatted"][s["begin"] : s["end"]].split(" word")[0] for r in found for s in r["loss"]]
    assert targets == [f"say {k}" for k in range(1, 12, 2)]


def test_no_conversations(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], TURNS))).count() == 0


TEXTS = [None, "", "one", " a  b\tc\n\n", "x y z x y z", "a a a a", "l\nl\nl \n \n l", "# $ <b> | & %", "w " * 3000, " ".join(f"k{i}" for i in range(60)), "\x0b\x0c\r\n", "日本 語 é"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen, hit = Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            hit.update((k, k + 1, k + 2))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), failed


def test_counts(spark):
    rows = [(k, t, None, 1) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "en", 1), (None, "no id", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int").repartition(3)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality.verdicts(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is not None:
            assert tuple(r)[1:8] == brute(TEXTS[r["doc_id"]]), r
        assert r["kept"] is not r["base_failed"]  # no label, so nothing but the base rules
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [9]
    empty = docs.limit(0)
    assert quality.verdicts(empty, labels).count() == 0 and quality.keep(empty, labels).count() == 0


def test_the_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 500, 20_000) for k in (0, 1, 5, 12) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint")
    for n, k, got in df.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.0125)).collect():
        p = 1 / 80
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n <= 500 else None
        if want is not None:
            assert got == pytest.approx(want, rel=1e-9)
        assert 0 <= got <= 1 + 1e-9


def test_cutoffs_reject_junk_and_never_more_good_than_allowed(spark):
    good = [(k, " ".join(f"w{(k * 7 + i) % 997}" for i in range(60)), "en") for k in range(1200)]
    junk = [(5000 + k, " ".join(f"w{i}***" for i in range(60)), "en") for k in range(40)]
    small = [(9000 + k, " ".join(f"w{i}***" for i in range(60)), "xx") for k in range(5)]
    docs = spark.createDataFrame([*good, *junk, *small], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(1200)] + [(3, 1), (7, 0), (99_999, 1), (None, 1)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.keep(docs, labels).collect()}
    assert {k for k, *_ in good} <= kept and not kept & {k for k, *_ in junk}
    assert {k for k, *_ in small} <= kept  # too few labels there to certify a cutoff
