"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lowered, runs of anything but letters become one space, and every n-gram of 1 to 3 characters is hashed
to one of ``buckets``. Training counts all texts with a label; the matrix of log probabilities (buckets x languages)
is broadcast, and a batch is scored by sparse row gathers and segment sums in numpy.

``most_languages`` bounds what is broadcast; more languages than that are an error. Texts without a letter, null
included, are ``und`` with score 0, as are all if nothing was learned. Equal scores go to the first language in
alphabetical order. Repeated rows count each; other columns are neither used nor kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Batches, texts_of

UNKNOWN = "und"
ORDERS = (1, 2, 3)
STEP = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text of each, and whether a text has letters."""
    joined = "\0".join(t.lower().replace("\0", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.diff(np.flatnonzero(np.concatenate([[True], codes == 0, [True]])))
    bound = codes == 0
    letter = letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(codes)] if len(codes) else np.zeros(0, np.int64)
    # One space stands for a run of others; the bounds of texts are kept as spaces.
    keep = letter | bound | np.concatenate([[True], letter[:-1]]) if len(codes) else np.zeros(0, bool)
    codes, text, letter = codes[keep], text[keep], letter[keep]
    has = np.zeros(len(texts), bool)
    has[text[letter]] = True
    found, owner = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = text[: len(h)] == text[n - 1 :]
        found.append((h >> np.uint64(40)).astype(np.int64)[inside] % buckets)
        owner.append(text[: len(h)][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(owner), has


def pieces(texts: list[str], step: int = STEP) -> list[tuple[int, int]]:
    """Ranges of texts of together about ``step`` characters, so a batch of long texts needs no more memory."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= step:
            out.append((begin, k + 1))
            begin, size = k + 1, 0
    return [*out, (begin, len(texts))] if begin < len(texts) else out


class Model:
    """Languages in order and the matrix of log probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float):
        self.languages = languages
        smooth = counts + alpha
        self.matrix = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        self.prior = np.log((docs + 1) / (docs + 1).sum())

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return found, scores
        for begin, end in pieces(texts):
            bucket, owner, has = grams(texts[begin:end], len(self.matrix))
            total = np.empty((end - begin, len(self.languages)))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(owner, weights=self.matrix[bucket, k], minlength=end - begin) + self.prior[k]
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k in np.flatnonzero(has):
                found[begin + k] = self.languages[best[k]]
                scores[begin + k] = share[k]
        return found, scores


def fit(labelled: DataFrame, buckets: int = 1 << 14, alpha: float = 0.1, most_languages: int = 1000) -> Model:
    """Learn from all rows of ``text, lang`` with a label. Each task sends one row per language and bucket it has seen."""

    def count(batches: Batches) -> Batches:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for begin, end in pieces(texts):
                bucket, owner, _ = grams(texts[begin:end], buckets)
                names, which = np.unique(np.array(langs[begin:end], object), return_inverse=True)
                sums = np.bincount(which[owner] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                docs = np.bincount(which, minlength=len(names))
                for k, name in enumerate(names):
                    own = totals.setdefault(name, np.zeros(buckets + 1, np.int64))
                    own[:buckets] += sums[k]
                    own[buckets] += docs[k]
        for name, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most (buckets + 1) rows per language come to the driver.
    rows = sums.toArrow()
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    if len(languages) > most_languages:
        raise ValueError(f"{len(languages)} languages; the broadcast matrix is bounded to {most_languages}")
    table = np.zeros((len(languages), buckets + 1))
    row = {x: k for k, x in enumerate(languages)}
    table[np.array([row[x] for x in names], np.int64), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, table[:, :buckets], table[:, buckets], alpha)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row ``doc_id, lang_pred, score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Batches) -> Batches:
        for batch in batches:
            langs, scores = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
