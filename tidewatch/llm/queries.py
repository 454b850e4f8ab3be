"""The operators over their whole tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontam, html, jaccard, langid, lm, oracles, packing, pii, quality, ranked, records, simhash, spelling
from tidewatch.llm.common import id_crc, table

QUERIES: dict = {}
ORACLES: dict = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op5_ngram_jaccard": oracles.JACCARD,
    "op10_quality_rules": oracles.QUALITY,
    "op13_ranked_search": oracles.RANKED,
}


def query(function):
    QUERIES[function.__name__] = function
    return function


def hex_digest(parts) -> F.Column:
    """sha256 in lowercase hex of strings joined by commas."""
    return F.sha2(F.array_join(parts, ","), 256)


@query
def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = records.token_records(table(spark, sf_dir, "documents"), path, end_id=0, vocabulary=50_257, kind="led")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        hex_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def span_texts(spans) -> F.Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE],
        hex_digest(span_texts(base)).alias("base_sha256"),
        F.array_join(span_texts(F.col("spans")), ",").alias("spans"),
    )


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=5, num=80, den=100)


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 7 == 2
    scored = lm.score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says)
    read = chat.read_back(chat.windows(rows.unionByName(more)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    part = F.struct("window", F.size("turns").cast("bigint").alias("n"), F.array_join(lines, "").alias("turns"), F.array_join("targets", "").alias("loss"))
    whole = read.select("conv_id", part.alias("part"), F.length("formatted").cast("bigint").alias("chars")).groupBy("conv_id")
    whole = whole.agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    joined = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    return whole.select(
        "conv_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_turns"),
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, end_id=1, size=4096, kind="bare")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op11_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=3)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"), every=97, least_points=5, least_count=3, times=2)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)
