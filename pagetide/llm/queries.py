"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import chat, decontaminate, langid, lm, pieces, pii, quality, repair, shared, simhash, suffix, toxicity, urlfilter, whitening
from pagetide.llm.shared import remainder, table
from pagetide.session import stage


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    labels = shared.bounded(stage(labels, "labels"))
    training = docs.filter("NOT held_out").join(labels, F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    scored = toxicity.score(docs, toxicity.fit(training), "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_replaced=True)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, docs.filter(~held_out), ~held_out)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pieces.load()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, known).withColumn("text_hash", F.xxhash64("text")).drop("text")
    decoded = pieces.decode(encoded, known)
    return decoded.select(
        "doc_id", "n_ids", "chunks", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.xxhash64("decoded").eqNullSafe(F.col("text_hash")).alias("round_trip"),
    )


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_replaced", "text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    model = lm.fit(docs.filter("NOT held_out"))
    tokens = model.tokens if model else 0
    return lm.score(docs, model, "doc_id", "held_out").withColumn("train_tokens", F.lit(tokens).cast("long"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(*repair.damaged(table(spark, sf_dir, "conversations")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_simhash_near_dedup, op3_toxicity, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_language_id,
        op7_sentencepiece, op8_pii_surrogates, op9_quality_rules, op10_lm_scoring, op11_conversation_repair, op12_embedding_whitening, op13_url_filters,
    )
}

ORACLE: dict[str, str] = {"op1_chat_formatting": chat.ORACLE, "op9_quality_rules": quality.ORACLE, "op11_conversation_repair": repair.ORACLE, "op13_url_filters": urlfilter.ORACLE}
