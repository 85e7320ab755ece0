"""From raw documents to token ids: five stages, each a Spark job over all rows the one before kept.

Every stage takes and returns the columns of documents (the last one adds the ids); columns beyond them are kept too.
A stage sets the session's Arrow batches to sizes for wide rows, so that little text at a time is outside the heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.llm import decontaminate, langid, pieces, pii, simhash
from pagetide.llm.shared import remainder, table
from pagetide.session import stage


def wide_rows(spark: SparkSession) -> None:
    """Arrow batches of at most 250 rows and 2 MB from now on; results do not depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus; learned from three quarters of them."""
    wide_rows(spark)
    trained = remainder(F.col("doc_id"), 4) != 2
    return langid.with_known_language(docs, docs.filter(trained), trained)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share about 0.8 or more of their five-word shingles."""
    wide_rows(spark)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, short items with one replaced word included."""
    wide_rows(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short_replaced=True)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with its own columns of these names renamed to own_..., and the new names by the old ones."""
    new = {}
    for name in set(names) & set(docs.columns):
        own = f"own_{name}"
        while own in docs.columns:
            own += "_"
        new[name] = own
    return docs.withColumnsRenamed(new), new


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text."""
    wide_rows(spark)
    given, own = aside(docs, "n_replaced")
    replaced = pii.replace(given)
    if "n_chars" in docs.columns:
        new = F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        replaced = replaced.withColumn("n_chars", new.otherwise(F.col("n_chars")))
    return replaced.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; round_trip says that the ids decode to the text again.

    A column of the documents that is named like one that is added here is returned as own_ and its name. The ids are
    written before they are decoded, so that a task has one Python worker at a time; workers stay for the jobs after.
    """
    wide_rows(spark)
    known = pieces.load()
    given, own = aside(docs, "ids", "n_ids", "chunks", "round_trip", "uid", "decoded")
    encoded = stage(pieces.encode(given, known), "ids")
    decoded = pieces.decode(encoded, known)
    out = decoded.withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")
    return out.withColumnsRenamed({own[c]: c for c in ("uid", "decoded") if c in own})


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("sentencepiece", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
