"""A corpus pipeline: quality rules, language ID, near-duplicate join, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taufold.llm import decontamination, jaccard, language_id, packing, quality
from taufold.llm.queries import query, reachable, table, vocabulary
from taufold.sources.stage import stage

#: A prediction against a row's own language counts only from this score on.
SURE = 0.15


@reachable
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the token bands of their language."""
    return quality.judge(docs, vocabulary("piece_bpe_32k.model")).filter("kept").select("row.*").select(*docs.columns)


@reachable
def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language; those without a letter or surely of another language than theirs go, missing labels are filled in."""
    samples = language_id.training_text(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, samples)
    wrong = (F.col("row.lang") != F.col("lang_pred")) & (F.col("score") >= SURE)
    kept = found.filter((F.col("lang_pred") != "und") & ~F.coalesce(wrong, F.lit(False)))
    named = F.coalesce("row.lang", "lang_pred").alias("lang")
    return kept.select(*[named if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


@reachable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.drop_near_duplicates(docs).select(*docs.columns)


@reachable
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@reachable
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", identified_language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: The stages call tokenizer libraries, trained models and quantile bands: SQL can't express them.
ORACLE_SQL = None


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs


run = pipeline
