"""From raw documents to a training mixture, in five stages.

Language identification rejects texts in no learned language, the n-gram join
keeps one document of each group of near copies, repeated passages are cut from
the later documents, documents that hold a benchmark item go, and the rest is
mixed to target weights.  Each stage is a function of (spark, docs, sf_dir); its
result is written and read again as the next one's documents.  Extra columns of
any name stay as they are; only the mix puts its own in place of equal names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm._tables import materialize, row_key, table, unused
from cohortflow.llm.decontam import drop_contaminated
from cohortflow.llm.langid import identify
from cohortflow.llm.linededup import drop_repeats
from cohortflow.llm.mixing import mix_sources
from cohortflow.llm.ngramjoin import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language models accept."""
    key = unused(docs, "_keep")
    keep = identify(docs).filter("accepted").select(F.col("row_key").alias(key)).distinct()
    return docs.join(keep, row_key(docs["doc_id"], docs["text"]) == F.col(key), "left_semi").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 0.8 or more of their five-word shingles in common."""
    return drop_near_duplicates(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; ``n_chars`` follows the text."""
    out = drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their sizes, targets and copies; these stand in for a document's columns of the same names."""
    added = ["size", "source_size", "target", "taken", "copies"]
    own = docs.drop(*[n for n in docs.columns if n.lower() in added and n not in ("doc_id", "text", "source")])
    key = unused(own, "_plan")
    # rows alike in id and text are taken alike, so one plan row a key serves all of them
    plan = mix_sources(own).filter("taken > 0").drop("doc_id").dropDuplicates(["row_key"]).withColumnRenamed("row_key", key)
    return own.join(plan, row_key(own["doc_id"], own["text"]) == F.col(key)).select(*own.columns, *added)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

ORACLE_SQL = None  # character models, hashing of units and WAND have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
