"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from .alignment import align_tokenizers
from .convrepair import repair_damaged
from .decontam import contaminated
from .hostrep import host_and_path, judge_urls
from .hostrep import oracle_sql as host_sql
from .langid import identify, in_fold
from .linededup import duplicate_spans
from .lmscore import score_texts
from .mixing import mix_sources
from .ngramjoin import near_duplicates
from .quality import quality_rules
from .secretscan import digest, scan_secrets
from .sitetree import extract_main_text
from .tokencounts import token_counts


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page url; a page's outcome is its document's label (good: of quality 1 and not toxic).

    The document's number is the first run of digits in the url's path, whole; one beyond a long names no document.
    """
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], "([0-9]+)", 1)
    numbered = pages.select("url", number.try_cast("long").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("url", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    out = judge_urls(pages, outcomes)
    return out.withColumns({c: F.round(c, 6) for c in ("good_rate", "upper")})


OP1_OUTCOMES = """
  select url, (quality = 1 and toxic = 0) as good from (
    select url, try_cast(nullif(regexp_extract(regexp_extract(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end,
      '^[^/?#]*([^?#]*)', 1), '([0-9]+)', 1), '') as bigint) as doc_id from pages) p join labels l on p.doc_id = l.doc_id"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, held_out=in_fold(F.col("doc_id"), 3, 1))
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits", "accepted")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out=in_fold(F.col("doc_id"), 7, 2))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed span: doc_id, start and end (code points of the original text), kept_doc_id."""
    from ._tables import row_key

    docs = table(spark, sf_dir, "documents")
    hits = duplicate_spans(docs).select("row_key", F.explode("spans").alias("s"))
    ids = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"))
    return ids.join(hits, "row_key").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                                            F.col("s.n_words").alias("n_words"), F.col("s.n_units").alias("n_units"), F.col("s.kept_doc_id").alias("kept_doc_id"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_secret_scan": op11_secret_scan,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_repair_conversations": op13_repair_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": host_sql(OP1_OUTCOMES),
}
