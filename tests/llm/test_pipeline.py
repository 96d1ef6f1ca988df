"""The pipeline's stages on a small corpus with planted cases, and its contract."""

import random
import zlib

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from cohortflow.llm._tables import materialize


def corpus(spark, sf_dir):
    rng = random.Random(8)
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in base.collect()}
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    vocab = [w for r in rows.values() if r["lang"] == "en" for w in r["text"].split()][:4000]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    passage = ". ".join(prose(12).capitalize() for _ in range(6)) + "."
    clean = prose(300)
    near = clean.split()
    near[150] = "changed"
    planted = [(50_000, clean, "en"), (50_001, clean, "en"), (50_002, " ".join(near), "en"), (50_003, prose(60) + " " + item + " " + prose(60), "en"),
               (50_004, prose(80) + " " + passage + " " + prose(80), "en"), (50_005, prose(80) + " " + passage + " " + prose(80), "en"),
               (50_006, " ".join("".join(rng.choice("qzxjvkw") for _ in range(6)) for _ in range(80)), None), (50_007, prose(200), "en"), (None, None, None)]
    extra = spark.createDataFrame([(i, x, lang, "planted", len(x) if x else None) for i, x, lang in planted], base.schema)
    return base.unionByName(extra), passage


def test_stages(spark, sf_dir):
    docs, passage = corpus(spark, sf_dir)
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(seen[name]) <= before
        assert docs.columns[: len(columns)] == columns and (k == len(pipeline.STAGES) - 1 or docs.columns == columns)
    assert None not in seen["language_id"] and 50_006 not in seen["language_id"] and 50_007 in seen["language_id"]
    assert {50_000, 50_001, 50_002} & set(seen["ngram_jaccard"]) == {50_000}
    text = seen["substring_dedup"]
    assert passage in text[50_004] and passage[40:-40] not in text[50_005] and text[50_007] == seen["ngram_jaccard"][50_007]
    assert 50_003 not in seen["decontaminate"] and {50_004, 50_007} <= set(seen["decontaminate"])
    mix = docs.collect()
    assert all(r["taken"] == r["copies"] * r["size"] > 0 for r in mix)


def test_clashing_columns_stay_as_they_are(spark, sf_dir):
    """Extra columns with names that the stages use inside, text ids too."""
    extra = ["size", "_plan", "_keep", "_key", "_cut_key", "_cut_spans", "_hit", "_copies", "_n", "row_key", "spans", "taken"]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    docs = base.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), *[c for c in base.columns if c != "doc_id"],
                       *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in extra])
    for name, stage in pipeline.STAGES:
        before = docs.count()
        docs = materialize(stage(spark, docs, sf_dir), name)
        mine = [n for n in extra if name != "mix" or n not in ("size", "taken")]
        assert 0 < docs.count() <= before
        assert docs.filter(" or ".join(f"`{n}` <> concat('{n}-', substring(doc_id, 2))" for n in mine)).count() == 0
        assert all(n in docs.columns for n in extra)


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    assert "op1_url_filter" in entry.oracle_sql()


def test_near_copies_by_five_words(spark, sf_dir):
    """A pair of five-word Jaccard 0.81 and four-word Jaccard 0.84 is one group for the stage."""
    words = [f"w{k}" for k in range(300)]
    near = list(words)
    for k in (20, 60, 100, 140, 180, 220, 221):
        near[k] = f"x{k}"

    def jaccard(n):
        a, b = ({tuple(x[k: k + n]) for k in range(len(x) - n + 1)} for x in (words, near))
        return len(a & b) / len(a | b)
    assert 0.8 <= jaccard(5) < 0.85 and jaccard(4) < 0.85
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"y{k}" for k in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.ngram_jaccard(spark, docs, sf_dir).collect()} == {1, 3}


def test_languages_labelled_in_one_third_only(spark, sf_dir):
    """The stage learns from all labelled documents, also those that op5 holds out."""
    rng = random.Random(6)

    def text(alphabet):
        return " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(60))
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1][:30]
    rows = [(k, text("αβγδεζηθ"), "el") for k in ids] + [(1000 + k, text("abcdefgh"), "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in pipeline.language_id(spark, docs, sf_dir).collect()}
    assert len(kept & set(ids)) >= 28
