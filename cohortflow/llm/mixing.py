"""Mix sources to target weights with hash-threshold histograms.

Sizes are summed by (source, hash bucket).  A running total over a source's
buckets finds the bucket in which its budget ends; only that bucket is split by
the next bits of the hash, level by level, until the threshold is a full hash.
Documents are then taken by comparing their hash with their source's threshold:
nothing is sorted, and no row is moved but to meet its source's threshold.

Whole epochs come first: a source whose target is ``e`` times its size plus a
rest takes every document ``e`` times, and the documents below the threshold
once more.

Defined results: a null or empty text has size 0 and takes 0; null is a source
of its own, last in order; rows alike in id and text share a hash, so they are
taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import materialize, row_key

BITS, LEVELS = 12, 4  # 4096 buckets a level; 48 bits of the hash decide


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: int = 3, cap: float = 3.0) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): one row per source with ``target``.

    Weights 1..``weights`` repeat in the code-point order of the sources (null
    last).  All sizes are shared by weight; a source gets at most ``cap`` times
    its size, and the excess is shared by weight among the others.  Sources are
    ranked by the level (target per weight) at which they reach their cap: the
    first ``k`` are capped if the level of the others, (total - caps) / rest of
    the weights, lies above theirs.  The table has one row per source, the
    catalogue of the corpus, and is the only thing ordered as a whole.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(weights)) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    s = s.withColumns({
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "total": F.sum("source_size").over(every).cast("double"),
    })
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # the first source that is not capped sets the level of all that follow
    s = s.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.when(F.col("capped"), F.col("cap")), F.col("final") * F.col("weight"), F.col("cap")).alias("target"))


def _hash_part(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash threshold that holds its budget.

    ``rows``: (source, h, size); ``budgets``: (source, rest double).  Returns
    (source, prefix long): rows whose top ``BITS * LEVELS`` hash bits are
    below ``prefix`` are taken; their sizes sum to ``rest`` or less, or to
    whichever side of the boundary hash value lies nearer to it.
    """
    at = budgets.select(F.col("source").alias("_s"), F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("_s")))
        if level:
            top = F.shiftrightunsigned("h", 64 - BITS * level)
            inside = inside.filter(top == F.col("prefix"))
        hist = inside.groupBy("_s", _hash_part(level).alias("b")).agg(
            F.sum("size").alias("n"), F.first("left").alias("left"), F.first("prefix").alias("prefix"))
        run = W.partitionBy("_s").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
        hist = hist.withColumn("upto", F.sum("n").over(run))
        # the boundary bucket is the first whose running total exceeds what is left
        cut = hist.groupBy("_s").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", "upto", "n"))).alias("cut"),
            F.max("b").alias("last"), F.max("left").alias("left"), F.max("prefix").alias("prefix"))
        base = F.col("prefix") * (1 << BITS)
        if level < LEVELS - 1:
            at = cut.select("_s", (F.col("left") - F.coalesce(F.col("cut.upto") - F.col("cut.n"), F.lit(0))).alias("left"),
                            (base + F.coalesce(F.col("cut.b"), F.col("last"))).alias("prefix"))
        else:
            over = F.col("cut.upto") - F.col("left")  # taking the boundary value too exceeds the budget by this much
            under = F.col("left") - (F.col("cut.upto") - F.col("cut.n"))
            at = cut.select(F.col("_s").alias("source"), (base + F.when(F.col("cut").isNull(), F.col("last") + 1)
                            .when(over < under, F.col("cut.b") + 1).otherwise(F.col("cut.b"))).alias("prefix"))
        at = materialize(at, "mix-threshold")  # one row per source
    return at


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: int = 3, cap: float = 3.0, size: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, row_key.

    ``size`` may replace the word count (say, a token count column of ``docs``).
    ``taken`` is ``copies * size`` with at most ``cap`` copies.  Sizes and
    hashes are computed in one pass over the texts and written as a narrow table.
    """
    n = word_count(F.col(text)) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    key = row_key(doc_id, text)
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.alias("size"),
                                   key.alias("row_key"), F.xxhash64(key, F.lit("mix")).alias("h")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    # whole epochs; all of the cap when the target is the cap
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0)
    plan = targets.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    some = plan.filter((F.col("rest") > 0) & (F.col("whole") < int(cap)))
    at = thresholds(rows.filter("size > 0").select("source", "h", "size"), some.select("source", "rest"))
    at = at.select(F.col("source").alias("_t"), "prefix")
    plan = plan.join(at, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t")
    plan = plan.select(F.col("source").alias("_p"), "source_size", "target", "whole", "prefix")
    extra = F.coalesce((F.shiftrightunsigned("h", 64 - BITS * LEVELS) < F.col("prefix")).cast("long"), F.lit(0))
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_p")))
            .withColumn("copies", F.col("whole") + extra)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "row_key"))
