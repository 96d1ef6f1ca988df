"""Exact grouped quantiles and running totals for groups of any size.

A sketch (``percentile_approx``) proposes values around every wanted rank.  One
grouped count then tells how many rows lie below, at, between and above them;
values are kept apart only inside the brackets of wanted ranks, a share of about
``4 / ACCURACY`` of a group.  Running totals of these cells place every rank.  A
rank whose cell is a single value is certain.  Any other (the sketch missed, or its
bracket holds more than ``LISTED`` rows) is looked for again among the rows of its
cell alone, with a new sketch, until all are certain.  The results equal linear
interpolation over all sorted values; no task holds more than the listed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colref import c
from ..session import scratch_path

ACCURACY = 10_000
EDGES = 128  # of the buckets that running totals work in


LISTED = 1 << 20  # rows of a bracket up to which its values are told apart
SPLIT = 128  # parts in which a later round cuts a cell


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys..., quantiles array<double> in the order of ``qs``); null values are left out, null keys are a group."""
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, accuracy).drop("_all")
    ids = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[c(k).alias(i) for k, i in zip(keys, ids, strict=True)], c(value).cast("double").alias("_v")).filter(c("_v").isNotNull())
    margin = 2.0 / accuracy
    brackets = [(max(0.0, q - margin), min(1.0, q + margin)) for q in qs]
    probs = sorted({p for b in brackets for p in b})
    inside = [any(probs.index(lo) < k <= probs.index(hi) for lo, hi in brackets) for k in range(len(probs) + 1)]  # interval k ends at probs[k]
    # a written table's size is known: its join with the rows needs no shuffle of them where it is small
    sketch = _written(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", probs, accuracy).alias("_edges")), "quantile-sketch")
    told = F.element_at(F.array(*[F.lit(x) for x in inside]), c("_at") + 1) & (c("_n") * (2 * margin) <= LISTED)
    low = [F.floor((c("_n") - 1) * F.lit(float(q))) for q in qs]
    ranks = [r for x in low for r in (x, F.least(x + 1, c("_n") - 1))]
    found = _written(_placed(_cells(rows, sketch, ids, told, len(probs)), ids, ranks), "quantile-ranks")
    settled, last = [found.filter("sure")], found
    while (open_ranks := last.filter("not sure")).limit(1).count():
        # one row per row and open rank: only rows of the open cells
        unit = [*ids, "which"]
        cells = open_ranks.select(*[c(i).alias(f"{i}_") for i in ids], "which", "lo", "hi", c("rank").alias("_rank"))
        mine = rows.join(cells, _same(ids, [f"{i}_" for i in ids]) & (c("_v") >= c("lo")) & (c("_v") <= c("hi"))).select(*unit, "_v", "_rank")
        again = mine.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"), F.first("_rank").alias("_rank"), F.percentile_approx("_v", [i / SPLIT for i in range(SPLIT + 1)], accuracy).alias("_edges"))
        again = _written(again, "quantile-sketch")
        last = _written(_placed(_cells(mine.drop("_rank"), again, unit, c("_n") <= LISTED, SPLIT + 1, ["_rank"]), unit, [c("_rank")]), "quantile-ranks")
        settled.append(last.filter("sure"))
    # the two ranks around each quantile, and the share of the way between them
    by_key = settled[0].select(*ids, "which", "size", "lo")
    for more in settled[1:]:
        sizes = found.select(*[c(i).alias(f"{i}_") for i in ids], c("which").alias("which_"), c("size").alias("whole"))
        by_key = by_key.unionByName(more.join(sizes, _same([*ids, "which"], [*[f"{i}_" for i in ids], "which_"])).select(*ids, "which", c("whole").alias("size"), "lo"))
    values = by_key.groupBy(*ids).agg(F.max("size").alias("_n"), F.map_from_entries(F.collect_list(F.struct("which", "lo"))).alias("_at"))  # two ranks a quantile
    out = []
    for i, q in enumerate(qs):
        x = (c("_n") - 1) * F.lit(float(q))
        a, b = F.element_at("_at", F.lit(2 * i)), F.element_at("_at", F.lit(2 * i + 1))
        out.append(a + (b - a) * (x - F.floor(x)))
    return values.select(*[c(i).alias(k) for i, k in zip(ids, keys, strict=True)], F.array(*out).alias("quantiles"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, [c(x).eqNullSafe(c(y)) for x, y in zip(left, right, strict=True)])


def _cells(rows: DataFrame, sketch: DataFrame, ids: Sequence[str], told: Column, n_edges: int, carry: Sequence[str] = ()) -> DataFrame:
    """(ids, _n, _at, x, rows, lo, hi): rows by the interval between edges they lie in (``_at`` edges are below); a row
    at an edge, and where ``told`` every row, has its own value as ``x``."""
    other = sketch.select(*[c(i).alias(f"{i}_") for i in ids], "_n", "_edges", *carry)
    met = rows.join(other, _same(ids, [f"{i}_" for i in ids])).withColumn("_at", bucket_of(c("_v"), c("_edges"), n_edges))
    x = F.when((F.get("_edges", c("_at")) == c("_v")) | told, c("_v"))
    return met.groupBy(*ids, "_n", *carry, "_at", x.alias("x")).agg(F.count(F.lit(1)).alias("rows"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def _placed(cells: DataFrame, ids: Sequence[str], ranks: Sequence[Column]) -> DataFrame:
    """(ids, which, size, rank, lo, hi, sure): the cell of each rank, the rank inside it, and whether it is one value."""
    upto = F.sum("rows").over(Window.partitionBy(*ids).orderBy("_at", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = [i for i in ids if i != "which"]
    which = (lambda k: c("which")) if "which" in ids else F.lit
    wanted = F.array(*[F.struct(which(k).alias("which"), r.cast("long").alias("rank")) for k, r in enumerate(ranks)])
    below = c("upto") - c("rows")
    hit = F.filter(wanted, lambda w: (w["rank"] >= below) & (w["rank"] < c("upto")))
    long = cells.withColumn("upto", upto).select(*own, c("_n").alias("size"), "lo", "hi", below.alias("below"), F.explode(hit).alias("hit"))
    return long.select(*own, "hit.which", "size", (F.col("hit.rank") - c("below")).alias("rank"), "lo", "hi", (c("lo") == c("hi")).alias("sure"))


def column_quantiles(df: DataFrame, columns: dict[str, Column], qs: Sequence[float], approx: bool = False, accuracy: int = 100_000) -> dict[str, list[float] | None]:
    """Quantiles of several expressions over all rows, on the driver: one short list per column."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(n).alias("column"), x.cast("double").alias("v")) for n, x in columns.items()]
    long = df.select(F.inline(F.array(*cells))).filter("v is not null")
    if approx:
        table = long.groupBy("column").agg(F.percentile_approx("v", list(qs), accuracy).alias("quantiles"))
    else:
        table = exact_quantiles(long, ["column"], "v", qs)
    found = {r["column"]: list(r["quantiles"]) for r in table.collect()}
    return {n: found.get(n) for n in columns}


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value of each column as text, ties to the smallest: counts first, then one row per column."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns]
    counts = df.select(F.inline(F.array(*cells))).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-c("n")).alias("less"), "value")).alias("best"))
    found = {r["column"]: r["best"]["value"] for r in best.collect()}
    return {n: found.get(n) for n in columns}


def bucket_edges(counts: DataFrame, keys: Sequence[str], score: str, edges: int = EDGES) -> DataFrame:
    """(keys..., _edges): scores that cut each group's distinct scores into about ``edges`` equal parts."""
    steps = [i / edges for i in range(1, edges)]
    return counts.groupBy(*[c(k) for k in keys]).agg(F.array_distinct(F.percentile_approx(c(score).cast("double"), steps, ACCURACY)).alias("_edges"))


def bucket_of(score: Column, edges: Column, most: int = 2 * EDGES - 1) -> Column:
    """Number of sorted ``edges`` (``most`` at most) below ``score``: compared one by one if they are few, else by bisection."""
    if most <= 32:
        return reduce(add, [F.when(F.get(edges, F.lit(k)) < score, 1).otherwise(0) for k in range(most)])
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(edges)) & (F.get(edges, at + step - 1) < score), at + step).otherwise(at))
