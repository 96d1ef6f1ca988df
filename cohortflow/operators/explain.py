"""Global explanation tables: coefficients, grouped importance, label maps,
tree path contributions and additive-model shape tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colref import c

# Fixed values (must equal the reference's): direction labels of the coefficient table.
DIRECTION_UP = "risk↑"
DIRECTION_DOWN = "risk↓"


def univariate_log_odds(df: DataFrame, y: str, columns: Sequence[str], smoothing: float = 0.5) -> DataFrame:
    """(feature = 'col=level', coef) where coef is the smoothed log odds ratio of the outcome for the
    level against all other rows with a label.  One unpivot + one grouped aggregation."""
    from pyspark.sql import Window

    lab = df.filter(c(y).isNotNull()).select(c(y).cast("double").alias("_y"), *[c(n) for n in columns])
    long = lab.select("_y", F.explode(F.array(*[F.struct(F.lit(n).alias("col"), c(n).cast("string").alias("level"))
                                               for n in columns])).alias("kv")).select("_y", "kv.*")
    # the NULL level stays in the cell table so per-column totals are a window over cells (no join)
    cells = long.groupBy("col", "level").agg(F.sum("_y").alias("a"), F.sum(1.0 - c("_y")).alias("b"))
    w = Window.partitionBy("col")
    j = cells.select("*", F.sum("a").over(w).alias("P"), F.sum("b").over(w).alias("N")) \
        .filter(c("level").isNotNull())
    s = F.lit(float(smoothing))
    coef = F.ln((c("a") + s) * (c("N") - c("b") + s) / ((c("b") + s) * (c("P") - c("a") + s)))
    return j.select(F.concat(c("col"), F.lit("="), c("level")).alias("feature"), coef.alias("coef"))


def _split_source(feature):
    return F.when(F.instr(feature, "=") > 0, F.substring_index(feature, "=", 1)).otherwise(feature)


def apply_label_map(coefs: DataFrame, label_map: Mapping[str, str] | DataFrame | None,
                    feature_col: str = "feature") -> DataFrame:
    """Add feature_label / source_label: the source part is renamed, ``=level`` is kept (split on first '=')."""
    src = _split_source(c(feature_col))
    out = coefs.withColumn("source_feature", src)
    if label_map is None:
        return out.withColumn("feature_label", c(feature_col)).withColumn("source_label", c("source_feature"))
    if isinstance(label_map, DataFrame):
        cols = label_map.columns
        a, b = (("from", "to") if "from" in cols else ("feature", "short") if "short" in cols else ("feature", "label"))
        m = label_map.select(c(a).alias("_src"), c(b).alias("_lab"))
    else:
        m = coefs.sparkSession.createDataFrame(list(label_map.items()), "_src string, _lab string")
    j = out.join(m, out["source_feature"] == m["_src"], "left")
    level = F.when(F.instr(c(feature_col), "=") > 0,
                   F.substr(c(feature_col), F.instr(c(feature_col), "=") + 1))
    src_label = F.coalesce(c("_lab"), c("source_feature"))
    feat_label = F.when(level.isNotNull(), F.concat(src_label, F.lit("="), level)).otherwise(src_label)
    return j.withColumn("feature_label", feat_label).withColumn("source_label", src_label).drop("_src", "_lab")


def coefficient_table(coefs: DataFrame, label_map=None) -> DataFrame:
    """feature, coef, abs_coef, odds_ratio, direction, source_feature, feature_label, source_label; |coef| desc."""
    t = coefs.select(c("feature"), c("coef").cast("double").alias("coef")) \
        .withColumn("abs_coef", F.abs("coef")).withColumn("odds_ratio", F.exp("coef")) \
        .withColumn("direction", F.when(c("coef") >= 0, F.lit(DIRECTION_UP)).otherwise(F.lit(DIRECTION_DOWN)))
    t = apply_label_map(t, label_map)
    return t.select("feature", "coef", "abs_coef", "odds_ratio", "direction", "source_feature", "feature_label",
                    "source_label").orderBy(F.desc("abs_coef"), "feature")


def grouped_importance(table: DataFrame, value: str = "abs_coef", out: str = "sum_abs_coef",
                       keys: Sequence[str] = ("source_feature", "source_label")) -> DataFrame:
    """Sum of an importance column over the slots of each source feature, descending."""
    return table.groupBy(*[c(k) for k in keys]).agg(F.sum(value).alias(out)).orderBy(F.desc(out), *keys)


def fitted_coefficients(pipeline_model, cat_cols: Sequence[str], num_cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """(feature, coef) of a fitted preprocessor and logistic model: input of ``coefficient_table``.

    Features are named ``col`` and ``col=level`` (one row per vector slot: model metadata, not data).
    """
    from pyspark.sql import SparkSession

    from .prep import slot_table

    pre, model = pipeline_model.stages[0], pipeline_model.stages[-1]
    coef = model.coefficients.toArray()
    rows = [(name, float(coef[i])) for i, name, _source, _level in slot_table(pre, cat_cols, num_cols, drop_first)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coef double")


# ---------------------------------------------------------------- N4 tree path contributions

def _tree_tables(gbt_model, scratch: str):
    """Node arrays of a fitted GBT model, read back from its own persisted form (bounded: trees x nodes)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    gbt_model.write().overwrite().save(scratch)
    nodes = spark.read.parquet(f"{scratch}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").toPandas()
    # persisted as (treeID, metadata json, weight) tuples
    weights = spark.read.parquet(f"{scratch}/treesMetadata").selectExpr("_1 AS treeID", "_3 AS weights").toPandas()
    wmap = dict(zip(weights["treeID"], weights["weights"]))
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        size = int(g["id"].max()) + 1
        arr = {k: np.full(size, -1, dtype=np.int64) for k in ("left", "right", "feat")}
        pred, thr = np.zeros(size), np.full(size, np.nan)
        is_cat = np.zeros(size, dtype=bool)
        goes_left = np.zeros((size, max([1, *(int(k) for k in g["numCategories"] if k is not None and k > 0)])), dtype=bool)
        ids = g["id"].to_numpy()
        arr["left"][ids], arr["right"][ids] = g["leftChild"].to_numpy(), g["rightChild"].to_numpy()
        arr["feat"][ids] = g["featureIndex"].to_numpy()
        pred[ids] = g["prediction"].to_numpy()
        for i, v, k in zip(ids, g["leftCategoriesOrThreshold"], g["numCategories"]):
            if v is None or not len(v):
                continue
            if k is not None and k > 0:  # categorical split: the listed categories go left
                is_cat[i] = True
                goes_left[i, [int(x) for x in v]] = True
            else:  # continuous split: x <= threshold goes left
                thr[i] = v[0]
        trees.append((float(wmap[tid]), arr["left"], arr["right"], arr["feat"], pred, thr, is_cat, goes_left))
    return trees


def _path_sums(left, right, feat, pred, m: int) -> tuple[np.ndarray, int]:
    """What each node's path adds to every feature (nodes x features), and the length of the longest path."""
    sums, depth = np.zeros((len(left), m)), 0
    below = [(0, 0)] if len(left) else []
    while below:
        node, length = below.pop()
        depth = max(depth, length)
        if left[node] >= 0:
            for child in (int(left[node]), int(right[node])):
                sums[child] = sums[node]
                sums[child, feat[node]] += pred[child] - pred[node]
                below.append((child, length + 1))
    return sums, depth


def _attribute(X: np.ndarray, trees) -> tuple[np.ndarray, np.ndarray]:
    """Vectorised walk: all rows descend one level per step of each tree, then take the sums of the path to their leaf."""
    n, m = X.shape
    contrib, bias = np.zeros((n, m)), np.zeros(n)
    rows = np.arange(n)
    for w, left, right, feat, pred, thr, is_cat, goes_left in trees:
        sums, depth = _path_sums(left, right, feat, pred, m)
        own = np.arange(len(left))
        inner = left >= 0  # a leaf leads to itself
        lower, upper, column = np.where(inner, left, own), np.where(inner, right, own), np.where(inner, feat, 0)
        node = np.zeros(n, dtype=np.int64)
        bias += w * pred[0]
        for _ in range(depth):
            x = X[rows, column[node]]
            go_left = x <= thr[node]
            if is_cat.any():
                known = (x >= 0) & (x < goes_left.shape[1])
                code = np.where(known, x, 0).astype(np.int64)
                go_left = np.where(is_cat[node], goes_left[node, code] & known, go_left)  # a category the split does not know goes right
            node = np.where(go_left, lower[node], upper[node])
        contrib += w * sums[node]
    return contrib, bias


def tree_contributions(gbt_model, vec_df: DataFrame, slot_names: Sequence[str], scratch: str,
                       features_col: str = "features", id_col: str | None = None) -> DataFrame:
    """Per-row path attribution (Saabas) of a Spark GBT margin to each feature slot.

    The fitted trees (bounded: number of trees x nodes) are shipped to the
    tasks; ``mapInPandas`` walks them for a whole Arrow batch at once with
    numpy.  This is path attribution, not Shapley values.  Invariant:
    bias + sum(contributions) = margin.  Output: (id?, slot, contribution)
    long rows including a 'bias' slot.
    """
    from pyspark.ml.functions import vector_to_array

    trees = _tree_tables(gbt_model, scratch)
    names = list(slot_names) + ["bias"]
    arr = vec_df.select(*([c(id_col).alias("_id")] if id_col else []), vector_to_array(c(features_col)).alias("_x"))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.vstack(pdf["_x"].to_numpy())
            contrib, bias = _attribute(X, trees)
            vals = np.hstack([contrib, bias[:, None]])
            out = pd.DataFrame({"slot": np.tile(np.array(names, dtype=object), len(pdf)),
                                "contribution": vals.ravel()})
            if id_col:
                out.insert(0, "_id", np.repeat(pdf["_id"].to_numpy(), len(names)))
            yield out

    schema = (f"_id {dict(arr.dtypes)['_id']}, " if id_col else "") + "slot string, contribution double"
    return arr.mapInPandas(run, schema)


def mean_abs_tree_contribution(gbt_model, vec_df: DataFrame, slots: Sequence[tuple[str, str]], scratch: str,
                               features_col: str = "features") -> DataFrame:
    """(source_feature, mean_abs) over all rows; ``slots`` are (slot name, source column) in vector order.

    Each Arrow batch leaves Python as one partial sum per slot, never as rows x slots.
    """
    from pyspark.ml.functions import vector_to_array

    trees = _tree_tables(gbt_model, scratch)
    names = [s for s, _ in slots]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                contrib, _ = _attribute(np.vstack(pdf["_x"].to_numpy()), trees)
                yield pd.DataFrame({"slot": names, "total": np.abs(contrib).sum(axis=0)[: len(names)], "n": len(pdf)})

    sums = vec_df.select(vector_to_array(c(features_col)).alias("_x")).mapInPandas(run, "slot string, total double, n bigint")
    per = sums.groupBy("slot").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
    source = vec_df.sparkSession.createDataFrame(list(slots), "slot string, source_feature string")
    return per.join(source, "slot").groupBy("source_feature").agg(F.sum("mean_abs").alias("mean_abs")).orderBy(F.desc("mean_abs"), "source_feature")


def mean_abs_contribution(contrib: DataFrame, slot_to_source: DataFrame | None = None) -> DataFrame:
    """Mean |contribution| per slot (bias excluded), descending; grouped by source column when a slot table is given."""
    per = contrib.filter(c("slot") != "bias").groupBy("slot").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    if slot_to_source is None:
        return per.orderBy(F.desc("mean_abs"), "slot")
    return per.join(slot_to_source, "slot", "left").groupBy("source_feature").agg(
        F.sum("mean_abs").alias("mean_abs")).orderBy(F.desc("mean_abs"), "source_feature")


# ---------------------------------------------------------------- N5 additive model shape table

def additive_global(pipeline_model, df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
                    label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Shape and importance tables of a fitted ``glassbox_additive`` pipeline.

    Returns (bins, importance): ``bins`` has feature, feature_type, bin, score
    (the bin's coefficient centred by its weighted mean), n, pos, pos_rate;
    ``importance`` is sum(n * |score|) / sum(n) per feature, descending.  Bin
    counts come from one unpivot + grouped aggregation of the bin indices.
    """
    from pyspark.ml.feature import OneHotEncoderModel

    pre, model = pipeline_model.stages[0], pipeline_model.stages[-1]  # pair terms, if any, come after the main slots
    ohe = next(s for s in pre.stages if isinstance(s, OneHotEncoderModel))
    sizes = [int(x) + 1 for x in ohe.categorySizes]  # dropLast=False, handleInvalid=keep: one extra slot
    inputs = ohe.getInputCols()
    coef = model.coefficients.toArray()
    spark = df.sparkSession
    names = list(num_cols) + list(cat_cols)
    kinds = ["continuous"] * len(num_cols) + ["categorical"] * len(cat_cols)
    rows, off = [], 0
    for i, size in enumerate(sizes):
        for b in range(size):
            rows.append((names[i], kinds[i], b, float(coef[off + b]) if off + b < len(coef) else 0.0))
        off += size
    scores = spark.createDataFrame(rows, "feature string, feature_type string, bin int, raw_score double")
    tr = pre.transform(df)
    long = tr.select(c(label).cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(names[i]).alias("feature"), c(inp).cast("int").alias("bin")) for i, inp in enumerate(inputs)
    ])).alias("kv")).select("_y", "kv.*")
    counts = long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    j = scores.join(counts, ["feature", "bin"], "left").fillna(0, subset=["n", "pos"])
    centre = j.groupBy("feature").agg((F.sum(c("n") * c("raw_score")) / F.sum("n")).alias("_m"))
    bins = j.join(centre, "feature").select(
        "feature", "feature_type", "bin", (c("raw_score") - c("_m")).alias("score"), c("n").cast("long").alias("n"),
        "pos", F.when(c("n") > 0, c("pos") / c("n")).alias("pos_rate"))
    imp = bins.groupBy("feature", "feature_type").agg(
        (F.sum(c("n") * F.abs("score")) / F.sum("n")).alias("importance")).orderBy(F.desc("importance"), "feature")
    return bins, imp


def explain_additive(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str], label: str = "label", max_bins: int = 128,
                     min_freq: float = 0.01, C: float = 1.0, numeric_ratio: float = 0.8, min_unique: int = 20) -> tuple[DataFrame, DataFrame]:
    """Shape and importance tables of an additive model prepared for explanation.

    Unlike in training nothing is imputed: text columns that are mostly numbers are read as
    numbers, missing numbers keep a bin of their own and missing text is the level ``Missing``.
    """
    from pyspark.ml import PipelineModel

    from ..sources.schema import coerce_mostly_numeric
    from .models import build_model, fit_additive

    names = [*num_cols, *cat_cols]
    ready, continuous, categorical = coerce_mostly_numeric(df.select(c(label).cast("double").alias("label"), *[c(n) for n in names]), names, numeric_ratio, min_unique)
    pre = fit_additive(ready, categorical, continuous, max_bins, min_freq, missing="keep")
    vec = pre.transform(ready).select("label", "features")
    model = build_model("glassbox_additive", {"C": C}, float(vec.count()), weight_col=None).fit(vec)
    return additive_global(PipelineModel(stages=[pre, model]), ready, categorical, continuous)
