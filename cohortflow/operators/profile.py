"""Data-quality profiling and cross-tabulated outcome rates (pure aggregations).

Wide tables are profiled by unpivoting to (column, value) and grouping on
``column`` instead of one ``agg`` with hundreds of distinct/percentile
expressions: the long form gets map-side partial aggregation and scales with
rows x columns without Spark's Expand blow-up for many distinct aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.colref import c
from ..session import scratch_path
from ..sources.schema import is_numeric_type
from .quantiles import exact_quantiles

QUANTILES = [("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)]


def qc_shape(df: DataFrame) -> DataFrame:
    """(metric, value): rows and columns."""
    n_cols = len(df.columns)
    return (df.agg(F.count(F.lit(1)).alias("rows"))
            .select(F.inline(F.array(
                F.struct(F.lit("rows").alias("metric"), c("rows").alias("value")),
                F.struct(F.lit("columns").alias("metric"), F.lit(n_cols).cast("long").alias("value"))))))


def _long_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unpivot the given columns to (column, value string); NULLs are kept."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns
    ])).alias("kv")).select("kv.column", "kv.value")


def qc_columns(df: DataFrame, max_levels: int = 20, approx: bool = False) -> DataFrame:
    """Per column: dtype, inferred_type, missing_rate (round 6), unique_count (non-null).

    Distinct counts run on the unpivoted long form: group by (column, value)
    (partial aggregation dedups map-side) then count per column.  ``approx``
    switches to ``approx_count_distinct`` per column for very wide/large data.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    names = [f.name for f in fields]
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(),
          "numeric" if is_numeric_type(f.dataType) else
          "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other")
         for i, f in enumerate(fields)],
        "pos int, column string, dtype string, kind string")
    total = df.agg(F.count(F.lit(1)).alias("n"),
                   *[F.sum(c(n).isNull().cast("long")).alias(f"m{i}") for i, n in enumerate(names)])
    missing = total.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"),
                 F.when(c("n") > 0, c(f"m{i}") / c("n")).alias("missing_rate")) for i, n in enumerate(names)
    ])).alias("kv")).select("kv.*")
    if approx:
        uniq = df.agg(*[F.approx_count_distinct(c(n)).alias(f"u{i}") for i, n in enumerate(names)]).select(
            F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(f"u{i}").alias("unique_count"))
                                for i, n in enumerate(names)])).alias("kv")).select("kv.*")
    else:
        uniq = (_long_strings(df, names).filter(c("value").isNotNull())
                .distinct()
                .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count")))
    out = (meta.join(missing, "column", "left").join(uniq, "column", "left")
           .select("pos", "column", "dtype",
                   F.when(c("kind") == "numeric", F.lit("numeric"))
                   .when(c("kind") == "date", F.lit("date"))
                   .when(F.coalesce(c("unique_count"), F.lit(0)) <= max_levels, F.lit("categorical"))
                   .otherwise(F.lit("text")).alias("inferred_type"),
                   F.round(c("missing_rate"), 6).alias("missing_rate"),
                   F.coalesce(c("unique_count"), F.lit(0)).cast("long").alias("unique_count")))
    return out.orderBy(F.desc("missing_rate"), "pos").drop("pos")


def qc_numeric_ranges(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                      accuracy: int = 100000) -> DataFrame:
    """Per numeric column: min, p01, p05, p50, p95, p99, max (linear interpolation); all-null columns omitted."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else [
        n for n in df.columns if is_numeric_type(fields[n]) and not isinstance(fields[n], T.BooleanType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, min double, p01 double, p05 double, "
                                                   "p50 double, p95 double, p99 double, max double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), F.nanvl(c(n).cast("double"), F.lit(None).cast("double")).alias("v"))
        for n in cols])).alias("kv")).select("kv.*").filter(c("v").isNotNull())
    qs = [q for _, q in QUANTILES]
    ends = long.groupBy("column").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), *([F.percentile_approx("v", qs, accuracy).alias("quantiles")] if approx else []))
    if not approx:
        ends = ends.join(exact_quantiles(long, ["column"], "v", qs), "column")
    return ends.select("column", F.col("min").cast("double").alias("min"),
                       *[F.get("quantiles", F.lit(i)).cast("double").alias(name) for i, (name, _) in enumerate(QUANTILES)],
                       F.col("max").cast("double").alias("max"))


def qc_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first occurrence over all (or the given) columns; NULLs compare equal."""
    grouped = df.groupBy(*[c(n) for n in (df.columns if columns is None else columns)]).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(F.coalesce(F.sum(c("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _pairs(columns: Sequence[str], prefix: str) -> list[tuple[str, str, str]]:
    bases = sorted({n[len(prefix):].split("__", 1)[0] for n in columns if n.startswith(prefix)})
    out = []
    for b in bases:
        p, s = f"{prefix}{b}__primary", f"{prefix}{b}__secondary"
        if p in columns and s in columns:
            out.append((b, p, s))
    return out


def label_consistency(df: DataFrame, prefix: str = "") -> DataFrame:
    """Per base with both ``base__primary`` and ``base__secondary``: agreement counts on rows valid in both.

    No outcome with both definitions gives an empty table.
    """
    pairs = _pairs(df.columns, prefix)
    if not pairs:
        return df.sparkSession.createDataFrame([], "outcome string, n_total bigint, primary_pos bigint, secondary_pos bigint, both_pos bigint, "
                                               "primary_pos_secondary_neg bigint, secondary_pos_primary_neg bigint, "
                                               "primary_pos_secondary_neg_rate double, secondary_pos_primary_neg_rate double")
    # all outcomes in one pass: (outcome, primary, secondary) cells
    cells = [F.struct(F.lit(base).alias("outcome"), c(p).cast("int").alias("p"), c(s).cast("int").alias("s")) for base, p, s in pairs]
    both = df.select(F.inline(F.array(*cells))).filter("p is not null and s is not null")
    return both.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_total"), F.sum("p").alias("primary_pos"), F.sum("s").alias("secondary_pos"),
        F.count_if((c("p") == 1) & (c("s") == 1)).alias("both_pos"),
        F.count_if((c("p") == 1) & (c("s") == 0)).alias("primary_pos_secondary_neg"),
        F.count_if((c("p") == 0) & (c("s") == 1)).alias("secondary_pos_primary_neg")).withColumns(
        {f"{n}_rate": F.round(c(n) / c("n_total"), 6) for n in ("primary_pos_secondary_neg", "secondary_pos_primary_neg")})


def label_crosstab(df: DataFrame, base: str, prefix: str = "") -> DataFrame:
    """Always-complete 2x2 table (primary, secondary, count, rate) on rows valid in both."""
    p, s = f"{prefix}{base}__primary", f"{prefix}{base}__secondary"
    spark = df.sparkSession
    grid = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "primary int, secondary int")
    counts = (df.filter(c(p).isNotNull() & c(s).isNotNull())
              .groupBy(c(p).cast("int").alias("primary"), c(s).cast("int").alias("secondary"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    cnt = F.coalesce(c("cnt"), F.lit(0)).cast("long")
    # the grid has four rows, so the total is a window over a single tiny partition
    total = F.sum(cnt).over(Window.partitionBy())
    return (F.broadcast(grid).join(counts, ["primary", "secondary"], "left")
            .select("primary", "secondary", cnt.alias("count"), F.round(cnt / total, 6).alias("rate")))


def bin_variable(col: Column, rule: Mapping) -> Column:
    """Right-closed bins on ``[-inf] + bins``; labels truncated or padded with ``bin{i}``.

    Values above the last edge (and NULL/NaN) give NULL.  Numeric rule only;
    any other rule type casts to string.
    """
    if rule.get("type") != "numeric":
        return col.cast("string")
    edges = [float(b) for b in rule["bins"]]
    given = rule.get("labels")
    names = [str(i + 1) if given is None else str(given[i]) if i < len(given) else f"bin{i + 1}" for i in range(len(edges))]
    x = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    out = F.lit(None).cast("string")
    for edge, name in reversed(list(zip(edges, names, strict=True))):  # the lowest edge that holds the value decides
        out = F.when(x <= edge, F.lit(name)).otherwise(out)
    return out


def _unbinned(col: Column, dtype: T.DataType) -> Column:
    """String form of an unbinned grouping variable; missing becomes the level 'nan'."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = F.nanvl(col, F.lit(None).cast("double"))
    return F.coalesce(col.cast("string"), F.lit("nan"))


def orthogonal_table(df: DataFrame, outcome_col: str, variables: Sequence[str],
                     binning: Mapping[str, Mapping] | None = None, min_cell_n: int = 50,
                     pred_col: str | None = None, complete_grid: bool = False) -> DataFrame:
    """Outcome rate per cell of ``variables``: n = non-null outcomes, rate = mean, sparse = n < min_cell_n.

    ``pred_col`` adds the mean predicted probability per cell (adjusted rate)
    in the same aggregation.  ``complete_grid`` emits every combination of
    observed levels, empty cells with n=0 and NULL rate.
    """
    binning = binning or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [(bin_variable(c(v), binning[v]) if v in binning else _unbinned(c(v), types[v])).alias(v)
            for v in variables]
    y = F.nanvl(c(outcome_col).cast("double"), F.lit(None).cast("double"))
    table = df.select(*keys, y.alias("_y"), *([c(pred_col)] if pred_col else [])) \
        .groupBy(*[c(v) for v in variables]).agg(
            F.count("_y").alias("n"), F.avg("_y").alias("rate"),
            *([F.avg(c(pred_col)).alias("pred")] if pred_col else []))
    if complete_grid:
        # the product of the observed levels is the result that was asked for
        levels = None
        for v, key in zip(variables, keys, strict=True):
            own = df.select(key).distinct()
            levels = own if levels is None else levels.join(own, F.lit(True))
        table = _grid_join(levels, table, variables).withColumn("n", F.coalesce(c("n"), F.lit(0)))
    return table.select(*[c(v) for v in variables], c("n").cast("long").alias("n"), "rate",
                        (c("n") < min_cell_n).alias("sparse"), *(["pred"] if pred_col else []))


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _grid_join(levels: DataFrame, table: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Left join the level grid to the observed cells with null-safe key equality."""
    t = table.select(*[c(v).alias(f"_k{i}") for i, v in enumerate(variables)],
                     *[c(n) for n in table.columns if n not in variables])
    cond = None
    for i, v in enumerate(variables):
        e = levels[_q(v)].eqNullSafe(t[f"_k{i}"])
        cond = e if cond is None else cond & e
    joined = levels.join(t, cond, "left")
    return joined.drop(*[f"_k{i}" for i in range(len(variables))])


def _level_grid(cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Every combination of the levels that occur in ``cells``: the rows of a complete grid, unfolded from one row of level lists."""
    grid = cells.agg(*[F.collect_set(F.struct(c(v).alias("level"))).alias(f"_l{i}") for i, v in enumerate(variables)])
    for i in range(len(variables)):
        grid = grid.select(*[f"_e{k}" for k in range(i)], F.explode(f"_l{i}").alias(f"_e{i}"), *[f"_l{k}" for k in range(i + 1, len(variables))])
    return grid.select(*[c(f"_e{i}")["level"].alias(v) for i, v in enumerate(variables)])


def cross_rates(df: DataFrame, outcome_col: str, combos: Sequence[Mapping], binning: Mapping[str, Mapping] | None = None,
                min_cell_n: int = 50) -> DataFrame:
    """All combos in one table: combo, the variables of all of them (NULL where a combo lacks one), n, rate, sparse.

    One pass over ``df`` makes the finest cells; ``GROUPING SETS`` over the cells sums every combo.
    The column ``combo`` tells a level that is NULL (a value above the last bin) from a variable that the combo lacks.
    Combos of the same variables give the same rows under each name.
    """
    binning = binning or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(dict.fromkeys(v for combo in combos for v in combo["variables"]))
    keys = [(bin_variable(c(v), binning[v]) if v in binning else _unbinned(c(v), types[v])).alias(v) for v in names]
    y = F.nanvl(c(outcome_col).cast("double"), F.lit(None).cast("double"))
    cells = df.select(*keys, y.alias("_y")).groupBy(*[c(v) for v in names]).agg(F.count("_y").alias("_n"), F.sum("_y").alias("_pos"))
    # grouping_id has one bit a variable, the first the highest, set where a combo lacks it
    sets = {sum((v not in combo["variables"]) << (len(names) - 1 - i) for i, v in enumerate(names)): combo["variables"] for combo in combos}
    summed = cells.groupingSets([[c(v) for v in variables] for variables in sets.values()], *[c(v) for v in names]).agg(
        F.grouping_id().alias("_set"), F.sum("_n").alias("n"), F.try_divide(F.sum("_pos"), F.sum("_n")).alias("rate"))
    label = F.lit(None).cast("array<string>")
    for key in sets:
        named = [F.lit(combo["name"]) for combo in combos if set(combo["variables"]) == set(sets[key])]
        label = F.when(c("_set") == key, F.array(*named)).otherwise(label)
    return summed.select(F.explode(label).alias("combo"), *[c(v) for v in names], c("n").cast("long").alias("n"), "rate", (c("n") < min_cell_n).alias("sparse"))


def orthogonal_tables(df: DataFrame, outcome_col: str, combos: Sequence[Mapping],
                      binning: Mapping[str, Mapping] | None = None, min_cell_n: int = 50,
                      pred_col: str | None = None, complete_grid: bool = False) -> dict[str, DataFrame]:
    """One table per combo ({"name": ..., "variables": [...]}).

    The finest cells (all variables of all combos) are aggregated once; each
    table sums its cells from there, and complete grids take their levels from there,
    so the input is read once however many combos there are.
    """
    binning = binning or {}
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(dict.fromkeys(v for combo in combos for v in combo["variables"]))
    keys = [(bin_variable(c(v), binning[v]) if v in binning else _unbinned(c(v), types[v])).alias(v) for v in names]
    y = F.nanvl(c(outcome_col).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, y.alias("_y"), *([c(pred_col).alias("_p")] if pred_col else []))
    sums = [F.count("_y").alias("_n"), F.sum("_y").alias("_pos")]
    sums += [F.count("_p").alias("_np"), F.sum("_p").alias("_sp")] if pred_col else []
    path = scratch_path(df.sparkSession, "cells")
    rows.groupBy(*[c(v) for v in names]).agg(*sums).write.parquet(path)
    cells = df.sparkSession.read.parquet(path)
    out = {}
    for combo in combos:
        aggs = [F.sum("_n").alias("n"), F.try_divide(F.sum("_pos"), F.sum("_n")).alias("rate")]
        aggs += [F.try_divide(F.sum("_sp"), F.sum("_np")).alias("pred")] if pred_col else []
        table = cells.groupBy(*[c(v) for v in combo["variables"]]).agg(*aggs)
        if complete_grid:
            grid = _level_grid(cells, combo["variables"])
            table = _grid_join(grid, table, combo["variables"]).withColumn("n", F.coalesce(c("n"), F.lit(0)).cast("long"))
        out[combo["name"]] = table.select(*[c(v) for v in combo["variables"]], "n", "rate", (c("n") < min_cell_n).alias("sparse"), *(["pred"] if pred_col else []))
    return out
