"""Registered queries for the SQL-checkable operators (rules, profiling, sources, schema).

Each query reads the driver tables through the fixture views and is paired
with a DuckDB SQL twin over the same tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.colref import c
from ..functions.rules import build_outcomes, compile_rule
from ..operators import profile
from ..session import scratch_path
from ..sources import readers, schema
from . import fixtures as fx
from . import sql_fixtures as sq
from .registry import register, round_doubles

# ------------------------------------------------------------------ outcome rules (C1-C13)

RULES = {
    "sbp_dbp": fx.SBP_DBP,
    "threshold": fx.GLUCOSE,
    "lipid": fx.LIPID,
    "hdl_low": {"kind": "hdl_low", "hdl_column": "hdl", "sex_column": "sex", "hdl_male_threshold": 1.04,
                "hdl_female_threshold": 1.3, "sex_male_value": "M", "sex_female_value": "F"},
    "waist_by_sex": fx.WAIST,
    "non_hdl": {"kind": "non_hdl", "tc_column": "tc", "hdl_column": "hdl", "threshold": 4.1},
    "aip": {"kind": "aip", "tg_column": "tg", "hdl_column": "hdl", "threshold": 0.24},
    # the stand-in units make ln(tg*glu/2) small, so the fixture threshold is 1.5
    "tyg": {"kind": "tyg", "tg_column": "tg", "glucose_column": "glucose", "threshold": 1.5},
    "count_positive": fx.OUTCOMES_SPEC["risk_cluster"]["rule"],
    "any_true": {"kind": "any_true", "columns": ["smoke", "tg"], "positive_values": ["smoker", "yes"]},
    "any_of": {"kind": "any_of", "rules": [fx.SBP_DBP, fx.GLUCOSE]},
    "and_not": {"kind": "and_not", "include": fx.SBP_DBP, "exclude_rules": [fx.GLUCOSE, fx.WAIST]},
}

_RULE_SQL = {
    "sbp_dbp": "CASE WHEN sbp IS NULL OR dbp IS NULL THEN NULL WHEN sbp >= 140 OR dbp >= 90 THEN 1.0 ELSE 0.0 END",
    "threshold": "CASE WHEN glucose IS NULL THEN NULL WHEN glucose >= 5.6::DOUBLE THEN 1.0 ELSE 0.0 END",
    "lipid": "r_lipid",
    "hdl_low": ("CASE WHEN hdl IS NULL OR sex IS NULL THEN NULL WHEN (sex = 'M' AND hdl < 1.04::DOUBLE) "
                "OR (sex = 'F' AND hdl < 1.3::DOUBLE) THEN 1.0 ELSE 0.0 END"),
    "waist_by_sex": "r_waist",
    "non_hdl": "CASE WHEN tc IS NULL OR hdl IS NULL THEN NULL WHEN tc - hdl >= 4.1::DOUBLE THEN 1.0 ELSE 0.0 END",
    "aip": ("CASE WHEN tg IS NULL OR hdl IS NULL OR hdl <= 0 THEN NULL "
            "WHEN tg > 0 AND log10(tg / hdl) >= 0.24::DOUBLE THEN 1.0 ELSE 0.0 END"),
    "tyg": ("CASE WHEN tg IS NULL OR glucose IS NULL OR tg <= 0 OR glucose <= 0 THEN NULL "
            "WHEN ln(tg * glucose / 2.0) >= 1.5::DOUBLE THEN 1.0 ELSE 0.0 END"),
    "count_positive": "y_risk_cluster",
    "any_true": ("CASE WHEN smoke IS NULL AND tg IS NULL THEN NULL "
                 "WHEN trim(smoke) IN ('smoker', 'yes') OR tg > 0 THEN 1.0 ELSE 0.0 END"),
    "any_of": "greatest(r_bp, r_glu)",
    "and_not": ("CASE WHEN r_bp IS NULL THEN NULL WHEN r_bp = 1 AND NOT (COALESCE(r_glu, 0) >= 1 OR "
                "COALESCE(r_waist, 0) >= 1) THEN 1.0 ELSE 0.0 END"),
}


def _rule_query(kind: str):
    def q(spark: SparkSession, sf_dir: str):
        df = fx.f_cohort(spark, sf_dir)
        return df.select("row_id", compile_rule(df, RULES[kind]).alias("y"))
    return q


for _kind in RULES:
    register(f"rule_{_kind}", "C", sq.with_(sq.F_OUTCOMES) +
             f"SELECT row_id, ({_RULE_SQL[_kind]})::DOUBLE AS y FROM F_outcomes")(_rule_query(_kind))


DEFINITIONS_SPEC = {
    "htn": {"definitions": {"primary": {"rule": fx.SBP_DBP},
                            "secondary": {"rule": {"kind": "any_of", "rules": [fx.SBP_DBP, fx.GLUCOSE]}}},
            "run_definitions": ["primary", "secondary"]},
    "risk_cluster": fx.OUTCOMES_SPEC["risk_cluster"],
    "central_obesity": fx.OUTCOMES_SPEC["central_obesity"],
}


def outcomes_table(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    return build_outcomes(df, DEFINITIONS_SPEC, keep=["row_id"])


register("build_outcomes", "C13", sq.with_(sq.F_OUTCOMES) + """
SELECT row_id, r_bp AS y_htn__primary, greatest(r_bp, r_glu) AS y_htn__secondary,
       y_risk_cluster, y_central_obesity
FROM F_outcomes""")(outcomes_table)


# ------------------------------------------------------------------ flagship + profiling (D1-D9)

def cohort_with_outcomes(spark: SparkSession, sf_dir: str):
    """The labelled cohort, written once: its rules run in one pass, whatever is computed from it."""
    return build_outcomes(fx.f_cohort(spark, sf_dir), fx.OUTCOMES_SPEC, checkpoint=True)


labelled_cohort = cohort_with_outcomes


def flagship(spark: SparkSession, sf_dir: str):
    """F_orders -> sentinels -> risk_cluster (count_positive of four rules) -> outcome rate per cell."""
    df = cohort_with_outcomes(spark, sf_dir)
    t = profile.orthogonal_table(df, "y_risk_cluster", ["smoke", "urban", "butter"], fx.BUTTER_BINNING,
                                 min_cell_n=50)
    return round_doubles(t)


_BUTTER_SQL = "CASE WHEN butter <= 0 THEN '0-1' WHEN butter <= 1 THEN '>1' WHEN butter <= 999999 THEN 'bin3' END"

register("orthogonal_tables", "D7", sq.with_(sq.F_OUTCOMES) + f"""
SELECT COALESCE(smoke, 'nan') AS smoke, COALESCE(urban, 'nan') AS urban, {_BUTTER_SQL} AS butter,
       count(y_risk_cluster) AS n, round(avg(y_risk_cluster), 6) AS rate, count(y_risk_cluster) < 50 AS sparse
FROM F_outcomes GROUP BY 1, 2, 3""")(flagship)


def orthogonal_complete(spark: SparkSession, sf_dir: str):
    df = cohort_with_outcomes(spark, sf_dir)
    t = profile.orthogonal_table(df, "y_central_obesity", ["smoke", "sex"], min_cell_n=50, complete_grid=True)
    return round_doubles(t)


register("orthogonal_tables_complete_grid", "D7", sq.with_(sq.F_OUTCOMES) + """,
cells AS (SELECT COALESCE(smoke, 'nan') AS smoke, COALESCE(sex, 'nan') AS sex, y_central_obesity AS y FROM F_outcomes),
grid AS (SELECT a.smoke, b.sex FROM (SELECT DISTINCT smoke FROM cells) a, (SELECT DISTINCT sex FROM cells) b),
agg AS (SELECT smoke, sex, count(y) AS n, avg(y) AS rate FROM cells GROUP BY 1, 2)
SELECT g.smoke, g.sex, COALESCE(a.n, 0) AS n, round(a.rate, 6) AS rate, COALESCE(a.n, 0) < 50 AS sparse
FROM grid g LEFT JOIN agg a ON g.smoke = a.smoke AND g.sex = a.sex""")(orthogonal_complete)


CROSS_TABS = [{"name": "smoke_by_butter", "variables": ["smoke", "butter"]}, {"name": "urban", "variables": ["urban"]},
              {"name": "sex_smoke_urban", "variables": ["sex", "smoke", "urban"]}]


def cross_rates(spark: SparkSession, sf_dir: str):
    """Three cross-tabs from one cell table."""
    return round_doubles(profile.cross_rates(cohort_with_outcomes(spark, sf_dir), "y_risk_cluster", CROSS_TABS, fx.BUTTER_BINNING))


def _cross_sql(combo: dict) -> str:
    level = {"smoke": "COALESCE(smoke, 'nan')", "urban": "COALESCE(urban, 'nan')", "sex": "COALESCE(sex, 'nan')", "butter": _BUTTER_SQL}
    cols = ", ".join(f"{level[v] if v in combo['variables'] else 'CAST(NULL AS VARCHAR)'} AS {v}" for v in ("smoke", "butter", "urban", "sex"))
    return f"""
SELECT '{combo["name"]}' AS combo, {cols}, count(y_risk_cluster) AS n, round(avg(y_risk_cluster), 6) AS rate,
       count(y_risk_cluster) < 50 AS sparse FROM F_outcomes GROUP BY 2, 3, 4, 5"""


register("cross_rates", "D7", sq.with_(sq.F_OUTCOMES) + "\nUNION ALL".join(_cross_sql(x) for x in CROSS_TABS))(cross_rates)


def complete_grids(spark: SparkSession, sf_dir: str):
    """Two complete grids of one outcome, their cells read once."""
    combos = [{"name": "smoke_butter", "variables": ["smoke", "butter"]}, {"name": "sex_urban", "variables": ["sex", "urban"]}]
    tables = profile.orthogonal_tables(cohort_with_outcomes(spark, sf_dir), "y_risk_cluster", combos, fx.BUTTER_BINNING, complete_grid=True)
    first, second = (tables[x["name"]].toDF("a", "b", "n", "rate", "sparse").withColumn("combo", F.lit(x["name"])) for x in combos)
    return round_doubles(first.unionByName(second))


register("complete_grids", "D7", sq.with_(sq.F_OUTCOMES) + f""",
cells AS (SELECT COALESCE(smoke, 'nan') AS smoke, {_BUTTER_SQL} AS butter, COALESCE(sex, 'nan') AS sex, COALESCE(urban, 'nan') AS urban, y_risk_cluster AS y FROM F_outcomes),
pairs AS (SELECT 'smoke_butter' AS combo, smoke AS a, butter AS b, y FROM cells UNION ALL SELECT 'sex_urban', sex, urban, y FROM cells),
grid AS (SELECT x.combo, x.a, z.b FROM (SELECT DISTINCT combo, a FROM pairs) x JOIN (SELECT DISTINCT combo, b FROM pairs) z ON x.combo = z.combo),
agg AS (SELECT combo, a, b, count(y) AS n, avg(y) AS rate FROM pairs GROUP BY 1, 2, 3)
SELECT g.combo, g.a, g.b, COALESCE(t.n, 0) AS n, round(t.rate, 6) AS rate, COALESCE(t.n, 0) < 50 AS sparse
FROM grid g LEFT JOIN agg t ON g.combo = t.combo AND g.a IS NOT DISTINCT FROM t.a AND g.b IS NOT DISTINCT FROM t.b""")(complete_grids)


def bin_variable_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    rule = {"type": "numeric", "bins": [100000.0, 200000.0, 300000.0], "labels": ["low", "mid"]}
    return df.select("row_id", "spend", profile.bin_variable(c("spend"), rule).alias("spend_bin"))


register("bin_variable", "D8", sq.with_(sq.F_COHORT) + """
SELECT row_id, spend, CASE WHEN spend <= 100000 THEN 'low' WHEN spend <= 200000 THEN 'mid'
                          WHEN spend <= 300000 THEN 'bin3' END AS spend_bin
FROM F_cohort""")(bin_variable_q)


def adjusted_rates(spark: SparkSession, sf_dir: str):
    df = cohort_with_outcomes(spark, sf_dir)
    preds = fx.f_preds(spark, sf_dir, ["hypertension"]).select(c("row_index").alias("row_id"), c("prob"))
    joined = df.join(preds, "row_id", "left")
    t = profile.orthogonal_table(joined, "y_risk_cluster", ["urban", "segment"], min_cell_n=50, pred_col="prob")
    return round_doubles(t)


register("adjusted_rates", "D9", sq.with_(sq.F_OUTCOMES, sq.F_PREDS) + """
SELECT COALESCE(o.urban, 'nan') AS urban, COALESCE(o.segment, 'nan') AS segment, count(o.y_risk_cluster) AS n,
       round(avg(o.y_risk_cluster), 6) AS rate, count(o.y_risk_cluster) < 50 AS sparse, round(avg(p.prob), 6) AS pred
FROM F_outcomes o LEFT JOIN (SELECT row_index, prob FROM F_preds WHERE outcome = 'hypertension') p
  ON o.row_id = p.row_index
GROUP BY 1, 2""")(adjusted_rates)


def qc_shape_q(spark: SparkSession, sf_dir: str):
    return profile.qc_shape(fx.f_li(spark, sf_dir))


register("qc_shape", "D1", """
SELECT 'rows' AS metric, count(*) AS value FROM lineitem
UNION ALL SELECT 'columns' AS metric, 11::BIGINT AS value""")(qc_shape_q)


def qc_columns_q(spark: SparkSession, sf_dir: str):
    return profile.qc_columns(fx.f_cohort(spark, sf_dir))


def _qc_columns_sql() -> str:
    parts = [f"SELECT 'row_id' AS \"column\", 'bigint' AS dtype, 'numeric' AS inferred_type, "
             f"round(avg((row_id IS NULL)::INT), 6) AS missing_rate, count(DISTINCT row_id) AS unique_count "
             f"FROM F_cohort"]
    for name, t in sq._COHORT_COLS:
        if t == "n":
            parts.append(f"SELECT '{name}', 'double', 'numeric', round(avg(({name} IS NULL)::INT), 6), "
                         f"count(DISTINCT {name}) FROM F_cohort")
        else:
            parts.append(f"SELECT '{name}', 'string', CASE WHEN count(DISTINCT {name}) <= 20 THEN 'categorical' "
                         f"ELSE 'text' END, round(avg(({name} IS NULL)::INT), 6), count(DISTINCT {name}) FROM F_cohort")
    return sq.with_(sq.F_COHORT) + "\nUNION ALL ".join(parts)


register("qc_columns", "D2", _qc_columns_sql())(qc_columns_q)

_LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
               "l_tax"]


def qc_numeric_ranges_q(spark: SparkSession, sf_dir: str):
    return round_doubles(profile.qc_numeric_ranges(fx.f_li(spark, sf_dir)))


register("qc_numeric_ranges", "D3", "\nUNION ALL ".join(
    f"SELECT '{n}' AS \"column\", round(min({n})::DOUBLE, 6) AS min, "
    + ", ".join(f"round(quantile_cont({n}, {q}), 6) AS {nm}" for nm, q in profile.QUANTILES)
    + f", round(max({n})::DOUBLE, 6) AS max FROM lineitem" for n in _LI_NUMERIC))(qc_numeric_ranges_q)


def qc_duplicates_q(spark: SparkSession, sf_dir: str):
    """Over all columns (the key makes every row unique), and over the measurements."""
    df = fx.f_cohort(spark, sf_dir)
    some = ["sbp", "dbp", "glucose", "tg", "tc", "ldl", "hdl", "sex", "waist", "urban", "smoke", "butter"]
    return profile.qc_duplicates(df).withColumn("columns", F.lit("all")).unionByName(
        profile.qc_duplicates(df, some).withColumn("columns", F.lit("measurements")))


register("qc_duplicates", "D4", sq.with_(sq.F_COHORT) + """
SELECT COALESCE(sum(cnt - 1), 0)::BIGINT AS duplicate_rows, 'measurements' AS columns FROM (
  SELECT count(*) AS cnt FROM F_cohort
  GROUP BY sbp, dbp, glucose, tg, tc, ldl, hdl, sex, waist, urban, smoke, butter)
UNION ALL SELECT COALESCE(sum(cnt - 1), 0)::BIGINT, 'all' FROM (SELECT count(*) AS cnt FROM F_cohort GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY row_id, " + ", ".join(n for n, _ in sq._COHORT_COLS)))(qc_duplicates_q)


def label_consistency_q(spark: SparkSession, sf_dir: str):
    return profile.label_consistency(fx.f_labels(spark, sf_dir))


register("label_consistency", "D5", sq.with_(sq.F_LABELS) + """
SELECT 'label' AS outcome, count(*) AS n_total, sum(label__primary::INT)::BIGINT AS primary_pos,
  sum(label__secondary::INT)::BIGINT AS secondary_pos,
  sum((label__primary = 1 AND label__secondary = 1)::INT)::BIGINT AS both_pos,
  sum((label__primary = 1 AND label__secondary = 0)::INT)::BIGINT AS primary_pos_secondary_neg,
  sum((label__primary = 0 AND label__secondary = 1)::INT)::BIGINT AS secondary_pos_primary_neg,
  round(sum((label__primary = 1 AND label__secondary = 0)::INT) / count(*), 6) AS primary_pos_secondary_neg_rate,
  round(sum((label__primary = 0 AND label__secondary = 1)::INT) / count(*), 6) AS secondary_pos_primary_neg_rate
FROM F_labels WHERE label__primary IS NOT NULL AND label__secondary IS NOT NULL""")(label_consistency_q)


def label_crosstab_q(spark: SparkSession, sf_dir: str):
    return profile.label_crosstab(fx.f_labels(spark, sf_dir), "label")


register("label_crosstab", "D6", sq.with_(sq.F_LABELS) + """,
v AS (SELECT label__primary::INT AS p, label__secondary::INT AS s FROM F_labels
      WHERE label__primary IS NOT NULL AND label__secondary IS NOT NULL),
grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(p, s))
SELECT g.p AS "primary", g.s AS secondary, count(v.p) AS count,
       round(count(v.p) / (SELECT count(*) FROM v), 6) AS rate
FROM grid g LEFT JOIN v ON g.p = v.p AND g.s = v.s GROUP BY g.p, g.s""")(label_crosstab_q)


# ------------------------------------------------------------------ sources (A1-A8)

def null_sentinels_q(spark: SparkSession, sf_dir: str):
    return round_doubles(fx.f_cohort(spark, sf_dir))


def _cohort_select(prefix: str = "") -> str:
    cols = ["row_id"] + [n for n, _ in sq._COHORT_COLS]
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" if t == "n" else f"{prefix}{n}"
                     for n, t in [("row_id", "i")] + sq._COHORT_COLS) if cols else ""


register("null_sentinels", "A3", sq.with_(sq.F_COHORT) + f"SELECT {_cohort_select()} FROM F_cohort")(null_sentinels_q)


def read_cohort_parquet(spark: SparkSession, sf_dir: str):
    df = readers.read_cohort(spark, f"{sf_dir.rstrip('/')}/orders.parquet", "parquet", id_cols=["o_orderkey", "o_custkey"])
    return round_doubles(df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


register("read_cohort_parquet", "A2", """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderstatus IN ('', 'NA', 'N/A', 'null', 'NULL', '999', '999.0', '-1', '-1.0') THEN NULL
            ELSE o_orderstatus END AS o_orderstatus,
       round(CASE WHEN o_totalprice IN (999, -1) THEN NULL ELSE o_totalprice END, 6) AS o_totalprice,
       CASE WHEN o_orderpriority IN ('', 'NA', 'N/A', 'null', 'NULL', '999', '999.0', '-1', '-1.0') THEN NULL
            ELSE o_orderpriority END AS o_orderpriority
FROM orders""")(read_cohort_parquet)


def read_cohort_csv(spark: SparkSession, sf_dir: str):
    """Spark writes the raw cohort view as CSV to the shared scratch folder, then reads it back.

    Beside the cohort's columns the file has what inference must not spoil: 19-digit numbers, numbers
    beyond BIGINT, codes such as ``3d``, text ids, and whole numbers among NA tokens.
    """
    path = scratch_path(spark, "cohort-csv")
    k = c("row_id")
    raw = fx.f_orders(spark, sf_dir).withColumns({
        "long_number": (F.lit(1234567890123456000) + k).cast("string"),
        "wide_number": F.concat(F.lit("9"), F.lpad(k.cast("string"), 21, "0")),
        "code": F.concat((k % 9).cast("string"), F.when(k % 2 == 0, "d").otherwise("f")),
        "person": F.concat(F.lit("P"), k.cast("string")),
        "visits": F.when(k % 3 == 0, "#N/A").when(k % 3 == 1, "nan").otherwise((k % 50).cast("string"))})
    raw.write.option("header", "true").csv(path)
    return round_doubles(readers.read_cohort(spark, path, "csv"))


register("read_cohort_csv", "A1", sq.with_(sq.F_COHORT) + f"""
SELECT {_cohort_select()}, 1234567890123456000 + row_id AS long_number, '9' || lpad(row_id::VARCHAR, 21, '0') AS wide_number,
  (row_id % 9)::VARCHAR || CASE WHEN row_id % 2 = 0 THEN 'd' ELSE 'f' END AS code, 'P' || row_id AS person,
  CASE WHEN row_id % 3 = 2 THEN row_id % 50 END::DOUBLE AS visits
FROM F_cohort""")(read_cohort_csv)

ORDERS_MAPPING = [{"from": "o_orderkey", "to": "order_id"}, {"from": "o_totalprice", "to": "price"},
                  {"from": "not_there", "to": "x"}, {"from": "o_orderstatus", "to": "o_orderstatus"}]


def column_mapping_q(spark: SparkSession, sf_dir: str):
    mapping = readers.load_column_mapping(spark, ORDERS_MAPPING)
    df = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return round_doubles(readers.apply_column_mapping(df, mapping))


register("apply_column_mapping", "A4-A5", """
SELECT o_orderkey AS order_id, round(o_totalprice, 6) AS price, o_orderstatus FROM orders""")(column_mapping_q)


def write_and_load_predictions(spark: SparkSession, sf_dir: str):
    """A6 write (partitioned by outcome/featureset/model) then A7 load through partition discovery."""
    path = scratch_path(spark, "preds")
    readers.write_table(fx.f_preds(spark, sf_dir), path, "parquet", ["outcome", "featureset", "model"])
    return round_doubles(readers.load_predictions(spark, path))


register("write_load_predictions", "A6-A7", sq.with_(sq.F_PREDS) + """
SELECT fold, row_index, y_true, round(prob, 6) AS prob, round(prob_calibrated, 6) AS prob_calibrated,
       outcome, featureset, model FROM F_preds""")(write_and_load_predictions)


# ------------------------------------------------------------------ schema helpers (B1-B9)

def normalize_col_q(spark: SparkSession, sf_dir: str):
    """Headers made of the part types, with full-width punctuation, a superscript and dropped marks."""
    p = fx.read(spark, sf_dir, "part")
    header = F.concat(F.lit(" "), c("p_type"), F.lit("（"), c("p_partkey").cast("string"), F.lit("）／²：、·Ａ，x, "))
    return p.select("p_partkey", header.alias("header")).withColumn("normalized", schema.normalize_col_expr(c("header")))


register("normalize_col", "B1", """
SELECT p_partkey, header, lower(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(header,
  '（', '('), '）', ')'), '／', '/'), '－', '-'), '·', ''), '²', '2'), '、', ''), '，', ''), ',', ''), '：', ':'),
  '\\s+', '', 'g')) AS normalized
FROM (SELECT p_partkey, ' ' || p_type || '（' || p_partkey || '）／²：、·Ａ，x, ' AS header FROM part)
""")(normalize_col_q)


def infer_types_q(spark: SparkSession, sf_dir: str):
    return schema.infer_types(fx.f_cohort(spark, sf_dir))


def _infer_types_sql() -> str:
    parts = ["SELECT 'row_id' AS \"column\", 'bigint' AS dtype, 'numeric' AS inferred_type"]
    for name, t in sq._COHORT_COLS:
        if t == "n":
            parts.append(f"SELECT '{name}', 'double', 'numeric'")
        else:
            parts.append(f"SELECT '{name}', 'string', CASE WHEN count(DISTINCT {name}) <= 20 THEN 'categorical' "
                         f"ELSE 'text' END FROM F_cohort")
    return sq.with_(sq.F_COHORT) + "\nUNION ALL ".join(parts)


register("infer_types", "B3", _infer_types_sql())(infer_types_q)


def coerce_mostly_numeric_q(spark: SparkSession, sf_dir: str):
    ev = fx.f_events(spark, sf_dir).withColumn("value_text", c("value").cast("string"))
    out, cont, cat = schema.coerce_mostly_numeric(ev, ["event_type", "props", "value_text"])
    return round_doubles(out.select("event_id", "event_type", "props", "value_text"))


register("coerce_mostly_numeric", "B4", """
SELECT event_id, COALESCE(event_type, 'Missing') AS event_type, COALESCE(props, 'Missing') AS props,
       round(TRY_CAST(value AS DOUBLE), 6) AS value_text
FROM events""")(coerce_mostly_numeric_q)


def ensure_columns_q(spark: SparkSession, sf_dir: str):
    df = fx.f_cohort(spark, sf_dir)
    return round_doubles(schema.ensure_columns(df, ["row_id", "waist", "not_collected"], {"not_collected": "double"}))


register("ensure_columns", "B5", sq.with_(sq.F_COHORT) + """
SELECT row_id, round(waist, 6) AS waist, NULL::DOUBLE AS not_collected FROM F_cohort""")(ensure_columns_q)


def feature_plan_q(spark: SparkSession, sf_dir: str):
    """B2 resolve, B6 split, B7 auto feature set and B8 leakage drop, as a per-column plan joined to
    each column's non-null count (so the plan is checked against the data it describes)."""
    df = fx.f_cohort(spark, sf_dir)
    resolved = schema.resolve_columns(df, [" SBP ", "Waist", "sex", "SMOKE", "urban", "segment", "spend"])
    auto = schema.auto_feature_columns(df, exclude=["butter"], id_column="row_id")
    blocked = schema.leakage_from_rules(fx.WAIST)
    feats = schema.drop_leakage([x for x in auto if x in resolved or x in ("glucose", "tg")], blocked)
    cat, num = schema.split_columns(df, feats)
    rows = [(n, "categorical" if n in cat else "numeric") for n in feats]
    plan = spark.createDataFrame(rows, "column string, role string")
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).isNotNull().alias("nn"))
                                           for n in feats])).alias("kv")).select("kv.*") \
        .groupBy("column").agg(F.sum(c("nn").cast("long")).alias("non_null"))
    return plan.join(counts, "column", "inner")


register("feature_plan", "B2,B6-B8", sq.with_(sq.F_COHORT) + """
SELECT 'sbp' AS "column", 'numeric' AS role, count(sbp) AS non_null FROM F_cohort
UNION ALL SELECT 'glucose', 'numeric', count(glucose) FROM F_cohort
UNION ALL SELECT 'tg', 'numeric', count(tg) FROM F_cohort
UNION ALL SELECT 'urban', 'categorical', count(urban) FROM F_cohort
UNION ALL SELECT 'smoke', 'categorical', count(smoke) FROM F_cohort
UNION ALL SELECT 'spend', 'numeric', count(spend) FROM F_cohort
UNION ALL SELECT 'segment', 'categorical', count(segment) FROM F_cohort""")(feature_plan_q)


def label_rows_q(spark: SparkSession, sf_dir: str):
    df = labelled_cohort(spark, sf_dir)
    return schema.label_rows(df, "y_risk_cluster").select("row_id", "y_risk_cluster")


register("label_rows", "B9", sq.with_(sq.F_OUTCOMES) + """
SELECT row_id, y_risk_cluster::INTEGER AS y_risk_cluster FROM F_outcomes WHERE y_risk_cluster IS NOT NULL
""")(label_rows_q)
