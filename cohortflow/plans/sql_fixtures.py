"""DuckDB SQL twins of the fixture views (CTE bodies) used by the oracle."""

from __future__ import annotations

F_ORDERS = """
F_orders AS (
  SELECT o.o_orderkey AS row_id,
    CASE WHEN o.o_orderkey % 17 = 0 THEN 999.0 ELSE 100 + (o.o_orderkey * 37) % 83 END::DOUBLE AS sbp,
    CASE WHEN o.o_orderkey % 19 = 0 THEN -1.0 ELSE 60 + (o.o_orderkey * 53) % 47 END::DOUBLE AS dbp,
    CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE (40 + (o.o_orderkey * 29) % 41) / 10 END::DOUBLE AS glucose,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL WHEN o.o_orderkey % 101 = 0 THEN 0.0
         ELSE (5 + (o.o_orderkey * 31) % 37) / 10 END::DOUBLE AS tg,
    ((30 + (o.o_orderkey * 41) % 43) / 10)::DOUBLE AS tc,
    ((10 + (o.o_orderkey * 43) % 39) / 10)::DOUBLE AS ldl,
    CASE WHEN o.o_orderkey % 107 = 0 THEN 0.0 ELSE (6 + (o.o_orderkey * 47) % 15) / 10 END::DOUBLE AS hdl,
    CASE WHEN o.o_orderkey % 20 = 0 THEN NULL WHEN o.o_orderkey % 20 = 1 THEN 'X'
         WHEN o.o_orderkey % 7 < 3 THEN 'M' ELSE 'F' END AS sex,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 65 + (o.o_orderkey * 59) % 46 END::DOUBLE AS waist,
    o.o_orderstatus AS urban,
    o.o_orderpriority AS ethnicity,
    CASE WHEN o.o_orderkey % 211 = 0 THEN 'rare' WHEN o.o_orderkey % 11 = 0 THEN 'NA'
         WHEN (o.o_orderkey * 71) % 5 < 2 THEN 'smoker' ELSE 'never' END AS smoke,
    (((o.o_orderkey * 73) % 4) / 2)::DOUBLE AS butter,
    o.o_totalprice AS spend,
    cu.c_mktsegment AS segment
  FROM orders o LEFT JOIN customer cu ON o.o_custkey = cu.c_custkey
)"""

_NUM_S = "CASE WHEN {c} IN (999, -1) OR isnan({c}) THEN NULL ELSE {c} END AS {c}"
_STR_S = ("CASE WHEN {c} IN ('', 'NA', 'N/A', 'null', 'NULL', '999', '999.0', '-1', '-1.0') "
          "THEN NULL ELSE {c} END AS {c}")

_COHORT_COLS = [("sbp", "n"), ("dbp", "n"), ("glucose", "n"), ("tg", "n"), ("tc", "n"), ("ldl", "n"),
                ("hdl", "n"), ("sex", "s"), ("waist", "n"), ("urban", "s"), ("ethnicity", "s"), ("smoke", "s"),
                ("butter", "n"), ("spend", "n"), ("segment", "s")]

# F_orders after sentinel cleaning of every column but the id.
F_COHORT = F_ORDERS + """,
F_cohort AS (
  SELECT row_id,
    """ + ",\n    ".join((_NUM_S if t == "n" else _STR_S).format(c=x) for x, t in _COHORT_COLS) + """
  FROM F_orders
)"""

# Outcome rules of the flagship spec over F_cohort, one column per rule plus the composites.
F_OUTCOMES = F_COHORT + """,
F_rules AS (
  SELECT *,
    CASE WHEN sbp IS NULL OR dbp IS NULL THEN NULL
         WHEN sbp >= 140 OR dbp >= 90 THEN 1.0 ELSE 0.0 END::DOUBLE AS r_bp,
    CASE WHEN glucose IS NULL THEN NULL WHEN glucose >= 5.6::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS r_glu,
    CASE WHEN tg IS NULL OR tc IS NULL OR ldl IS NULL OR hdl IS NULL OR sex IS NULL THEN NULL
         WHEN tg >= 1.7::DOUBLE OR tc >= 6.2::DOUBLE OR ldl >= 4.1::DOUBLE
              OR (sex = 'M' AND hdl < 1.04::DOUBLE) OR (sex = 'F' AND hdl < 1.3::DOUBLE) THEN 1.0
         ELSE 0.0 END::DOUBLE AS r_lipid,
    CASE WHEN waist IS NULL OR sex IS NULL OR sex NOT IN ('M', 'F') THEN NULL
         WHEN (sex = 'M' AND waist >= 90) OR (sex = 'F' AND waist >= 85) THEN 1.0 ELSE 0.0 END::DOUBLE AS r_waist
  FROM F_cohort
),
F_outcomes AS (
  SELECT *,
    CASE WHEN r_bp IS NULL AND r_glu IS NULL AND r_lipid IS NULL AND r_waist IS NULL THEN NULL
         WHEN (COALESCE(r_bp, 0) >= 1)::INT + (COALESCE(r_glu, 0) >= 1)::INT + (COALESCE(r_lipid, 0) >= 1)::INT
              + (COALESCE(r_waist, 0) >= 1)::INT >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS y_risk_cluster,
    r_waist AS y_central_obesity
  FROM F_rules
)"""


def f_preds_sql(with_alt_model: bool = False) -> str:
    parts = []
    outcomes = [("hypertension", 7919, 104729), ("hyperglycemia", 7907, 104723), ("dyslipidemia", 7901, 104717)]
    alt = {"hypertension": 3571, "hyperglycemia": 3559, "dyslipidemia": 3547}
    for name, a, b in outcomes:
        p = f"((o_orderkey * {a}) % 10007) / 10007"
        y = f"(CASE WHEN ((o_orderkey * {b}) % 1009) / 1009 < {p} THEN 1.0 ELSE 0.0 END)::DOUBLE"
        models = [("elasticnet", p)]
        if with_alt_model:
            models.append(("xgboost", f"((o_orderkey * {alt[name]}) % 10007) / 10007"))
        for model, pm in models:
            parts.append(
                f"SELECT (o_orderkey % 5 + 1)::INTEGER AS fold, o_orderkey AS row_index, {y} AS y_true, "
                f"({pm})::DOUBLE AS prob, (({pm}) * ({pm}))::DOUBLE AS prob_calibrated, '{name}' AS outcome, "
                f"'Q_PLUS_ANTHRO' AS featureset, '{model}' AS model FROM orders")
    return "F_preds AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


F_PREDS = f_preds_sql(False)
F_PREDS_ALT = f_preds_sql(True)

F_LABELS = """
F_labels AS (
  SELECT doc_id, quality::DOUBLE AS label__primary, toxic::DOUBLE AS label__secondary FROM labels
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(x.strip().lstrip(",").strip() for x in ctes) + "\n"
