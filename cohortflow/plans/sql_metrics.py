"""SQL (DuckDB) building blocks for the metric oracles, written independently of the Spark code path."""

from __future__ import annotations


def rank_cte(name: str, src: str, keys: str, y: str = "y_true", p: str = "prob") -> str:
    """CTEs ``{name}_s``, ``{name}_c``, ``{name}_t`` and ``{name}`` (keys, roc_auc, pr_auc)."""
    return f"""
{name}_s AS (SELECT {keys}, {p} AS score, sum(({y} = 1)::INT)::DOUBLE AS pos, sum(({y} <> 1)::INT)::DOUBLE AS neg
  FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY {keys}, {p}),
{name}_c AS (SELECT *, COALESCE(sum(neg) OVER w, 0) AS neg_below, COALESCE(sum(pos) OVER w, 0) AS pos_below
  FROM {name}_s WINDOW w AS (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_t AS (SELECT {keys}, sum(pos) AS P, sum(neg) AS N FROM {name}_s GROUP BY {keys}),
{name} AS (SELECT {keys},
  CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
  CASE WHEN max(P) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * (P - pos_below) / ((P + N) - (pos_below + neg_below))
       END) / max(P) END AS pr_auc
  FROM {name}_c JOIN {name}_t USING ({keys}) GROUP BY {keys})"""


def point_cte(name: str, src: str, keys: str, y: str = "y_true", p: str = "prob") -> str:
    """CTE ``{name}`` (keys, n, pos, brier, accuracy, f1, calibration_intercept, calibration_slope)."""
    q = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"""
{name}_a AS (SELECT {keys}, count(*) AS n, sum(({y} = 1)::INT)::BIGINT AS pos, avg(({p} - {y}) * ({p} - {y})) AS brier,
  avg(CASE WHEN ({p} >= 0.5) = ({y} = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  sum((({p} >= 0.5) AND {y} = 1)::INT)::DOUBLE AS tp, sum((({p} >= 0.5) AND {y} <> 1)::INT)::DOUBLE AS fp,
  sum((({p} < 0.5) AND {y} = 1)::INT)::DOUBLE AS fn,
  regr_intercept({y}, ln({q} / (1 - {q}))) AS calibration_intercept,
  regr_slope({y}, ln({q} / (1 - {q}))) AS calibration_slope
  FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {keys}, n, pos, brier, accuracy,
  CASE WHEN tp + 0.5 * (fp + fn) > 0 THEN tp / (tp + 0.5 * (fp + fn)) ELSE 0.0 END AS f1,
  calibration_intercept, calibration_slope FROM {name}_a)"""


def metrics_cte(name: str, src: str, keys: str, y: str = "y_true", p: str = "prob") -> str:
    """CTE ``{name}`` with keys and the seven fold metrics."""
    return rank_cte(f"{name}_r", src, keys, y, p) + "," + point_cte(f"{name}_p", src, keys, y, p) + f""",
{name} AS (SELECT {keys}, r.roc_auc, r.pr_auc, p.brier, p.accuracy, p.f1, p.calibration_intercept,
  p.calibration_slope FROM {name}_p p LEFT JOIN {name}_r r USING ({keys}))"""


def binned_cte(name: str, src: str, keys: str, y: str = "y_true", p: str = "prob", bins: int = 10) -> str:
    """CTE ``{name}`` (keys, bin, bin_lo, bin_hi, n, pos, pos_rate, prob_mean, prob_median)."""
    qs = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""
{name}_v AS (SELECT {keys}, {y}::DOUBLE AS y, {p}::DOUBLE AS p FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL),
{name}_e AS (SELECT {keys}, list_sort(list_distinct(quantile_cont(p, [{qs}]))) AS edges FROM {name}_v GROUP BY {keys}),
{name}_b AS (SELECT v.*, e.edges, greatest(1, len(list_filter(e.edges, lambda x: x < v.p))) AS bin
  FROM {name}_v v JOIN {name}_e e USING ({keys})),
{name} AS (SELECT {keys}, bin, edges[bin] AS bin_lo, edges[bin + 1] AS bin_hi, count(*) AS n, sum(y) AS pos,
  avg(y) AS pos_rate, avg(p) AS prob_mean, median(p) AS prob_median FROM {name}_b GROUP BY {keys}, bin, edges)"""


def round_cols(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in cols)
