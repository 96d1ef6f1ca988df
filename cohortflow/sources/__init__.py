from .readers import (
    DEFAULT_SENTINELS, apply_column_mapping, load_column_mapping, load_picks, load_predictions,
    mapping_rows, null_sentinels, parse_pick_strings, read_cohort, write_table,
)
from .schema import (
    auto_feature_columns, coerce_mostly_numeric, column_resolver, drop_leakage, ensure_columns,
    infer_types, label_rows, leakage_from_rules, normalize_col, normalize_col_expr, resolve_columns,
    split_columns,
)

__all__ = [
    "DEFAULT_SENTINELS", "apply_column_mapping", "load_column_mapping", "load_picks", "load_predictions",
    "mapping_rows", "null_sentinels", "parse_pick_strings", "read_cohort", "write_table",
    "auto_feature_columns", "coerce_mostly_numeric", "column_resolver", "drop_leakage", "ensure_columns",
    "infer_types", "label_rows", "leakage_from_rules", "normalize_col", "normalize_col_expr",
    "resolve_columns", "split_columns",
]
