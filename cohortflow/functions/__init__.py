from .colref import c, quote
from .exprs import clip_prob, logit, apply_platt_expr, tier_expr, error_expr, truth
from .rules import compile_rule, build_outcomes

__all__ = [
    "c", "quote", "clip_prob", "logit", "apply_platt_expr", "tier_expr", "error_expr", "truth",
    "compile_rule", "build_outcomes",
]
