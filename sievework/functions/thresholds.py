"""Constants of the screening rules, and the small rules on them."""

from __future__ import annotations

from collections.abc import Iterable

AUTO_DROP = {"AUC": 0.52, "IV": 0.01, "IV (oof)": 0.01, "Spearman ρ": 0.05, "Cliff's δ": 0.07, "C-index": 0.55, "point-biserial": 0.05, "η²": 0.005, "η² (oof)": 0.005, "KW ε²": 0.005}
LEAK_FLAG = {"AUC": 0.85, "IV": 0.50, "IV (oof)": 0.50, "C-index": 0.75}
COLLAPSE = 0.95
REVIEW_BAND = (0.70, 0.95)
VIF_FLAG, PSI_DRIFT, COX_P, SHADOW_PCT = 10.0, 0.25, 0.20, 0.95
NEAR_CONSTANT, NEAR_EMPTY = 0.98, 0.95
MIN_POSITIVES, MIN_PER_FOLD, MIN_REGRESSION = 50, 10, 100
FULL_N, REDUCED_N = 100, 30
FEATURE_TYPES = tuple("binary continuous count datetime high_card nominal ordinal".split())
TARGET_TYPES = tuple("survival regression ordinal multiclass binary".split())


def cramers_v_floor(levels: int) -> float:
    """Half of a small effect for that many levels; NaN under two."""
    return 0.05 / (levels - 1) ** 0.5 if levels >= 2 else float("nan")


def tier_for(n: int) -> str:
    for least, name in ((FULL_N, "full"), (REDUCED_N, "reduced-power")):
        if n >= least:
            return name
    return "structural-only"


def power_flag(n: int) -> str | None:
    name = tier_for(n)
    return name if name != "full" else None


def viable(target_type: str, positives: int | None, effective_n: int) -> bool:
    if target_type == "regression":
        return effective_n >= MIN_REGRESSION
    return (positives or 0) >= MIN_POSITIVES


def folds_viable(positives: Iterable[int], least: int = MIN_PER_FOLD) -> bool:
    found = list(positives)
    return len(found) > 0 and all(p >= least for p in found)


def recommended_k(tier: str) -> int:
    return 5 if tier == "full" else 3


def suggest_strategy(has_repeating_id: bool, has_date: bool) -> str:
    return "time" if has_date else "grouped" if has_repeating_id else "stratified"
