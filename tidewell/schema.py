"""Keys, thresholds and feature roles of the demand model."""

from __future__ import annotations

K = ["ID_PRODUIT", "ID_SO"]

# Class limits, guards and clips that results must share.
ADI_LIMIT, CV2_LIMIT = 1.32, 0.49
CLASSES = ["smooth", "intermittent", "erratic", "lumpy", "indetermine"]
MIN_PROMO_LIFT, MIN_RANGE = 0.15, 0.10
LAGS = [0, 1, 2, 7, 14, 28, 91, 365]
ROLLING = [7, 28, 91]
HORIZONS = [1, 2, 3, 7, 14, 21, 28, 45, 60, 75, 90]
MIN_ROWS, STRIDE = 61, 7
TEST_DAYS = 30
PRICE_GRIDS = {"a": [0.88, 0.96, 1.04, 1.12, 1.20], "b": [0.8, 0.9, 1.0, 1.1, 1.2], "c": [0.94, 0.98, 1.02, 1.06, 1.10]}
PROMO_LEVELS = [i / 20 for i in range(19)]
ORDINAL, TOTALS_BINARY, TOTALS_SKIPPED = {"PARAM_MOIS", "PARAM_JOUR_SEMAIN"}, {"PARAM_VACANCE", "PARAM_STOCK"}, {"PARAM_ANNEE", "PARAM_JOUR"}
BINARY, CALENDAR_UNIT = {"PARAM_VACANCE", "est_promo"}, {"PARAM_ANNEE"}

# The sign that an elasticity may have ("max" 0 or "min" 0), and those that the audit looks at.
SIGNS = {
    "PARAM_PRIX": "max", "PARAM_LOG_PRIX": "max", "PARAM_PRIX_ACHAT": "max", "PARAM_MARKUP_PCT": "max",
    "PARAM_PRIX_VENTE_PROMO": "min", "PARAM_DISCOUNT_PCT": "min", "PARAM_RATIO_PROMO": "min", "PARAM_EST_PROMO": "min",
}
AUDITED = ["PARAM_PRIX", "PARAM_LOG_PRIX", "PARAM_EST_PROMO", "PARAM_PRIX_VENTE_PROMO", "PARAM_DISCOUNT_PCT"]

# Names that are keys or labels of a row.
NOT_FEATURES = {"date", "QUANTITE"}
# Features left out of attribution shares and of elasticities.
EXCLUDED_ALWAYS = {
    "ID_PRODUIT", "ID_SO", "ID_NOMENCLATURE", "sb_class",
    "PARAM_ANNEE", "PARAM_MOIS", "PARAM_JOUR", "PARAM_JOUR_SEMAIN",
    "dow", "month", "day_of_year", "mois", "semaine", "jour_annee", "horizon",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "day_sin", "day_cos",
    "sin_doy", "cos_doy", "sin_dow", "cos_dow", "sin_month", "cos_month",
    "sin_jour", "cos_jour", "sin_semaine", "cos_semaine", "sin_mois", "cos_mois",
    "PRIX_ACHAT01",
}
# Features of the past and of the target's date, which have a share but no elasticity.
EXCLUDED_HISTORY = {
    "target_dow", "target_month", "target_day", "target_doy", "target_is_weekend", "target_week",
    "days_since_sale", "cv_28", "trend_28",
}
EXCLUDED_HISTORY_PREFIXES = (
    "y_origin_m", "y_origin",
    "roll_mean_", "roll_std_", "roll_max_", "roll_min_", "roll_nonzero_ratio_", "roll_quantile_",
    "trend_", "momentum_",
    "ratio_dow", "ratio_month", "cv_month", "interaction_dow", "mean_dow_today", "mean_month_today", "std_month_today",
)
# Features for which the comparison of models states no elasticity.
BENCH_EXCLUDED = {
    "ID_PRODUIT", "ID_SO", "ID_NOMENCLATURE",
    "PARAM_ANNEE", "PARAM_MOIS", "PARAM_JOUR", "PARAM_JOUR_SEMAIN",
    "dow", "month", "day_of_year", "dow_sin", "dow_cos", "month_sin", "month_cos", "day_sin", "day_cos", "horizon",
    "sin_doy", "cos_doy", "sin_dow", "cos_dow", "sin_month", "cos_month",
}


def has_share(name: str) -> bool:
    """Whether a feature has an attribution share."""
    return name not in EXCLUDED_ALWAYS | NOT_FEATURES


def feature_role(name: str) -> str:
    """excluded, binary, promo, cal_unit or continuous: what is excluded comes first, so no calendar unit is left in practice."""
    if not has_share(name) or name in EXCLUDED_HISTORY or name.startswith(EXCLUDED_HISTORY_PREFIXES):
        return "excluded"
    if name in BINARY or name.startswith("PARAM_JS_"):
        return "binary"
    if name.startswith("PARAM_PROMO_"):
        return "promo"
    return "cal_unit" if name in CALENDAR_UNIT else "continuous"
