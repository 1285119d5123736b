"""Calendar, cyclic and price features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(day: Column) -> dict[str, Column]:
    return {
        "dow": F.weekday(day), "jour": F.dayofmonth(day), "jour_annee": F.dayofyear(day), "semaine": F.weekofyear(day), "mois": F.month(day), "annee": F.year(day),
        "debut_mois": (F.dayofmonth(day) == 1).cast("int"), "fin_mois": (day == F.last_day(day)).cast("int"), "weekend": (F.weekday(day) >= 5).cast("int"),
    }


def cyclic(day: Column) -> dict[str, Column]:
    turn = {"jour": (F.dayofyear(day), 365.25), "semaine": (F.weekofyear(day), 52.0), "mois": (F.month(day), 12.0)}
    return {f"{f}_{n}": getattr(F, f)(2 * F.pi() * v / p) for n, (v, p) in turn.items() for f in ("sin", "cos")}


def price(unit: Column, promo: Column, cost: Column) -> dict[str, Column]:
    """Ratios of the price; nulls count as 0, and all are 0 where the price is not positive."""
    unit, promo, cost = (F.coalesce(c, F.lit(0.0)) for c in (unit, promo, cost))
    safe = lambda c: F.when(unit > 0, c).otherwise(0.0)
    on = (promo > 0) & (promo < unit)
    return {"ratio_promo": safe(promo / unit), "est_promo": (on & (unit > 0)).cast("int"), "discount_pct": safe(F.when(on, (unit - promo) / unit).otherwise(0.0)), "markup_pct": safe((unit - cost) / unit), "log_prix": F.log1p(F.greatest(unit, F.lit(0.0)))}


def build_features(df: DataFrame) -> DataFrame:
    """All features of a dated sales frame in one projection."""
    of = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    return df.withColumns(calendar(F.col("date")) | cyclic(F.col("date")) | price(of("PARAM_PRIX"), of("PRIX_VENTE_PROMO"), of("PARAM_PRIX_ACHAT")))


def safe_cv(value: Column, std: Column) -> Column:
    return F.when(F.abs(value) <= 1e-8, 99.0).otherwise(F.round(F.abs(std / value), 2))
