"""Cleaning and projection of sales history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.schema import K, SIGNS


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what is no number becomes null, and so does NaN."""
    return df.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in cols})


def date_from_parts(y: Column, m: Column, d: Column, first: str = "2018-01-01", days: int = 3660) -> Column:
    """A real date of the window, else null."""
    date = F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")
    since = F.datediff(date, F.lit(first).cast("date"))
    return F.when((y >= 2000) & m.between(1, 12) & d.between(1, 31) & since.between(0, days - 1), date)


def valid_sales(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ID_PRODUIT").isNotNull() & F.col("ID_SO").isNotNull() & F.col("QUANTITE").isNotNull())


def counted_ingest(raw: DataFrame, name: str | Observation, first: str = "2018-01-01", days: int = 3660) -> DataFrame:
    """Dated sales of raw rows with the columns PARAM_ANNEE, PARAM_MOIS and PARAM_JOUR (numbers or text).

    Rows without product, store or quantity are left out; a date that is not real or not in the window becomes null.
    Counters are taken in the same pass, in batch or stream, under ``name`` or an Observation:
    lignes, sans_produit (no product or quantity), sans_so (of the others, no store) and
    dates_invalides (of the valid rows).  They count each time that Spark reads the rows, which a sort does twice:
    write the result first.
    """
    part = lambda c: F.col(c).try_cast("double").cast("int")
    dated = raw.withColumn("date", date_from_parts(part("PARAM_ANNEE"), part("PARAM_MOIS"), part("PARAM_JOUR"), first, days))
    known = F.col("ID_PRODUIT").isNotNull() & F.col("QUANTITE").isNotNull()
    placed = known & F.col("ID_SO").isNotNull()
    counters = {"lignes": F.lit(True), "sans_produit": ~known, "sans_so": known & ~placed, "dates_invalides": placed & F.col("date").isNull()}
    return valid_sales(dated.observe(name, *[F.count_if(c).alias(n) for n, c in counters.items()]))


def usable_target(df: DataFrame, clip: bool = False) -> DataFrame:
    """Dated rows with a target of at least 0; with ``clip`` negative targets become 0."""
    if clip:
        df = df.withColumn("QUANTITE", F.greatest("QUANTITE", F.lit(0.0)))
    return df.filter("date is not null and QUANTITE is not null and QUANTITE >= 0")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def drop_uninformative(df: DataFrame, cols: list[str], most_null: float = 0.5) -> DataFrame:
    """Drop constant columns and those with more than half nulls; one aggregate decides."""
    stats = df.agg(F.count("*").alias("n"), *[x for c in cols for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.count(c).alias(f"n_{c}"))]).first()
    gone = [c for c in cols if stats[f"a_{c}"] == stats[f"b_{c}"] or stats[f"n_{c}"] < stats["n"] * (1 - most_null)]
    return df.drop(*gone)


def dedupe_days(df: DataFrame, order: list[str]) -> DataFrame:
    """First row of each day, with an explicit tie-break."""
    w = Window.partitionBy(*K, "date").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def align_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*K, "date", *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def narrow_types(df: DataFrame) -> DataFrame:
    """Doubles to float, longs that fit to int: declared ranges come from one aggregate."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    span = df.agg(*[x for c in longs for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first() if longs else {}
    fit = {c: F.col(c).cast("int") for c in longs if span[f"a_{c}"] is not None and -(2**31) <= span[f"a_{c}"] and span[f"b_{c}"] < 2**31}
    return df.withColumns(fit | {f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def select_sales_columns(df: DataFrame, fixed: list[str]) -> DataFrame:
    dynamic = sorted(c for c in df.columns if c.startswith(("PARAM_JS_", "PARAM_PROMO_")))
    return df.select(*[c for c in fixed if c in df.columns and c not in dynamic], *dynamic)


def normalize_feature_name(name: Column) -> Column:
    return F.when(name.startswith("PARAM_"), name).otherwise(F.concat(F.lit("PARAM_"), F.upper(name)))


def history_window(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` days of each couple."""
    w = Window.partitionBy(*K)
    return df.withColumn("_last", F.max("date").over(w)).filter(F.datediff("_last", "date") < days).drop("_last")


def systematic_sample(df: DataFrame, every: int, order: list[str]) -> DataFrame:
    """Each ``every``-th row within its couple."""
    w = Window.partitionBy(*K).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") % every == 1 % every).drop("_n")


def business_sign_clip(value: Column, feature: Column) -> Column:
    """Value cut to the sign that a feature's elasticity may have; null stays null."""
    of = lambda sign: feature.isin([f for f, s in SIGNS.items() if s == sign])
    cut = F.when(of("max"), F.least(value, F.lit(0.0))).when(of("min"), F.greatest(value, F.lit(0.0))).otherwise(value)
    return F.when(value.isNotNull(), cut)


def fill_or_drop_nulls(df: DataFrame, cols: list[str], drop: bool = False) -> DataFrame:
    """Nulls of number columns become 0, or their rows go; NaN counts as null."""
    df = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes if c in cols and t in ("double", "float")})
    return df.na.drop(subset=cols) if drop else df.na.fill(0, subset=cols)


def split_numeric_exogenous(cols: list[str], target: str = "QUANTITE") -> list[str]:
    """The parameters without the target, in their order."""
    return [c for c in cols if c != target]


def first_nomenclature(df: DataFrame) -> DataFrame:
    """The nomenclature of each couple's earliest row that has one; of equal dates the least."""
    known = F.col("ID_NOMENCLATURE").isNotNull()
    return df.groupBy(*K).agg(F.min(F.when(known, F.struct("date", "ID_NOMENCLATURE")))["ID_NOMENCLATURE"].alias("ID_NOMENCLATURE"))


def latest_training(log: DataFrame, best: bool = False) -> DataFrame:
    """Last training date of each couple; with ``best`` the row of that date with the lowest RMSE, ties by model name."""
    if not best:
        return log.groupBy("id_produit", "id_so").agg(F.max("date_entrainement").alias("date_entrainement"))
    w = Window.partitionBy("id_produit", "id_so").orderBy(F.col("date_entrainement").desc_nulls_last(), F.col("rmse_train").asc_nulls_last(), "model_name")
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def update_quantity(df: DataFrame, new: DataFrame) -> DataFrame:
    """Quantities that ``new`` has replace the old ones."""
    fresh = new.select(*K, "date", F.col("QUANTITE").alias("_new"))
    return df.join(fresh, [*K, "date"], "left").withColumn("QUANTITE", F.coalesce("_new", "QUANTITE")).drop("_new")
