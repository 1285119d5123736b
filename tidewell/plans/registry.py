"""Registered demand-analytics queries and their DuckDB counterparts.

All read the driver's tables through one view: daily sales by part type and region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.folders import durable, new_folder
from tidewell.functions.ship import ship
from tidewell.plans.sql import ROLES, SQL
from tidewell.functions import features as ft
from tidewell.operators import clean, demand, elasticity, least_squares, metrics, models, totals, windows
from tidewell.schema import CLASSES, K, PRICE_GRIDS, PROMO_LEVELS, feature_role
from tidewell.sources import text
from tidewell.streaming import stats
from tidewell.streaming.upsert import read_current

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Daily sales; sums are taken in decimals, so that they do not depend on order."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    items = read("lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), *[F.col(c).cast("decimal(18,4)").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    near = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").cast("int").alias("ID_SO"))
    rows = items.join(read("part").select("p_partkey", F.col("p_type").alias("ID_PRODUIT")), F.col("l_partkey") == F.col("p_partkey")).join(near, F.col("l_suppkey") == F.col("s_suppkey"))
    q, p, s = (F.sum(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount"))
    out = rows.groupBy(*K, "date").agg(q.alias("QUANTITE"), (p / q).alias("PARAM_PRIX"), F.round(s / F.count("*"), 6).alias("_promo"))
    return out.select(*K, "date", "QUANTITE", "PARAM_PRIX", F.when(F.col("_promo") >= 0.06, F.col("_promo")).otherwise(0.0).alias("PARAM_PROMO_1"), (F.weekday("date") >= 5).cast("double").alias("PARAM_VACANCE"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Sales are written once, as the calendar takes both their span and their rows."""
    return demand.dense_calendar(durable(sales(spark, d), "sales"))


def naive(spark: SparkSession, d: str) -> DataFrame:
    """Demand with the forecast of seven rows before."""
    return dense(spark, d).select(*K, "date", "QUANTITE", F.lag("QUANTITE", 7).over(windows.by_date()).alias("p"))


def r(n: int, *cols: str) -> list:
    return [F.round(c, n).alias(c) for c in cols]


def above(n: int, *cols: str) -> list:
    """Rounded after a nudge that settles halves, which engines round apart."""
    return [F.round(F.col(c) + 10.0 ** -(n + 2), n).alias(c) for c in cols]


NAMES = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE"]


def curve(spark: SparkSession, d: str) -> DataFrame:
    return elasticity.log_linear(sales(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a4_sales_stats_report(ship(spark), sf_dir)


@query
def a1_series_stats(spark, d):
    f = ["moyenne_all", "ecart_type_all", "moyenne_nz", "ecart_type_nz", "cv_all", "cv_nz"]
    return demand.series_stats(dense(spark, d)).select(*K, "nb_records", "nb_records_avec_vente", "somme", *r(6, *f))


@query
def a2_demand_days(spark, d):
    return demand.series_stats(dense(spark, d)).select(*K, "nb_jours_obs", "nb_jours_demand")


@query
def a4_sales_stats_report(spark, d):
    return demand.sales_stats_report(dense(spark, d)).select(*K, "nb_records", "somme", "moyenne_nz", "cv_nz", "adi", "cv2", "profil_demande").orderBy(*K)


@query
def a5_class_distribution(spark, d):
    return demand.class_distribution(demand.sales_stats_report(dense(spark, d)), CLASSES)


@query
def a6_ingest_summary(spark, d):
    return sales(spark, d).agg(F.count_distinct("ID_PRODUIT").alias("produits"), F.count_distinct("ID_SO").alias("magasins"), F.count_distinct(*K).alias("couples"), F.count_if(F.col("ID_SO").isNull()).alias("sans_so"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.datediff(F.max("date"), F.min("date")).cast("long").alias("jours"))


@query
def a7_date_gap_report(spark, d):
    return demand.date_gap_report(sales(spark, d))


@query
def a8_demand_segment(spark, d):
    return demand.demand_segment(dense(spark, d))


@query
def a9_date_ranges(spark, d):
    return sales(spark, d).groupBy(*K).agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


@query
def a11_daily_sales(spark, d):
    return demand.daily_sales(sales(spark, d))


@query
def a12_daily_mean(spark, d):
    return sales(spark, d).groupBy("ID_PRODUIT", "date").agg(F.avg("QUANTITE").alias("QUANTITE"), F.avg("PARAM_PRIX").alias("PARAM_PRIX")).select("ID_PRODUIT", "date", *above(6, "QUANTITE", "PARAM_PRIX"))


@query
def a13_eligible_series(spark, d):
    rows = sales(spark, d)
    return rows.join(rows.groupBy(*K).count().filter("count >= 180").select(*K), K, "left_semi").groupBy(*K).agg(F.count("*").alias("n"))


@query
def a14_mean_std(spark, d):
    return sales(spark, d).groupBy(*K).agg(F.round(F.avg("PARAM_PRIX"), 5).alias("moyenne"), F.round(F.stddev_pop("PARAM_PRIX"), 5).alias("ecart_type"))


@query
def a15_median_iqr(spark, d):
    return metrics.median_iqr(sales(spark, d), "PARAM_PRIX").select(*K, *r(5, "mediane", "iqr", "robust_std"))


@query
def a16_forecast_metrics_by_series(spark, d):
    return metrics.forecast_metrics_by_series(naive(spark, d), "QUANTITE", "p").select(*K, "N_OBS", "SUM_ACTUAL", "SUM_PRED", *r(5, "MAE", "RMSE", "MEAN_ACTUAL", "WMAPE", "DIFF_PCT"))


@query
def a17_forecast_metrics(spark, d):
    rows = naive(spark, d).filter("p is not null").withColumn("mois", F.month("date"))
    return metrics.forecast_metrics(rows, "QUANTITE", "p", ["mois"]).select("mois", "n", *r(5, "mae", "rmse", "mean_y", "mape_pct"))


@query
def a18_tweedie_deviance(spark, d):
    rows = naive(spark, d).filter("p is not null")
    return rows.groupBy(*K).agg(F.round(F.avg(metrics.tweedie_deviance(F.col("QUANTITE"), F.col("p") + 1)), 5).alias("deviance"))


@query
def a19_volume_accuracy(spark, d):
    return metrics.volume_accuracy(naive(spark, d).na.drop(subset=["p"]), "QUANTITE", "p").select(*K, *r(5, "wmape", "accuracy", "volume_error", "volume_accuracy"))


@query
def a20_masked_rmse(spark, d):
    e = F.col("p") - F.col("QUANTITE")
    return naive(spark, d).groupBy("ID_PRODUIT").agg(F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"))


@query
def a21_smape(spark, d):
    return metrics.smape(naive(spark, d).na.drop(subset=["p"]), "QUANTITE", "p").select(*K, *r(5, "smape"))


@query
def a22_promo_lift(spark, d):
    return metrics.promo_lift(sales(spark, d), "PARAM_PROMO_1").select(*K, *r(5, "q_avec", "q_sans", "ratio"))


@query
def a23_range_check(spark, d):
    return metrics.range_check(sales(spark, d), "PARAM_PRIX", K)


@query
def a26_accuracy_buckets(spark, d):
    m = metrics.forecast_metrics_by_series(naive(spark, d), "QUANTITE", "p")
    return metrics.accuracy_buckets(m).select("n_50", "n_100", "n_plus", *r(4, "mediane_wmape"))


@query
def a28_volume_pick(spark, d):
    report = demand.sales_stats_report(dense(spark, d)).select(*K, F.lit("toutes").alias("classe"), F.col("somme").alias("volume"))
    return demand.volume_stratified_pick(report, 7)


@query
def a30_normalized_share(spark, d):
    v = sales(spark, d).groupBy("ID_PRODUIT").agg(F.sum("QUANTITE").alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("t")))).select("ID_PRODUIT", F.round(F.col("v") / F.col("t"), 6).alias("part"))


@query
def j1_rows_of_class(spark, d):
    classes = demand.sales_stats_report(dense(spark, d)).filter("profil_demande <> 'indetermine'").select(*K, "profil_demande")
    return sales(spark, d).join(classes, K).groupBy("profil_demande").agg(F.count("*").alias("n"), F.sum("QUANTITE").alias("q"))


@query
def j4_update_quantity(spark, d):
    rows = sales(spark, d)
    return clean.update_quantity(rows.select(*K, "date", "QUANTITE"), rows.filter("dayofmonth(date) = 1").select(*K, "date", (F.col("QUANTITE") * 2).alias("QUANTITE")))


@query
def j6_version_intervals(spark, d):
    rows = sales(spark, d)
    versions = rows.filter("month(date) in (1, 7)").groupBy(*K, F.trunc("date", "month").alias("date")).agg(F.round(F.avg("PARAM_PRIX"), 4).alias("modele"))
    return windows.version_in_force(rows, versions, ["modele"]).groupBy(*K, F.col("version").alias("valid_from")).agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"))


@query
def j7_calendar_spine(spark, d):
    return dense(spark, d).select(*K, "date", "QUANTITE")


@query
def j10_with_and_without_promo(spark, d):
    rows = sales(spark, d)
    on = rows.filter("PARAM_PROMO_1 > 0.075").select("ID_PRODUIT", "ID_SO", F.year("date").alias("y")).distinct()
    years = rows.select(*K, F.year("date").alias("y")).distinct()
    keys = [*K, "y"]
    return years.join(on, keys, "left_semi").withColumn("estimateur", F.lit("A")).unionByName(years.join(on, keys, "left_anti").withColumn("estimateur", F.lit("B")))


@query
def w1_origin_lags(spark, d):
    out = windows.origin_features(dense(spark, d))
    return out.select(*K, "date", *[c for c in out.columns if c.startswith("y_origin")])


@query
def w2_rolling_stats(spark, d):
    out = windows.origin_features(dense(spark, d))
    return out.select(*K, "date", *r(5, *[c for c in out.columns if c.startswith("roll_")]))


@query
def w3_trend_sale_cv(spark, d):
    return windows.origin_features(dense(spark, d)).select(*K, "date", *r(5, "trend_28", "cv_28"), F.col("days_since_sale").cast("long").alias("days_since_sale"))


@query
def w6_calendar_rolling(spark, d):
    return windows.calendar_rolling(dense(spark, d)).select(*K, "date", *r(5, "mean_7", "var_7", "mean_30", "var_30", "mean_90", "var_90"))


@query
def w7_expanding_stats(spark, d):
    return windows.expanding_stats(dense(spark, d)).select(*K, "date", *above(6, "mean_exp", "var_exp"))


@query
def w8_impute_midpoint(spark, d):
    return windows.impute_midpoint(dense(spark, d), "PARAM_PRIX").select(*K, "date", *above(6, "PARAM_PRIX"))


@query
def w9_interpolate_linear(spark, d):
    return windows.interpolate_linear(dense(spark, d), "PARAM_PRIX").select(*K, "date", *above(6, "PARAM_PRIX"))


@query
def w12_split_with_purge(spark, d):
    return windows.split_with_purge(sales(spark, d)).groupBy(*K, "split").agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"))


@query
def w13_split_fraction(spark, d):
    return windows.split_fraction(sales(spark, d)).groupBy(*K, "is_test").agg(F.count("*").alias("n"), F.min("date").alias("d0"))


@query
def w15_expanding_folds(spark, d):
    return windows.expanding_folds(sales(spark, d), 5).groupBy(*K, "fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"))


@query
def w16_last_price(spark, d):
    return sales(spark, d).groupBy(*K).agg(F.round(F.max_by("PARAM_PRIX", "date"), 6).alias("prix"))


@query
def w17_winsorize(spark, d):
    return windows.winsorize_by_series(sales(spark, d), "PARAM_PRIX").select(*K, "date", *above(6, "PARAM_PRIX"))


@query
def w20_scale_series(spark, d):
    return windows.scale_series(sales(spark, d), "QUANTITE").select(*K, "date", *r(6, "QUANTITE_scaled"))


@query
def w22_regression_lags(spark, d):
    return windows.regression_lags(dense(spark, d).select(*K, "date", "QUANTITE"), ["QUANTITE"])


@query
def m3_direct_samples(spark, d):
    out = windows.direct_samples(dense(spark, d), ["PARAM_PROMO_1"])
    exact = ["y_origin_m0", "y_origin_m7", "y_origin_m365", "target_dow", "target_doy", "target_is_weekend", "PARAM_PROMO_1", "y"]
    return out.select(*K, "_origin_date", "_target_date", "_is_test", "horizon", *exact, *r(5, "roll_mean_28", "roll_std_91", "trend_28"))


@query
def f4_build_features(spark, d):
    rows = ft.build_features(sales(spark, d).withColumn("PRIX_VENTE_PROMO", F.col("PARAM_PRIX") * (1 - F.col("PARAM_PROMO_1"))))
    return rows.select(*K, "date", "dow", "jour", "jour_annee", "semaine", "mois", "annee", "debut_mois", "fin_mois", "weekend", "est_promo", *r(6, "sin_jour", "cos_mois", "ratio_promo", "discount_pct", "log_prix"))


@query
def p8_dedupe_days(spark, d):
    return clean.dedupe_days(sales(spark, d).withColumn("ID_SO", F.lit(0)), ["QUANTITE", "PARAM_PRIX"]).select(*K, "date", "QUANTITE")


@query
def p14_history_window(spark, d):
    return clean.history_window(sales(spark, d), 90).groupBy(*K).agg(F.count("*").alias("n"), F.sum("QUANTITE").alias("q"))


@query
def p15_systematic_sample(spark, d):
    return clean.systematic_sample(sales(spark, d), 100, ["date"]).select(*K, "date", "QUANTITE")


@query
def s9_kv_line(spark, d):
    rows = sales(spark, d)
    return rows.select(text.to_kv_line(rows, ["ID_PRODUIT", "ID_SO", "date"]).alias("ligne"))


@query
def t6_best_model(spark, d):
    rows = naive(spark, d).withColumn("p1", F.lag("QUANTITE", 1).over(windows.by_date())).na.drop(subset=["p", "p1"])
    err = lambda p, name: rows.groupBy(*K).agg(F.round(F.avg(F.abs(F.col(p) - F.col("QUANTITE"))), 6).alias("mae")).withColumn("modele", F.lit(name))
    return err("p", "saison").unionByName(err("p1", "veille")).groupBy(*K).agg(F.min_by("modele", F.struct("mae", "modele")).alias("modele"), F.min("mae").alias("mae"))


@query
def u2_keys_in_both(spark, d):
    rows = sales(spark, d).select(*K, F.dayofyear("date").alias("j"), F.col("PARAM_PROMO_1").alias("x"))
    return rows.filter("x > 0").select(*K, "j").intersect(rows.filter("x = 0").select(*K, "j"))


@query
def u3_keys_minus(spark, d):
    rows = sales(spark, d).select(*K, F.dayofyear("date").alias("j"), F.col("PARAM_PROMO_1").alias("x"))
    return rows.filter("x > 0").select(*K, "j").subtract(rows.filter("x = 0").select(*K, "j"))


@query
def e1_price_scenarios(spark, d):
    out = elasticity.price_scenarios(curve(spark, d), PRICE_GRIDS["a"], elasticity.demand_curve, NAMES)
    return out.groupBy(*K, "scenario").agg(F.round(F.sum("prediction"), 4).alias("total"))


@query
def e2_promo_scenarios(spark, d):
    out = elasticity.promo_scenarios(curve(spark, d), PROMO_LEVELS, elasticity.demand_curve, NAMES)
    return out.groupBy(*K, "scenario").agg(F.round(F.sum("prediction"), 4).alias("total"))


@query
def e1_price_range(spark, d):
    """Five prices from the lowest to the highest of the history."""
    out = elasticity.price_scenarios(curve(spark, d), 5, elasticity.demand_curve, NAMES)
    return out.groupBy(*K, "scenario").agg(F.round(F.sum("prediction"), 4).alias("total"))


@query
def e2_one_promo(spark, d):
    """A scorer without PARAM_PROMO_ columns: its PARAM_PROMO takes the levels."""
    scorer = lambda x: elasticity.demand_curve(x | {"PARAM_PROMO_1": x["PARAM_PROMO"]})
    out = elasticity.promo_scenarios(curve(spark, d), PROMO_LEVELS, scorer, ["PARAM_PRIX", "PARAM_VACANCE", "PARAM_PROMO"])
    return out.groupBy(*K, "scenario").agg(F.round(F.sum("prediction"), 4).alias("total"))


@query
def e7_elasticities(spark, d):
    return elasticity.elasticities(curve(spark, d), NAMES, elasticity.demand_curve, NAMES)


@query
def e10_ols_elasticity(spark, d):
    return elasticity.ols_elasticity(sales(spark, d), "PARAM_PRIX")


def _lagged(spark, d):
    """Sales with the weekday and the quantity of the row before."""
    return sales(spark, d).withColumns({"dow": F.weekday("date").cast("double"), "y_origin_m1": F.coalesce(F.lag("QUANTITE", 1).over(windows.by_date()), F.lit(0.0))})


OLS_FEATURES = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE", "dow", "y_origin_m1"]


@query
def e10_ols_of_features(spark, d):
    """A price, a promotion, a flag, an excluded feature of the calendar and a lag in one fit for each couple."""
    return least_squares.ols_elasticities(_lagged(spark, d), OLS_FEATURES, plain=True)


@query
def m17_ols(spark, d):
    """Weights of a common fit of two features for each couple."""
    fitted = least_squares.fit_least_squares(sales(spark, d), ["PARAM_PRIX", "PARAM_PROMO_1"], plain=True)
    return least_squares.weights(fitted, ["PARAM_PRIX", "PARAM_PROMO_1"]).select(*K, "feature", *r(5, "weight"))


@query
def e12_slope_pm10(spark, d):
    return elasticity.slope_pm10(curve(spark, d), "PARAM_PRIX", elasticity.demand_curve, NAMES).select(*K, *r(8, "slope"))


@query
def e13_attribution_share(spark, d):
    """Shares of a price, a promotion, a flag and a lag; the weekday counts in the total only."""
    return elasticity.attribution_share(_lagged(spark, d), {"PARAM_PRIX": -0.01, "PARAM_PROMO_1": 40.0, "PARAM_VACANCE": 5.0, "dow": 0.7, "y_origin_m1": 0.1})


@query
def a24_elasticity_summary(spark, d):
    return metrics.elasticity_summary(elasticity.ols_elasticity(sales(spark, d), "PARAM_PRIX").withColumn("feature", F.lit("PARAM_PRIX"))).select("feature", "n", *r(3, "mediane", "moyenne"))


@query
def a25_sign_audit(spark, d):
    return metrics.sign_audit(elasticity.ols_elasticity(sales(spark, d), "PARAM_PRIX").withColumn("feature", F.lit("PARAM_PRIX")))


def _modelled(spark, d):
    """Sales with features and split; written once, as fits and predictions read them often."""
    return durable(windows.split_with_purge(ft.build_features(sales(spark, d))), "modelled")


FEATURES = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE", "mois", "dow"]


@query
def m2_fit_class_model(spark, d):
    classes = demand.sales_stats_report(dense(spark, d)).select(*K, F.col("profil_demande").alias("sb_class"))
    rows = _modelled(spark, d).join(classes, K)
    train = rows.filter("split = 'train'").persist()
    fitted = models.fit_by_class(train, FEATURES, CLASSES)
    train.unpersist()
    return models.predict_by_class(fitted, rows.filter("split = 'test'")).select(*K, "date", "QUANTITE", "prediction")


@query
def m4_fit_direct_model(spark, d):
    s = windows.direct_samples(sales(spark, d), ["PARAM_PRIX", "PARAM_PROMO_1"])
    f = ["horizon", "y_origin_m0", "y_origin_m7", "roll_mean_28", "trend_28", "target_dow", "PARAM_PRIX", "PARAM_PROMO_1"]
    model = models.fit_model(s.filter("not _is_test"), f, "boosted", label="y")
    return metrics.forecast_metrics(models.predict(model, s.filter("_is_test")), "y", "prediction", ["horizon"])


@query
def m8_fit_per_series(spark, d):
    """A ridge of three features for each couple."""
    fitted = least_squares.fit_least_squares(sales(spark, d), NAMES, alpha=1e-3, plain=True)
    return least_squares.weights(fitted, NAMES).select(*K, "feature", *r(4, "weight"))


FOREST_GRID = [{"numTrees": n, "maxDepth": depth, "minInstancesPerNode": leaf} for n in (20, 50) for depth in (6, 10) for leaf in (1, 4)]


@query
def m12_random_forest(spark, d):
    rows = _modelled(spark, d)
    train = rows.filter("split = 'train'")
    best = models.grid_search_time_cv(train, FEATURES, FOREST_GRID, k=5, kind="forest")
    return models.predict(models.fit_model(train, FEATURES, "forest", **best), rows.filter("split = 'test'")).select(*K, "date", "QUANTITE", "prediction")


@query
def m14_fit_arx(spark, d):
    """One lag, a time index and three covariates for each couple."""
    features = ["ar_1", "t", *NAMES]
    fitted = least_squares.fit_least_squares(models.with_ar(sales(spark, d)), features, alpha=1e-3, plain=True)
    return least_squares.weights(fitted, features).select(*K, "feature", *r(4, "weight"))


def _by_weekday(x):
    return elasticity.demand_curve(x) * (1 + 0.02 * x["PARAM_JOUR_SEMAIN"])


def _weekdays(spark, d):
    return curve(spark, d).withColumn("PARAM_JOUR_SEMAIN", F.weekday("date").cast("double"))


@query
def e8_series_elasticity(spark, d):
    names = [*NAMES, "PARAM_JOUR_SEMAIN"]
    return totals.series_elasticity(_weekdays(spark, d), names, _by_weekday, names)


@query
def e9_series_elasticity_1pct(spark, d):
    return totals.series_elasticity_1pct(_weekdays(spark, d), NAMES, _by_weekday, [*NAMES, "PARAM_JOUR_SEMAIN"])


@query
def e11_perturb_single(spark, d):
    return totals.perturb_single(curve(spark, d), NAMES, lambda x: F.coalesce(elasticity.demand_curve(x), F.lit(0.0)), NAMES)


@query
def e15_permutation_importance(spark, d):
    rows = _modelled(spark, d)
    model = models.fit_model(rows.filter("split = 'train'"), FEATURES, "boosted")
    return spark.createDataFrame(models.permutation_importance(rows.filter("split = 'test'"), model, FEATURES), "feature string, rise double")


@query
def e16_elasticity_export(spark, d):
    rows = naive(spark, d)
    long = elasticity.elasticities(curve(spark, d), NAMES, elasticity.demand_curve, NAMES)
    shares = elasticity.attribution_share(sales(spark, d), {"PARAM_PRIX": -0.01, "PARAM_PROMO_1": 40.0, "PARAM_VACANCE": 5.0})
    dates = rows.groupBy(*K).agg(F.min("date").alias("DATE_HIST_MIN"), F.max("date").alias("DATE_HIST_MAX"))
    classes = demand.sales_stats_report(dense(spark, d)).select(*K, F.col("profil_demande").alias("CLASSE_SB"))
    out = elasticity.elasticity_export(long, NAMES, metrics.forecast_metrics_by_series(rows, "QUANTITE", "p"), shares, dates, classes, "curve")
    return out.select(*K, *r(5, "MAE", "SHAP_PARAM_PRIX"), "ELAST_PARAM_PRIX", "TYPE_PARAM_PRIX", "DATE_HIST_MIN", "DATE_HIST_MAX", "CLASSE_SB", "MODELE", "OK")


@query
def a31_signed_importance(spark, d):
    rows = _modelled(spark, d)
    model = models.fit_model(rows, FEATURES, "boosted")
    return spark.createDataFrame(models.signed_importance(rows, model, FEATURES), "feature string, importance double")


@query
def w19_fill_next_day(spark, d):
    rows = sales(spark, d).select(*K, F.row_number().over(windows.by_date()).cast("long").alias("ordre"), F.when(F.dayofmonth("date") % 3 > 0, F.col("date")).alias("date"))
    return windows.fill_next_day(rows, "ordre")


@query
def m5_search_params(spark, d):
    rows = _modelled(spark, d)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    found = {kind: models.search_params(train, test, FEATURES, space, kind=kind) for kind, space in models.SPACE.items()}
    return spark.createDataFrame([(kind, k, float(v), float(error)) for kind, (best, error) in found.items() for k, v in best.items()], "modele string, param string, value double, mae double")


@query
def m6_grid_search_time_cv(spark, d):
    found = models.grid_search_time_cv(_modelled(spark, d), FEATURES, models.GRIDS["tweedie"], k=3, kind="tweedie", fallback=models.FALLBACK["tweedie"])
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "param string, value double")


@query
def m7_choose_model(spark, d):
    """The report of both learners."""
    return models.choose_model(_modelled(spark, d), FEATURES)[2]


@query
def m9_refit_from_params(spark, d):
    rows = _modelled(spark, d)
    model = models.refit_from_params(rows.filter("split = 'train'"), '{"features": ["PARAM_PRIX", "dow"], "params": {"maxIter": 10}}')
    return models.predict(model, rows.filter("split = 'test'")).select(*K, "date", "QUANTITE", "prediction")


@query
def m15_lag_regression(spark, d):
    """Days without sale have the last price, no promotion and their own weekday."""
    known = {"PARAM_PRIX": F.last("PARAM_PRIX", ignorenulls=True).over(windows.by_date()), "PARAM_PROMO_1": F.coalesce("PARAM_PROMO_1", F.lit(0.0)), "PARAM_VACANCE": (F.weekday("date") >= 5).cast("double")}
    cols = ["QUANTITE", *NAMES]
    rows = durable(windows.split_with_purge(windows.regression_lags(dense(spark, d).withColumns(known).select(*K, "date", *cols), cols)).na.drop(), "lags")
    lags = [f"{c}_lag{k}" for c in cols for k in range(1, 8)]
    train = rows.filter("split = 'train'")
    inner = windows.split_with_purge(train)
    best, _ = models.search_params(inner.filter("split = 'train'"), inner.filter("split = 'test'"), lags, models.SPACE["boosted"])
    return models.predict(models.fit_model(train, lags, "boosted", **best), rows.filter("split = 'test'")).select(*K, "date", "QUANTITE", "prediction")


@query
def m16_rolling_backtest(spark, d):
    rows, covariates = sales(spark, d), ["PARAM_PRIX", "PARAM_PROMO_1"]
    f = ["horizon", "y_origin_m0", "y_origin_m7", "roll_mean_28", "trend_28", "target_dow", *covariates]
    model = models.fit_model(windows.direct_samples(rows, covariates).filter("not _is_test"), f, "boosted", label="y")

    def measured(horizon: int, stride: int) -> DataFrame:
        out = metrics.forecast_metrics(models.rolling_backtest(model, rows, horizon, stride, covariates), "y", "prediction", ["_is_test"])
        return out.select(F.lit(horizon).alias("horizon"), F.lit(stride).alias("stride"), F.col("_is_test").alias("est_test"), "n", "mae", "rmse", "mean_y", "mape_pct")

    return measured(1, 1).unionByName(measured(10, 15))


@query
def m19_forecast_by_version(spark, d):
    rows = sales(spark, d)
    versions = rows.filter("month(date) in (1, 7)").select(*K, F.trunc("date", "month").alias("date")).distinct()
    return windows.forecast_by_version(rows, versions, "PARAM_PRIX").select(*K, "date", "version", F.round(F.coalesce("prediction", F.lit(0.0)), 4).alias("prediction"))


@query
def e17_compare_with_global(spark, d):
    """Picked couples' own models against one Tweedie model of all couples."""
    rows = _modelled(spark, d)
    train = rows.filter("split = 'train'")
    return models.compare_with_global(rows, _picked(train), NAMES, models.fit_model(train, FEATURES), FEATURES)


@query
def e17_compare_lines(spark, d):
    """The same with a linear model of all couples, which SQL can state."""
    rows = _modelled(spark, d)
    train = rows.filter("split = 'train'")
    fitted = least_squares.fit_least_squares(train.withColumn("tous", F.lit(1)), NAMES, by=["tous"], plain=True).first()
    every = fitted["w"] if fitted else [0.0] * (len(NAMES) + 1)  # without training rows no couple is picked
    line = lambda x: sum((w * x[n] for n, w in zip(NAMES, every)), F.lit(every[-1]))
    return models.compare_with_global(rows, _picked(train), NAMES, line, plain=True)


def _picked(train: DataFrame) -> DataFrame:
    volumes = train.groupBy(*K).agg(F.lit("toutes").alias("classe"), F.sum("QUANTITE").alias("volume"))
    return demand.volume_stratified_pick(volumes, 7)


@query
def e14_mean_attribution(spark, d):
    return elasticity.mean_attribution(sales(spark, d), {"PARAM_PRIX": -0.01, "PARAM_PROMO_1": 40.0}).select(*K, "feature", *r(6, "attribution"))


@query
def e18_product_profile(spark, d):
    return elasticity.ols_elasticity(sales(spark, d), "PARAM_PRIX").join(demand.demand_segment(dense(spark, d)).select(*K, "profil"), K)


@query
def w14_split_at_fraction(spark, d):
    return windows.split_at_fraction(sales(spark, d)).groupBy(*K, "is_test").agg(F.count("*").alias("n"), F.min("date").alias("d0"))


@query
def p1_coerce_numeric(spark, d):
    n = F.col("p_partkey") % 3
    raw = F.when(n == 0, F.col("p_brand")).when(n == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.col("p_size").cast("string"))
    return clean.coerce_numeric(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", raw.alias("x")), ["x"])


@query
def p2_date_from_parts(spark, d):
    day = F.col("o_orderdate")
    parts = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), (F.dayofmonth(day) + F.col("o_orderkey") % 4).alias("j"))
    return parts.select("o_orderkey", clean.date_from_parts(F.col("y"), F.col("m"), F.col("j"), "1998-06-01", 1000).alias("date"))


@query
def p3_valid_sales(spark, d):
    holes = {"QUANTITE": F.when(F.col("QUANTITE").cast("long") % 7 != 0, F.col("QUANTITE")), "ID_SO": F.when(F.col("ID_SO") != 2, F.col("ID_SO"))}
    return clean.valid_sales(sales(spark, d).withColumns(holes)).groupBy(*K).agg(F.count("*").alias("n"), F.sum("QUANTITE").alias("q"))


@query
def p4_usable_target(spark, d):
    rows = sales(spark, d).withColumn("QUANTITE", F.col("QUANTITE") - 30)
    train, clipped = (clean.usable_target(rows, clip).select(*K, F.lit(clip).alias("clip"), "QUANTITE") for clip in (False, True))
    of = lambda clip: F.col("clip") if clip else ~F.col("clip")
    return train.unionByName(clipped).groupBy(*K).agg(*[x for clip, name in ((False, "train"), (True, "clip")) for x in (F.count_if(of(clip)).alias(f"n_{name}"), F.sum(F.when(of(clip), F.col("QUANTITE"))).alias(f"q_{name}"))])


@query
def p5_fill_or_drop_nulls(spark, d):
    rows, cols = dense(spark, d), ["PARAM_PRIX", "PARAM_PROMO_1"]
    full, some = clean.fill_or_drop_nulls(rows, cols), clean.fill_or_drop_nulls(rows, cols, drop=True)
    kept = some.groupBy(*K).agg(F.count("*").alias("n_drop"))
    return full.groupBy(*K).agg(F.count("PARAM_PRIX").alias("n_fill"), F.round(F.sum("PARAM_PROMO_1"), 6).alias("s")).join(kept, K)


@query
def p7_drop_uninformative(spark, d):
    """Names of the columns that stay."""
    cols = ["QUANTITE", "PARAM_PRIX", "PARAM_RARE", "PARAM_STOCK"]
    rows = dense(spark, d).select(*K, "QUANTITE", "PARAM_PRIX", F.when(F.dayofmonth("date") == 1, F.col("PARAM_PRIX")).alias("PARAM_RARE"), F.lit(1.0).alias("PARAM_STOCK"))
    left = [c for c in clean.drop_uninformative(rows, cols).columns if c in cols]
    return spark.createDataFrame([(c,) for c in left], "colonne string")


@query
def p6_numeric_columns(spark, d):
    """The number columns of two tables without their keys, with their rows."""
    out = None
    for name, keys in (("lineitem", ("l_orderkey", "l_partkey", "l_suppkey")), ("part", ("p_partkey",))):
        rows = spark.read.parquet(f"{d}/{name}.parquet")
        found = F.explode(F.array(*[F.lit(c) for c in clean.numeric_columns(rows, keys)]))
        own = rows.select(found.alias("colonne")).groupBy("colonne").agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "colonne", "n")
        out = own if out is None else out.unionByName(own)
    return out


@query
def p9_narrow_types(spark, d):
    """The types that columns are narrowed to, and their extremes after that."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("QUANTITE"), F.col("l_orderkey").cast("long").alias("cle"), (F.col("l_orderkey").cast("long") * 1000003 * 1000).alias("large"))
    narrow = clean.narrow_types(rows)
    extremes = [F.struct(F.lit(c).alias("colonne"), F.lit(t).alias("type"), F.min(c).cast("double").alias("a"), F.max(c).cast("double").alias("b")) for c, t in narrow.dtypes]
    return narrow.agg(F.array(*extremes).alias("x")).select(F.inline("x"))


@query
def p17_exogenous(spark, d):
    """Totals of the parameters without the target."""
    rows = sales(spark, d)
    names = clean.split_numeric_exogenous([c for c in clean.numeric_columns(rows, ("ID_SO",))])
    return rows.agg(F.array(*[F.struct(F.lit(c).alias("colonne"), F.round(F.sum(c), 2).alias("total")) for c in names]).alias("x")).select(F.inline("x"))


@query
def t2_top_features(spark, d):
    """The three features of the highest correlation with demand, either way; as in SQL, an undefined one ranks first."""
    rows = ft.build_features(sales(spark, d))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.abs(metrics.correlation("QUANTITE", f)), 5).alias("importance")) for f in FEATURES])
    return metrics.top_features(rows.agg(each.alias("x")).select(F.inline("x")), 3)


@query
def p10_align_features(spark, d):
    return clean.align_features(sales(spark, d), ["PARAM_ABSENT", "PARAM_PROMO_1"])


@query
def p12_feature_role(spark, d):
    """How many rows each of some features takes part in, by the role that its name has."""
    roles = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(feature_role(f)).alias("role")) for f in ROLES])
    return sales(spark, d).select(F.explode(roles).alias("x")).groupBy("x.feature", "x.role").agg(F.count("*").alias("n"))


@query
def p13_normalize_feature_name(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("nom"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("PARAM_"), F.lower("p_type"))).otherwise(F.lower("p_type")).alias("x"))
    return rows.groupBy("nom", clean.normalize_feature_name(F.col("x")).alias("feature")).agg(F.count("*").alias("n"))


def _by_year(x):
    return elasticity.demand_curve(x) * (1 + 0.02 * (x["PARAM_ANNEE"] - 1990))


@query
def e5_calendar_unit(spark, d):
    rows = curve(spark, d).withColumn("PARAM_ANNEE", F.year("date").cast("double"))
    return elasticity.perturb(rows, "PARAM_ANNEE", "cal_unit", _by_year, [*NAMES, "PARAM_ANNEE"])


@query
def e0_observations(spark, d):
    return elasticity.observations(sales(spark, d), "tabular", ["PARAM_PRIX", "mois", "PARAM_ABSENT"])


@query
def e7_elasticities_of_model(spark, d):
    """Elasticities of a fitted model: of the tabular observations, by a model of the history before them."""
    seen = elasticity.observations(sales(spark, d), "tabular", FEATURES)
    model = models.fit_model(_modelled(spark, d).filter("split = 'train'"), FEATURES)
    return elasticity.elasticities(seen, FEATURES, model, FEATURES)


@query
def a10_first_nomenclature(spark, d):
    return clean.first_nomenclature(sales(spark, d).withColumn("ID_NOMENCLATURE", F.when(F.dayofmonth("date") % 3 == 0, F.month("date"))))


@query
def a27_benchmark_summary(spark, d):
    rows = naive(spark, d).withColumn("p1", F.lag("QUANTITE", 1).over(windows.by_date())).na.drop(subset=["p", "p1"])
    error = lambda p: F.round(F.avg(F.abs(F.col(p) - F.col("QUANTITE"))), 4)
    both = rows.groupBy(*K).agg(error("p").alias("MAE_perprod"), F.when(F.col("ID_SO") != 3, error("p1")).alias("MAE_global"))
    return metrics.benchmark_summary(both).withColumn("delta_moyen", F.round("delta_moyen", 5).cast("double"))


@query
def a29_latest_training(spark, d):
    rows = sales(spark, d).select(F.col("ID_PRODUIT").alias("id_produit"), F.col("ID_SO").alias("id_so"), F.trunc("date", "month").alias("date_entrainement"), F.when(F.weekday("date") == 0, "lundi").otherwise("autre").alias("model_name"), "QUANTITE")
    log = rows.groupBy("id_produit", "id_so", "date_entrainement", "model_name").agg(F.round(F.stddev_pop("QUANTITE"), 6).alias("rmse_train"))
    return clean.latest_training(log, best=True)


@query
def t8_compare_elasticities(spark, d):
    ols = lambda rows, f: elasticity.ols_elasticity(rows, f, plain=True).withColumn("feature", F.lit(f))
    rows = sales(spark, d)
    both = ols(rows, "PARAM_PRIX").unionByName(ols(rows, "PARAM_PROMO_1"))
    return metrics.compare_elasticities({"ols": both, "promo": ols(rows.filter("PARAM_PROMO_1 > 0"), "PARAM_PRIX")})


@query
def w20_unscale_series(spark, d):
    rows = sales(spark, d)
    scaled = windows.scale_series(rows, "QUANTITE").drop("QUANTITE")
    return windows.unscale_series(scaled, rows, "QUANTITE", "QUANTITE_scaled").select(*K, "date", *r(6, "QUANTITE"))


@query
def w21_holdout_slice(spark, d):
    out = windows.holdout_slice(windows.direct_samples(dense(spark, d), ["PARAM_PROMO_1"]))
    return out.select(*K, "_origin_date", "_target_date", "horizon", "y")


@query
def s14_forecast_json(spark, d):
    return text.forecast_json(sales(spark, d).filter("year(date) = 1999"), "QUANTITE")


@query
def m13_boosted_early_stop(spark, d):
    rows = _modelled(spark, d)
    train = rows.filter("split = 'train'")
    train = windows.split_with_purge(train.drop("split"), days=10).withColumn("_hold", F.col("split") == "test")
    model, _ = models.fit_boosted_early_stop(train, FEATURES, "_hold")
    return models.predict(model, rows.filter("split = 'test'")).select(*K, "date", "QUANTITE", "prediction")


@query
def m18_fitted_vs_future(spark, d):
    rows = _modelled(spark, d)
    past, future = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return models.fitted_vs_future(models.fit_model(past, FEATURES), past, future).select(*K, "date", "kind", "prediction")


@query
def s1_kv_text(spark, d):
    """Sales written as key-value lines and read again."""
    rows, path = sales(spark, d), new_folder(spark, "kv")
    text.write_kv_text(rows, text.to_kv_line(rows, [*K, "QUANTITE", "PARAM_PROMO_1"]), path)
    kv = F.col("kv")
    return text.read_kv_text(spark, path).groupBy(kv["ID_PRODUIT"].alias("ID_PRODUIT"), kv["ID_SO"].cast("int").alias("ID_SO")).agg(F.count("*").alias("n"), F.sum(kv["QUANTITE"].cast("double")).alias("q"), F.round(F.sum(kv["PARAM_PROMO_1"].cast("double")), 4).alias("s"))


@query
def s3_nomenclature(spark, d):
    """Numbers in the names that archives of parts would have."""
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("/x/data_CENTRALE_"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") % 7).cast("string"), F.lit(".zip")).alias("f"))
    return names.groupBy(text.nomenclature(F.col("f")).alias("nomenclature"), text.file_number(F.col("f")).alias("fichier")).agg(F.count("*").alias("n"))


@query
def t3_first_files(spark, d):
    """The first three archives by name, one for each nomenclature."""
    path = new_folder(spark, "archives")
    rows = sales(spark, d).withColumn("ID_NOMENCLATURE", F.col("ID_SO") * 100 + 7)
    text.write_kv_archives(rows, text.to_kv_line(rows, [*K, "QUANTITE"]), path).count()
    return text.read_kv_archives(spark, path, max_files=3).groupBy("ID_NOMENCLATURE").agg(F.count("*").alias("n"))


@query
def s4_semicolon_csv(spark, d):
    """Sales written as CSV and read again."""
    path = new_folder(spark, "csv")
    text.write_semicolon_csv(sales(spark, d).select(*K, "date", "QUANTITE"), path)
    return text.read_semicolon_csv(spark, path, "ID_PRODUIT string, ID_SO int, date date, QUANTITE double")


@query
def s5_series_class(spark, d):
    """Couples of part and supplier with a class by their number of lines, written as CSV and read as a class file."""
    path = new_folder(spark, "classes")
    couples = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("ID_PRODUIT"), F.col("l_suppkey").alias("ID_SO")).count()
    text.write_semicolon_csv(couples.select(*K, F.when(F.col("count") >= 8, "smooth").otherwise("lumpy").alias("classification")), path)
    return text.read_series_class(spark, path)


@query
def s7_by_class(spark, d):
    """The statistics report written in a folder for each class and read again."""
    path = new_folder(spark, "by-class")
    text.write_by_class(demand.sales_stats_report(dense(spark, d)).withColumnRenamed("profil_demande", "sb_class"), path)
    return spark.read.parquet(path).select(*K, "sb_class", "nb_records", "somme")


@query
def s8_sample_cache(spark, d):
    """Rows cached by class and split; the second call must find them."""
    path = new_folder(spark, "samples")
    build = lambda: sales(spark, d).select(*K, "QUANTITE", F.when(F.col("QUANTITE") > 50, "erratic").otherwise("smooth").alias("sb_class"), F.when(F.year("date") >= 1998, 1).otherwise(0).alias("is_test"))
    text.sample_cache(spark, path, build)
    again = text.sample_cache(spark, path, lambda: build().limit(0))
    return again.groupBy("sb_class", "is_test").agg(F.count("*").alias("n"), F.sum("QUANTITE").alias("q"))


@query
def s11_kv_by_nomenclature(spark, d):
    """The index of couples by nomenclature, with the lines that the files hold of each."""
    rows, path = sales(spark, d).withColumn("ID_NOMENCLATURE", F.when(F.col("ID_SO") != 2, F.col("ID_SO") * 100)), new_folder(spark, "kv-nomenclature")
    index = text.write_kv_by_nomenclature(rows, text.to_kv_line(rows, [*K, "QUANTITE"]), path)
    kv = F.col("kv")
    held = text.read_kv_text(spark, f"{path}/*").groupBy(kv["ID_PRODUIT"].alias("ID_PRODUIT"), kv["ID_SO"].cast("int").alias("ID_SO")).agg(F.count("*").alias("n"))
    return index.join(held, K)


@query
def s13_payloads(spark, d):
    """Requests of couples of part and supplier, written as JSON and read as history rows; negative quantities become 0."""
    path = new_folder(spark, "payloads")
    day = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("ID_PRODUIT"), F.col("l_suppkey").alias("ID_SO"), F.col("l_shipdate").cast("date").alias("date")).agg((F.sum("l_quantity") - 20).alias("q"))
    lists = day.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("date", F.col("q").cast("string").alias("q")))).alias("rows"))
    histo = F.transform("rows.date", lambda x: F.create_map(F.lit("DATE_IMPORT"), F.date_format(x, "dd/MM/yyyy")))
    lists.select(*K, histo.alias("LIST_HISTO"), F.col("rows.q").alias("LIST_QUANTITE")).write.json(path)
    return text.read_payloads(spark, path).select(*K, "date", "QUANTITE")


@query
def s16_run_metadata(spark, d):
    """One JSON object for each class of the history, written and read as a table."""
    path, rows = new_folder(spark, "metadata"), dense(spark, d)
    counts = demand.sales_stats_report(rows).groupBy("profil_demande").agg(F.count("*").alias("n"), F.sum("nb_records").alias("lignes"))
    text.write_run_metadata(counts, NAMES, {"depth": 4}, rows, path)
    schema = "profil_demande string, n long, lignes long, date_min date, date_max date, features array<string>, params string"
    return text.read_json_table(spark, path, schema).select("profil_demande", "n", "lignes", "date_min", "date_max", F.array_join("features", ",").alias("features"), "params")


@query
def p11_select_sales_columns(spark, d):
    return clean.select_sales_columns(sales(spark, d), [*K, "date", "PARAM_ABSENT", "QUANTITE"])


@query
def r2_stream_class_updates(spark, d):
    """Sales that arrive file by file: statistics and class of each couple after the last batch."""
    into, out = new_folder(spark, "stream-in"), new_folder(spark, "stream-out")
    rows = dense(spark, d).select(*K, "date", "QUANTITE")
    rows.repartition(6, "date").write.parquet(into)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(into)
    stats.stream_class_updates(stream, out, new_folder(spark, "stream-state"), "1990-01-01").awaitTermination()
    return read_current(spark, out, K).select(*K, "profil_demande", "n", "somme", "carres", "somme_nz", "n_nz", "nb_jours_obs", "nb_jours_demand")


def _raw(spark, d):
    """Lines of a history as they come in, with holes: some days that do not exist, stores and products that are missing."""
    rows, n = sales(spark, d), F.dayofyear("date")
    return rows.select(
        F.when(n % 11 != 0, F.col("ID_PRODUIT")).alias("ID_PRODUIT"), F.when((n % 7 != 0) | (F.col("ID_SO") != 2), F.col("ID_SO")).alias("ID_SO"),
        (F.year("date") + 20).cast("string").alias("PARAM_ANNEE"), F.month("date").cast("string").alias("PARAM_MOIS"), (F.dayofmonth("date") + F.col("ID_SO") % 4).cast("string").alias("PARAM_JOUR"), F.when(n % 13 != 0, F.col("QUANTITE")).alias("QUANTITE"),
    )


@query
def a6_counted_ingest(spark, d):
    """What an ingest keeps, and its counters, taken in the pass that writes the rows."""
    counters = Observation("ingest")
    kept = durable(clean.counted_ingest(_raw(spark, d), counters, days=1100), "ingest")
    counted = [F.lit(n).alias(c) for c, n in counters.get.items()]
    return kept.agg(F.count("*").alias("gardees"), F.count_distinct("ID_PRODUIT").alias("produits"), F.count_distinct(*K).alias("couples"), F.min("date").alias("date_min"), F.max("date").alias("date_max")).select(*counted, "gardees", "produits", "couples", "date_min", "date_max")


@query
def r3_stream_ingest(spark, d):
    """The same counters from a stream of files, summed over its batches, and what it kept of each couple."""
    into, out = new_folder(spark, "raw-in"), new_folder(spark, "raw-out")
    raw = _raw(spark, d)
    raw.repartition(5, "PARAM_JOUR").write.parquet(into)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(into)
    run = stats.stream_ingest(stream, out, new_folder(spark, "raw-state"), days=1100)
    run.awaitTermination()
    counted = [F.lit(n).alias(c) for c, n in stats.ingest_counts(run).items()]
    return spark.read.parquet(out).groupBy(*K).agg(F.count("*").alias("gardees"), F.count("date").alias("datees")).select(*K, "gardees", "datees", *counted)


@query
def s2_kv_archives(spark, d):
    """Sales zipped by nomenclature, two archives each, and read again; the numbers come from the archives' names."""
    path = new_folder(spark, "archives")
    rows = sales(spark, d).withColumn("ID_NOMENCLATURE", F.col("ID_SO") * 100 + 7)
    text.write_kv_archives(rows, text.to_kv_line(rows, [*K, "QUANTITE", "PARAM_PROMO_1"]), path, parts=2).count()
    kv = F.col("kv")
    return text.read_kv_archives(spark, path).groupBy("ID_NOMENCLATURE", kv["ID_PRODUIT"].alias("ID_PRODUIT"), kv["ID_SO"].cast("int").alias("ID_SO")).agg(F.count("*").alias("n"), F.sum(kv["QUANTITE"].cast("double")).alias("q"))


@query
def r3_stream_daily_demand(spark, d):
    """Daily totals that the watermark has closed."""
    into, out = new_folder(spark, "events-in"), new_folder(spark, "events-out")
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "user_id", "value")
    events.write.parquet(into)
    daily = stats.stream_daily_demand(spark.readStream.schema(events.schema).parquet(into))
    daily = daily.select(F.col("window.start").cast("date").alias("day"), "event_type", "user_id", "total", "n")
    daily.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, "events-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(daily.schema).parquet(out).withColumn("total", F.round("total", 4))


@query
def r4_stream_score(spark, d):
    """Rows of the last year, scored as they arrive by a line on the price that the years before fitted."""
    rows = sales(spark, d).select(*K, "date", "QUANTITE", "PARAM_PRIX")
    model = Pipeline(stages=[models.assemble(["PARAM_PRIX"]), LinearRegression(labelCol="QUANTITE", solver="normal")]).fit(rows.filter("year(date) < 1998"))
    into, out = new_folder(spark, "score-in"), new_folder(spark, "score-out")
    rows.filter("year(date) >= 1998").write.parquet(into)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(into)
    stats.stream_score(stream, model, out, new_folder(spark, "score-state")).awaitTermination()
    return spark.read.parquet(out).select(*K, "date", F.round("prediction", 4).alias("prediction"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
