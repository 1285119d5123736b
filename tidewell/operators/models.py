"""Demand models with Spark ML, and per-series fits."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.errors import IllegalArgumentException
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.folders import durable
from tidewell.operators.elasticity import with_predictions
from tidewell.operators.least_squares import fit_least_squares, linear_scorer, ols_elasticities
from tidewell.operators.metrics import forecast_metrics, volume_accuracy
from tidewell.operators.totals import perturb_single
from tidewell.operators.windows import by_date, direct_samples, expanding_folds, split_aligned, split_fraction
from tidewell.schema import K

#: About so many rows are shuffled among themselves.
SHUFFLE_ROWS = 100_000
#: Candidates of a search that are fitted at the same time.
FITS_AT_ONCE = 4
#: What a search draws from, for each learner.
SPACE = {
    "tweedie": {"variancePower": [round(1.05 + 0.05 * i, 2) for i in range(19)], "regParam": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]},
    "boosted": {"maxDepth": [3, 4, 5, 6, 7], "minInstancesPerNode": [50, 100, 200, 350, 500], "stepSize": [0.01, 0.02, 0.03, 0.05, 0.1], "subsamplingRate": [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]},
}
#: What a grid search tries for each learner, and what is taken where it fails.
GRIDS = {
    "tweedie": [{"variancePower": v, "regParam": r} for v in (1.2, 1.5, 1.8) for r in (0.01, 0.1, 1.0)],
    "boosted": [{"maxDepth": d, "minInstancesPerNode": n} for d in (3, 5, 7) for n in (6, 7, 8, 9)],
}
FALLBACK = {"tweedie": {"variancePower": 1.5, "regParam": 0.1}, "boosted": {"maxDepth": 3, "minInstancesPerNode": 6}}


def settled(df: DataFrame) -> DataFrame:
    """Rows that fits visit again and again: written once, and kept in as few partitions as their size asks for.

    A tree visits all partitions once for each level and every task answers the driver, so the
    partitions that a shuffle leaves would cost more than the rows.
    """
    return durable(df, "settled").persist()


def assemble(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def regressor(kind: str, label: str = "QUANTITE", **params):
    """tweedie, boosted or forest; parameters of the estimator may be given."""
    if kind == "tweedie":
        return GeneralizedLinearRegression(**{"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0, "labelCol": label, "maxIter": 15, "regParam": 0.01} | params)
    if kind == "boosted":
        return GBTRegressor(**{"labelCol": label, "maxIter": 10, "maxDepth": 4, "seed": 42} | params)
    return RandomForestRegressor(**{"labelCol": label, "numTrees": 20, "maxDepth": 6, "seed": 42} | params)


def fit_model(train: DataFrame, features: list[str], kind: str = "tweedie", label: str = "QUANTITE", **params) -> PipelineModel:
    return Pipeline(stages=[assemble(features), regressor(kind, label, **params)]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


def fit_by_class(df: DataFrame, features: list[str], classes: list[str], kind: str = "tweedie", least: int = 100) -> dict[str, PipelineModel]:
    """One model for each demand class with enough rows."""
    counts = {r["sb_class"]: r["count"] for r in df.groupBy("sb_class").count().collect()}
    return {c: fit_model(df.filter(F.col("sb_class") == c), features, kind) for c in classes if counts.get(c, 0) >= least}


def predict_by_class(fitted: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Rows of each class predicted by its own model; classes without a model give no rows."""
    none = df.filter("false").withColumn("prediction", F.lit(0.0))
    parts = [predict(m, df.filter(F.col("sb_class") == c)).select(none.columns) for c, m in fitted.items()]
    return reduce(DataFrame.unionByName, parts, none)


def draw_params(space: dict[str, list], n: int = 15, seed: int = 42) -> list[dict]:
    """n different points of the space, or all of a smaller one, in seeded random order."""
    points = [dict(zip(sorted(space), p)) for p in itertools.product(*[space[k] for k in sorted(space)])]
    return random.Random(seed).sample(points, min(n, len(points)))


def search_params(train: DataFrame, holdout: DataFrame, features: list[str], space: dict[str, list], n: int = 15, seed: int = 42, kind: str = "boosted", label: str = "QUANTITE") -> tuple[dict, float]:
    """Seeded random search: the parameters of the least error on the holdout, the first drawn of equal ones.

    A candidate whose fit diverges counts with an infinite error.
    """
    measure = RegressionEvaluator(labelCol=label, metricName="mae")
    train, holdout = (settled(x.select(label, *features)) for x in (train, holdout))

    def error(params: dict) -> float:
        try:
            found = measure.evaluate(predict(fit_model(train, features, kind, label, **params), holdout))
        except Py4JJavaError:
            if kind != "tweedie":  # only the Tweedie iterations can diverge
                raise
            return float("inf")
        return found if found == found else float("inf")

    drawn = draw_params(space, n, seed)
    with ThreadPool(FITS_AT_ONCE) as pool:
        errors = pool.map(inheritable_thread_target(train.sparkSession)(error), drawn, chunksize=1)
    for x in (train, holdout):
        x.unpersist()
    best = min(range(len(drawn)), key=lambda i: errors[i])
    if errors[best] == float("inf"):
        raise ValueError("no candidate has a finite error")
    return drawn[best], errors[best]


def grid_errors(df: DataFrame, features: list[str], grid: list[dict], k: int = 3, kind: str = "boosted") -> list[float]:
    """Mean error over k expanding folds of each point of the grid; infinite where a fit fails or no fold has rows to test."""
    folds = settled(expanding_folds(df, k).select("fold", "role", "QUANTITE", *features))
    measure = RegressionEvaluator(labelCol="QUANTITE", metricName="mae")

    def error(at: tuple[int, int]) -> float:
        part = folds.filter(F.col("fold") == at[1])
        try:
            found = measure.evaluate(predict(fit_model(part.filter("role = 'train'"), features, kind, **grid[at[0]]), part.filter("role = 'test'")))
        except (Py4JJavaError, IllegalArgumentException):
            return float("inf")
        return found if found == found else float("inf")

    # the largest folds and the last points, often the dearest, come first: then no long fit is left over at the end
    each = [(i, fold) for fold in range(k, 0, -1) for i in reversed(range(len(grid)))]
    with ThreadPool(FITS_AT_ONCE) as pool:
        errors = dict(zip(each, pool.map(inheritable_thread_target(df.sparkSession)(error), each, chunksize=1)))
    folds.unpersist()
    return [sum(errors[i, fold] for fold in range(1, k + 1)) / k for i in range(len(grid))]


def grid_search_time_cv(df: DataFrame, features: list[str], grid: list[dict], k: int = 3, kind: str = "boosted", fallback: dict | None = None) -> dict:
    """The parameters of the least mean error over expanding folds, the first of equal ones.

    Where no point of the grid has an error, ``fallback`` is taken; without one the search fails.
    """
    errors = grid_errors(df, features, grid, k, kind)
    best = min(range(len(grid)), key=lambda i: errors[i])
    if errors[best] == float("inf"):
        if fallback is None:
            raise ValueError("no point of the grid could be fitted")
        return fallback
    return grid[best]


def rolling_backtest(model: PipelineModel, df: DataFrame, horizon: int, stride: int, covariates: list[str]) -> DataFrame:
    """Forecasts, by a direct model that is not fitted again, of the ``horizon``-th row after every ``stride``-th origin."""
    return predict(model, direct_samples(df, covariates, [horizon], stride))


def choose_model(df: DataFrame, features: list[str], kinds: tuple[str, ...] = ("boosted", "tweedie"), k: int = 3) -> tuple[str, PipelineModel, DataFrame]:
    """The learner of the lowest wMAPE on the last rows of each couple, fitted again on all rows, and a report.

    The rows are split once (``split_fraction``); each learner is tuned on the training part by
    ``grid_search_time_cv`` over GRIDS, so that no test row is seen before the errors are taken.  The
    report has a row for each learner: wmape, its accuracy, mae, rmse, volume_error with its
    accuracy, params (JSON) and whether it was chosen; of equal errors the first learner is.
    """
    rows = settled(split_fraction(df).select(*K, "date", "QUANTITE", "is_test", *features))
    train, test = rows.filter("not is_test"), rows.filter("is_test")
    params = {kind: grid_search_time_cv(train, features, GRIDS[kind], k, kind, FALLBACK[kind]) for kind in kinds}
    found = {}
    for kind in kinds:
        tested = predict(fit_model(train, features, kind, **params[kind]), test).select("QUANTITE", "prediction")
        found[kind] = volume_accuracy(tested, "QUANTITE", "prediction", []).crossJoin(forecast_metrics(tested, "QUANTITE", "prediction")).first()
    best = min(kinds, key=lambda kind: found[kind]["wmape"])
    model = fit_model(rows, features, best, **params[best])
    rows.unpersist()
    columns = ["wmape", "accuracy", "mae", "rmse", "volume_error", "volume_accuracy"]
    report = [(kind, *[found[kind][c] for c in columns], json.dumps(params[kind], sort_keys=True), kind == best) for kind in kinds]
    return best, model, df.sparkSession.createDataFrame(report, f"modele string, {', '.join(f'{c} double' for c in columns)}, params string, choisi boolean")


def feature_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    total = values.sum() or 1.0
    return sorted(zip(features, (values / total).tolist()), key=lambda x: -x[1])


def with_partner(df: DataFrame, cols: list[str], seed: int = 42, bucket: int = SHUFFLE_ROWS) -> DataFrame:
    """Every row with _other, ``cols`` of another row: the rows of a hash bucket over all couples, in hashed order, form a ring.

    Buckets hold about ``bucket`` rows, so no task gets all; only a bucket of one row keeps its own values.
    """
    key = F.xxhash64(F.lit(seed), *sorted(df.columns))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(max(df.count() // bucket, 1))))
    ring = Window.partitionBy("_bucket").orderBy(key, *sorted(df.drop("_bucket").columns))
    other = F.struct(*cols)
    return df.withColumn("_other", F.coalesce(F.lead(other).over(ring), F.first(other).over(ring))).drop("_bucket")


def permutation_importance(df: DataFrame, model: PipelineModel, features: list[str], label: str = "QUANTITE") -> list[tuple[str, float]]:
    """Rise of the mean error when a column takes the value of another row, of any couple."""
    measure = RegressionEvaluator(labelCol=label, metricName="mae")
    rows = with_partner(df.select(*K, "date", label, *features), features).persist()
    base = measure.evaluate(predict(model, rows))
    rises = [(f, measure.evaluate(predict(model, rows.withColumn(f, F.col(f"_other.{f}")))) - base) for f in features]
    rows.unpersist()
    return rises


def fit_per_series(df: DataFrame, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One fit for each couple; a series has one row for each day, which bounds a group."""
    return df.groupBy(*K).applyInPandas(fit, schema)


def ridge_fit(features: list[str], alpha: float = 1e-3) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per-series least squares with an intercept; constant features get no weight."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[features].to_numpy(float), pdf["QUANTITE"].to_numpy(float)
        x = np.nan_to_num(x)
        spread = x.std(axis=0)
        used = spread > 1e-9
        z = (x[:, used] - x[:, used].mean(axis=0)) / spread[used]
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) if used.any() else np.zeros(0)
        weights = np.zeros(len(features))
        weights[used] = beta / spread[used]
        rows = [*zip(features, weights), ("intercept", y.mean() - weights @ x.mean(axis=0))]
        return pd.DataFrame([(pdf["ID_PRODUIT"].iloc[0], pdf["ID_SO"].iloc[0], f, float(w)) for f, w in rows], columns=[*K, "feature", "weight"])

    return fit


def with_ar(df: DataFrame) -> DataFrame:
    """Lag and time index of an autoregressive model with exogenous columns."""
    return df.withColumns({"ar_1": F.coalesce(F.lag("QUANTITE", 1).over(by_date()), F.lit(0.0)), "t": F.row_number().over(by_date()).cast("double")})


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of the least error before ``patience`` rounds pass without a lower one, and whether they did."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def cut_rounds(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first rounds only."""
    java, sc = model._java_obj, SparkSession.active().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    cut = GBTRegressionModel(sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, trees, weights, model.numFeatures))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def fit_boosted_early_stop(df: DataFrame, features: list[str], held: str, loss: str = "squared", rounds: int = 100, patience: int = 20, **params) -> tuple[PipelineModel, list[float]]:
    """Boosting that stops when ``patience`` rounds bring no lower error of the rows marked by ``held``; loss squared or absolute.

    Returns the model cut to its best round and the error after each round.  The rounds grow by
    doubling from twice the patience, as a fit cannot be carried on: less than twice the rounds in all.
    """
    assembler = assemble(features)
    source = settled(df.select("QUANTITE", held, *features))
    rows = assembler.transform(source).persist()
    train, hold, n = rows.filter(~F.col(held)), rows.filter(F.col(held)), 2 * patience
    while True:
        learner = GBTRegressor(**{"labelCol": "QUANTITE", "maxDepth": 4, "seed": 42} | params).setMaxIter(min(n, rounds)).setLossType(loss)
        model = learner.fit(train)
        errors = list(model.evaluateEachIteration(hold, loss))
        best, stopped = best_round(errors, patience)
        if stopped or n >= rounds:
            break
        n *= 2
    rows.unpersist()
    source.unpersist()
    return PipelineModel([assembler, cut_rounds(model, best)]), errors


def fitted_vs_future(model: PipelineModel, history: DataFrame, future: DataFrame) -> DataFrame:
    """Predictions of the history (kind QUANTITE_AJUSTE) and of the future (QUANTITE_0), the columns that both have."""
    both = [c for c in history.columns if c in future.columns]
    rows = history.select(*both, F.lit("QUANTITE_AJUSTE").alias("kind")).unionByName(future.select(*both, F.lit("QUANTITE_0").alias("kind")))
    return predict(model, rows)


def refit_from_params(df: DataFrame, stored: str, kind: str = "boosted") -> PipelineModel:
    """Fit again from a stored JSON object with features and params."""
    known = json.loads(stored)
    return fit_model(df, known["features"], kind, **known.get("params", {}))


def signed_importance(df: DataFrame, model: PipelineModel, features: list[str], label: str = "QUANTITE") -> list[tuple[str, float]]:
    """Normalised importance in % with the sign of the feature's least-squares elasticity."""
    line = Pipeline(stages=[assemble(features), LinearRegression(labelCol=label)]).fit(df).stages[-1].coefficients.toArray()
    means = df.agg(*[F.avg(f).alias(f"_{i}") for i, f in enumerate(features)], F.avg(label).alias("_y")).first()
    sign = {f: np.sign(line[i] * means[f"_{i}"] * means["_y"]) for i, f in enumerate(features)}
    return [(f, round(100 * v * float(sign[f]), 2)) for f, v in feature_importance(model, features)]


def compare_with_global(df: DataFrame, couples: DataFrame, features: list[str], scorer, names: list[str] | None = None, price: str = "PARAM_PRIX", promo: str = "PARAM_PROMO_1", alpha: float = 1e-3, plain: bool = False) -> DataFrame:
    """Each picked couple's own linear model against one model of all couples, and three kinds of elasticities.

    Both are measured on the couple's last 30 days (``split_aligned``); the own model is fitted on its
    rows before, the global ``scorer`` (a column expression or a fitted model of the columns
    ``names``) comes from outside.  Elasticities of price and promotion, in %: by least squares of all
    rows (ols), by perturbing the own model on all rows (pert_pp) and the global one on the
    last 90 days (global; on all rows where these are fewer than 30).  A couple with fewer than five
    test rows has no error of the global model.  Weights stand beside the rows, so every method
    is a projection and an aggregate by couple.  ``plain`` is that of the fits and perturbations.
    """
    names = names or features
    rows = split_aligned(df.join(couples.select(*K), K, "left_semi"))
    own = fit_least_squares(rows.filter("is_train"), features, alpha, plain=plain)
    beside = rows.join(own.select(*K, "w"), K)
    scored = with_predictions(with_predictions(beside, {"_own": {}}, linear_scorer(features), features), {"_global": {}}, scorer, names)
    test, y = F.col("is_test"), F.col("QUANTITE")
    mae = lambda p: F.round(F.avg(F.when(test, F.abs(F.col(p) - y))), 4)
    rmse = lambda p: F.round(F.sqrt(F.avg(F.when(test, (F.col(p) - y) * (F.col(p) - y)))), 4)
    errors = scored.groupBy(*K).agg(F.count_if(F.col("is_train")).alias("n_train"), F.count_if(test).alias("n_test"), mae("_own").alias("MAE_perprod"), mae("_global").alias("MAE_global"), rmse("_own").alias("RMSE_perprod"), rmse("_global").alias("RMSE_global"))
    enough = F.col("n_test") >= 5
    errors = errors.withColumns({c: F.when(enough, F.col(c)) for c in ("MAE_global", "RMSE_global")}).withColumn("delta_MAE", F.round(F.col("MAE_perprod") - F.col("MAE_global"), 4))
    late = F.col("date") > F.date_sub(F.max("date").over(Window.partitionBy(*K)), 90)
    recent = beside.withColumn("_late", late).withColumn("_n", F.count_if("_late").over(Window.partitionBy(*K))).filter("_late or _n < 30").drop("_late", "_n")
    kept = [price, promo]
    methods = {"ols": ols_elasticities(rows, features, plain=plain), "pert_pp": perturb_single(beside, kept, linear_scorer(features), features, plain=plain), "global": perturb_single(recent, kept, scorer, names, constant_flags=True, plain=plain)}
    long = reduce(DataFrame.unionByName, [d.select(*K, "feature", "value", F.lit(m).alias("_method")) for m, d in methods.items()])
    pick = lambda f, m: F.max(F.when((F.col("feature") == f) & (F.col("_method") == m), F.col("value")))
    wide = long.groupBy(*K).agg(*[pick(f, m).alias(f"ELAST_{label}_{m}") for label, f in (("PRIX", price), ("PROMO", promo)) for m in methods])
    return errors.join(wide, K, "left")
