import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewell.operators import elasticity, least_squares, models, totals, windows

DAY = dt.date(2024, 1, 1)
FRAME = "ID_PRODUIT int, ID_SO int, date date, QUANTITE double, PARAM_PRIX double, PARAM_PROMO_1 double, PARAM_VACANCE double, dow double, y_origin_m1 double"
FEATURES = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE", "dow", "y_origin_m1"]


def history(spark, couples=4, n=80, seed=1):
    r, rows = np.random.default_rng(seed), []
    for p in range(couples):
        last = 0.0
        for i in range(n):
            price, promo, off = 10 + r.normal(), max(0.0, r.normal() * 0.2), float(i % 7 >= 5)
            y = max(0.0, 40 + (p - 1.5) * price + (p - 2) * 30 * promo + 3 * off + r.normal())
            rows.append((p, 1, DAY + dt.timedelta(i), y, price, promo, off, float(i % 7), last))
            last = y
    return spark.createDataFrame(rows, FRAME)


def test_least_squares_equals_numpy_on_every_couple(spark):
    df = history(spark)
    found = {r["ID_PRODUIT"]: r["w"] for r in least_squares.fit_least_squares(df, FEATURES).collect()}
    for p, own in df.toPandas().groupby("ID_PRODUIT"):
        x = np.column_stack([own[FEATURES], np.ones(len(own))])
        assert np.allclose(found[p], np.linalg.lstsq(x, own["QUANTITE"], rcond=None)[0], atol=1e-8)
    ridge = {r["ID_PRODUIT"]: r["w"] for r in least_squares.fit_least_squares(df, FEATURES, alpha=0.5).collect()}
    old = models.fit_per_series(df, models.ridge_fit(FEATURES, 0.5), "ID_PRODUIT int, ID_SO int, feature string, weight double").toPandas()
    for p, own in old.groupby("ID_PRODUIT"):
        assert np.allclose(ridge[p], own["weight"], atol=1e-8)


def test_least_squares_of_odd_columns(spark):
    """Constant, repeated and null columns, a couple of one row, rows without a target, a large offset."""
    df = history(spark, 1).withColumns({"same": F.lit(3.0), "twin": F.col("PARAM_PRIX"), "none": F.lit(None).cast("double"), "far": F.col("PARAM_PRIX") + 1e8})
    one = df.limit(1).withColumn("ID_PRODUIT", F.lit(9))
    lost = df.limit(5).withColumn("QUANTITE", F.lit(None).cast("double"))
    fitted = {r["ID_PRODUIT"]: r for r in least_squares.fit_least_squares(df.unionByName(one).unionByName(lost), ["PARAM_PRIX", "twin", "same", "none"]).collect()}
    slope = np.polyfit(df.toPandas()["PARAM_PRIX"], df.toPandas()["QUANTITE"], 1)
    assert fitted[0]["n"] == 80 and np.allclose(fitted[0]["w"], [slope[0] / 2, slope[0] / 2, 0, 0, slope[1]])
    assert fitted[9]["w"][:4] == [0, 0, 0, 0] and fitted[9]["w"][4] == fitted[9]["m"][4]
    assert np.isclose(least_squares.fit_least_squares(df, ["far"]).first()["w"][0], slope[0], rtol=1e-6)
    assert least_squares.fit_least_squares(df.limit(0), ["far"]).count() == 0


def test_plain_fits_are_undefined_for_couples_with_a_constant(spark):
    df = history(spark, 4).withColumn("PARAM_PROMO_1", F.when(F.col("ID_PRODUIT") != 3, F.col("PARAM_PROMO_1")).otherwise(0.0))
    for alpha in (0.0, 0.5):
        fits = [{r["ID_PRODUIT"]: r["w"] for r in least_squares.fit_least_squares(df, FEATURES, alpha, plain=plain).collect()} for plain in (False, True)]
        assert all(fits[0][p] == fits[1][p] for p in range(3)) and np.isfinite(fits[0][3]).all() and np.isnan(fits[1][3]).all()
    found = {(r["ID_PRODUIT"], r["feature"]): r["value"] for r in least_squares.ols_elasticities(df, FEATURES, plain=True).collect()}
    assert {f for (p, f), v in found.items() if v != v} == {"PARAM_PROMO_1", "PARAM_VACANCE", "y_origin_m1"}
    assert {p for (p, _), v in found.items() if v != v} == {3} and (3, "PARAM_PRIX") not in found


def test_constants_of_many_partitions_are_constant(spark):
    """Merged moments of a constant may differ from it by rounding."""
    df = spark.range(0, 49 * 60, 1, 60).select(F.lit(1).alias("ID_PRODUIT"), F.lit(1).alias("ID_SO"), (F.col("id") % 11).cast("double").alias("QUANTITE"), F.lit(3.3).alias("PARAM_PROMO_1"))
    assert np.isnan(least_squares.fit_least_squares(df, ["PARAM_PROMO_1"], plain=True).first()["w"]).all()
    assert elasticity.ols_elasticity(df, "PARAM_PROMO_1").count() == 0
    assert np.isnan(elasticity.ols_elasticity(df, "PARAM_PROMO_1", plain=True).first()["value"])
    assert elasticity.ols_elasticity(df.withColumnRenamed("PARAM_PROMO_1", "PARAM_PRIX"), "PARAM_PRIX", plain=True).count() == 0


def test_moments_need_no_series_in_one_task(spark):
    plan = least_squares.moments(history(spark), FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_covar_pop" in plan and "Window" not in plan


def test_elasticities_follow_signs_and_leave_zeros_out(spark):
    """Expected values follow the rules: PRIX above 0 and PROMO below 0 are zero, zeros and the calendar are left out."""
    df = history(spark)
    found = {(r["ID_PRODUIT"], r["feature"]): r["value"] for r in least_squares.ols_elasticities(df, FEATURES).collect()}
    wanted = {}
    for p, own in df.toPandas().groupby("ID_PRODUIT"):
        w = np.linalg.lstsq(np.column_stack([own[FEATURES], np.ones(len(own))]), own["QUANTITE"], rcond=None)[0]
        for f, b in zip(FEATURES, w):
            e = b * own[f].mean() / own["QUANTITE"].mean()
            if f != "dow" and not (f == "PARAM_PRIX" and e > 0) and not (f == "PARAM_PROMO_1" and e < 0) and abs(e) > 1e-8:
                wanted[p, f] = round(e * 100, 2)
    assert found == pytest.approx(wanted, abs=0.011)
    assert (3, "PARAM_PRIX") not in found and (0, "PARAM_PRIX") in found and (0, "PARAM_PROMO_1") not in found and (3, "PARAM_PROMO_1") in found
    single = elasticity.ols_elasticity(df, "PARAM_PROMO_1").collect()
    assert single and all(r["value"] > 0 for r in single) and {r["ID_PRODUIT"] for r in single} <= {1, 2, 3}


def test_shares_count_all_features_and_leave_the_calendar_out(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0, 10.0), (1, 1, 3.0, 6.0, 30.0)], "ID_PRODUIT int, ID_SO int, PARAM_PRIX double, y_origin_m7 double, mois double")
    out = {r["feature"]: r["share"] for r in elasticity.attribution_share(df, {"PARAM_PRIX": 1.0, "y_origin_m7": 0.5, "mois": 0.2}).collect()}
    assert out == {"PARAM_PRIX": 25.0, "y_origin_m7": 25.0}


def test_fitted_models_as_scorers_everywhere(spark):
    """Price and promotion scenarios, totals and single perturbations: a model gives what its line gives."""
    df = history(spark, 3, 60).withColumn("PARAM_JOUR_SEMAIN", F.col("dow"))
    names = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE", "PARAM_JOUR_SEMAIN"]
    model = Pipeline(stages=[models.assemble(names), LinearRegression(labelCol="QUANTITE")]).fit(df)
    w, b = model.stages[-1].coefficients, model.stages[-1].intercept
    line = lambda x: sum((float(v) * x[n] for n, v in zip(names, w)), F.lit(b))
    for run in (
        lambda f: elasticity.price_scenarios(df, [0.9, 1.1], f, names), lambda f: elasticity.price_scenarios(df, 5, f, names), lambda f: elasticity.promo_scenarios(df, [0.0, 0.3], f, names),
        lambda f: totals.series_elasticity(df, names, f, names), lambda f: totals.series_elasticity_1pct(df, names, f, names), lambda f: totals.perturb_single(df, names, f, names),
    ):
        rounded = [sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in run(f).collect()) for f in (model, line)]
        assert rounded[0] == rounded[1] and rounded[0]


def test_prices_from_lowest_to_highest_and_one_promotion(spark):
    df = history(spark, 1, 10)
    out = elasticity.price_scenarios(df, 5, lambda x: x["PARAM_PRIX"], ["PARAM_PRIX"]).groupBy("scenario").agg(F.avg("prediction").alias("p"))
    prices = df.toPandas()["PARAM_PRIX"]
    assert {r["scenario"]: r["p"] for r in out.collect()} == pytest.approx({f"PRIX_{i + 1}": prices.min() + i * (prices.max() - prices.min()) / 4 for i in range(5)})
    out = elasticity.promo_scenarios(df, [0.0, 0.05, 0.35], lambda x: 100 * x["PARAM_PROMO"], ["PARAM_PRIX"]).groupBy("scenario").agg(F.avg("prediction").alias("p"))
    assert {r["scenario"]: r["p"] for r in out.collect()} == pytest.approx({"PROMO_0": 0.0, "PROMO_5": 5.0, "PROMO_35": 35.0})


def test_aligned_split_falls_back_on_rows(spark):
    long, short = history(spark, 1, 80), history(spark, 1, 45).withColumn("ID_PRODUIT", F.lit(5))
    out = windows.split_aligned(long.unionByName(short)).groupBy("ID_PRODUIT").agg(F.count_if("is_test").alias("test"), F.count_if("is_train").alias("train")).collect()
    assert {r["ID_PRODUIT"]: (r["test"], r["train"]) for r in out} == {0: (30, 49), 5: (30, 15)}


def test_comparison_of_three_methods(spark):
    df, names = history(spark, 3), ["PARAM_PRIX", "PARAM_PROMO_1"]
    line = lambda x: 60 - 2 * x["PARAM_PRIX"] + 10 * x["PARAM_PROMO_1"]
    out = {r["ID_PRODUIT"]: r for r in models.compare_with_global(df, df.select("ID_PRODUIT", "ID_SO").distinct().filter("ID_PRODUIT < 2"), names, line, alpha=0.0).collect()}
    assert set(out) == {0, 1}
    for p, own in df.toPandas().query("ID_PRODUIT < 2").groupby("ID_PRODUIT"):
        own = own.sort_values("date")
        train, test = own.iloc[:49], own.iloc[50:]
        x = lambda d: np.column_stack([d[names], np.ones(len(d))])
        w = np.linalg.lstsq(x(train), train["QUANTITE"], rcond=None)[0]
        mine, every = np.maximum(x(test) @ w, 0), np.maximum(60 - 2 * test["PARAM_PRIX"] + 10 * test["PARAM_PROMO_1"], 0)
        r = out[p]
        assert (r["n_train"], r["n_test"]) == (49, 30)
        assert r["MAE_perprod"] == pytest.approx(np.abs(mine - test["QUANTITE"]).mean(), abs=1e-4) and r["RMSE_global"] == pytest.approx(np.sqrt(((every - test["QUANTITE"]) ** 2).mean()), abs=1e-4)
        assert r["delta_MAE"] == pytest.approx(r["MAE_perprod"] - r["MAE_global"], abs=1e-4)
        step, y = own["PARAM_PRIX"].mean() * 0.1, np.maximum(x(own) @ w, 0)
        up, down = (np.maximum(y + s * w[0] * step, 0) for s in (1, -1))
        assert r["ELAST_PRIX_pert_pp"] == pytest.approx(((up - down) / np.where(y > 1e-8, y, np.nan) / 0.2)[y > 1e-8].mean(), abs=0.011)
        assert r["ELAST_PROMO_global"] is not None and r["ELAST_PRIX_global"] < 0


def test_patience():
    assert models.best_round([5, 4, 3, 3, 3, 2], 3) == (6, False)
    assert models.best_round([5, 4, 3, 3, 3, 3, 1], 3) == (3, True)
    assert models.best_round([2.0], 20) == (1, False)


def test_boosting_stops_after_flat_rounds_and_keeps_the_best(spark):
    """Noise alone: the training error goes on falling, the held-back one does not."""
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(float(r.normal()), float(r.normal()), float(r.normal()), i % 3 == 0) for i in range(900)], "QUANTITE double, x double, z double, held boolean")
    model, errors = models.fit_boosted_early_stop(rows, ["x", "z"], "held", rounds=200, patience=8, stepSize=0.3)
    best, stopped = models.best_round(errors, 8)
    last = model.stages[-1]
    assert stopped and len(errors) < 200 and last.getNumTrees == best and errors[best - 1] == min(errors[: best + 8])
    held = model.transform(rows.filter("held")).select(F.avg(F.pow(F.col("QUANTITE") - F.col("prediction"), 2))).first()[0]
    assert held == pytest.approx(errors[best - 1])
    assert sum(last.featureImportances.toArray()) == pytest.approx(1.0)


def test_grid_search_falls_back(spark):
    df = history(spark, 1, 40)
    bad = [{"variancePower": 1.5, "regParam": 0.1}]
    negative = df.withColumn("QUANTITE", -F.col("QUANTITE") - 1)
    assert models.grid_search_time_cv(negative, ["PARAM_PRIX"], bad, 2, "tweedie", {"regParam": 7.0}) == {"regParam": 7.0}
    with pytest.raises(ValueError):
        models.grid_search_time_cv(negative, ["PARAM_PRIX"], bad, 2, "tweedie")


def test_choice_of_a_model_reports_both(spark, monkeypatch):
    monkeypatch.setattr(models, "GRIDS", {"tweedie": [{"regParam": 0.01}, {"regParam": 5.0}], "boosted": [{"maxDepth": 2}]})
    df = history(spark, 1, 150)
    name, model, report = models.choose_model(df, ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE"], k=2)
    rows = {r["modele"]: r for r in report.collect()}
    assert set(rows) == {"tweedie", "boosted"} and [m for m, r in rows.items() if r["choisi"]] == [name] and min(rows.values(), key=lambda r: r["wmape"])["modele"] == name
    test = windows.split_fraction(df).filter("is_test")
    naive = test.select(F.avg(F.abs(F.col("QUANTITE") - F.col("y_origin_m1")))).first()[0]
    assert rows[name]["mae"] < naive and rows[name]["accuracy"] == pytest.approx(100 - rows[name]["wmape"]) and model.transform(df).count() == df.count()


def test_fits_read_few_partitions(spark, monkeypatch):
    """What a shuffle leaves is settled before a search: small tables are fitted in one task a stage."""
    seen, fit = [], models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda train, *a, **k: seen.append(train.rdd.getNumPartitions()) or fit(train, *a, **k))
    df = history(spark, 2, 60)
    rows = windows.split_with_purge(df)
    models.grid_errors(df, ["PARAM_PRIX"], [{"regParam": 0.1}], 2, "tweedie")
    models.search_params(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["PARAM_PRIX"], {"regParam": [0.1]}, kind="tweedie")
    assert seen == [1, 1, 1]


def test_searches_start_with_the_largest_folds(spark, monkeypatch):
    """A long fit that starts last would run alone; each error still belongs to its own point of the grid."""
    rows = spark.sql("select 'a' as ID_PRODUIT, 1 as ID_SO, date_add(date'2020-01-01', cast(id as int)) as date, cast(id % 5 as double) as QUANTITE, cast(id as double) as x from range(40)")
    seen, fit = [], models.fit_model
    monkeypatch.setattr(models, "FITS_AT_ONCE", 1)
    monkeypatch.setattr(models, "fit_model", lambda train, *rest, **params: seen.append((train.count(), params["regParam"])) or fit(train, *rest, **params))
    grid = [{"regParam": 0.01}, {"regParam": 1000.0}]
    errors = models.grid_errors(rows, ["x"], grid, 3, "tweedie")
    sizes = [n for n, _ in seen]
    assert len(seen) == 6 and sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] and len(set(seen)) == 6
    assert errors == [models.grid_errors(rows, ["x"], [g], 3, "tweedie")[0] for g in grid]
