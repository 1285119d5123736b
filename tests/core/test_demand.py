import datetime as dt
import json
import math
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidewell.operators import clean, demand, elasticity, metrics, models, totals, windows
from tidewell.operators.quantiles import exact_quantiles
from tidewell.plans import registry
from tidewell.schema import CLASSES, SIGNS, feature_role
from tidewell.sources import text
from tidewell.streaming import stats
from tidewell.streaming.upsert import read_current

DATA = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def series(spark, values, product=1):
    return spark.createDataFrame([(product, 10, DAY + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "ID_PRODUIT long, ID_SO long, date date, QUANTITE double")


@pytest.mark.parametrize(
    ("values", "label"),
    [([5] * 30, "smooth"), ([5, 0, 0] * 10, "intermittent"), ([1, 20] * 15, "erratic"), ([1, 0, 0, 40, 0, 0] * 5, "lumpy"), ([0] * 30, "indetermine")],
)
def test_demand_classes(spark, values, label):
    assert demand.sales_stats_report(series(spark, values)).first()["profil_demande"] == label


def test_limits_fall_on_the_upper_side(spark):
    rows = spark.createDataFrame([(1.32, 0.1), (1.0, 0.49), (None, 0.1), (1.0, None)], "a double, c double")
    assert [r[0] for r in rows.select(demand.classify_demand(F.col("a"), F.col("c"))).collect()] == ["intermittent", "erratic", "indetermine", "indetermine"]


def test_segment_without_sales_and_with_one(spark):
    both = demand.demand_segment(series(spark, [0, 0]).unionByName(series(spark, [3, 0], 2))).orderBy("ID_PRODUIT").collect()
    assert (both[0]["profil"], both[0]["adi"], both[0]["cv2"]) == ("lumpy", 999.0, 999.0)
    assert both[1]["profil"] == "lumpy" and both[1]["cv2"] is None


@pytest.mark.parametrize(("n", "samples"), [(60, 0), (61, 0), (62, 1), (70, 6)])
def test_origins(spark, n, samples):
    out = windows.direct_samples(series(spark, range(n)), [])
    assert out.count() == samples
    assert out.filter("_target_date <= _origin_date").count() == 0


def test_origin_features_take_one_exchange(spark):
    plan = windows.origin_features(series(spark, range(99)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_dates_from_parts(spark):
    rows = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (1999, 1, 1), (2017, 12, 31), (2024, 13, 1)], "y int, m int, d int")
    got = [r[0] for r in rows.select(clean.date_from_parts(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [dt.date(2024, 2, 29), None, None, None, None]


def test_coerce_numeric(spark):
    rows = spark.createDataFrame([("2024.0",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in clean.coerce_numeric(rows, ["v"]).collect()] == [2024.0, None, None, None]


def test_impute_and_interpolate(spark):
    rows = series(spark, [0] * 5).withColumn("v", F.when(F.dayofmonth("date") == 2, 1.0).when(F.dayofmonth("date") == 4, 3.0))
    assert [r["v"] for r in windows.interpolate_linear(rows, "v").orderBy("date").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert [r["v"] for r in windows.impute_midpoint(rows, "v").orderBy("date").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_key_value_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("{ID_PRODUIT=1, ID_SO=10, QUANTITE=3.0}\nnot a record\n{A=1, A=2, B=x=y, C}\n")
    got = [r["kv"] for r in text.read_kv_text(spark, str(tmp_path / "a.txt")).collect()]
    assert got == [{"ID_PRODUIT": "1", "ID_SO": "10", "QUANTITE": "3.0"}, {"A": "2", "B": "x=y"}]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "data_CENTRALE_7_1.zip", "w") as z:
        z.writestr("__x.txt", "{A=0}")
        z.writestr("HIST_1.txt", "{A=1}\nbad")
    row = text.read_kv_archives(spark, str(tmp_path)).collect()
    assert [(r["ID_NOMENCLATURE"], r["kv"]) for r in row] == [(7, {"A": "1"})]


def test_lines_out(spark):
    rows = spark.createDataFrame([(1, math.nan, "a=b", 2.5)], "A int, B double, C string, D double")
    assert rows.select(text.to_kv_line(rows, ["A", "B", "C", "D"])).first()[0] == "{A=1, D=2.5}"


def test_payloads_need_equal_lengths(spark, tmp_path):
    good = {"LIST_HISTO": [{"DATE_IMPORT": "05/01/2024"}], "LIST_QUANTITE": ["-2"], "ID_PRODUIT": 1, "ID_SO": 2}
    (tmp_path / "p.json").write_text(json.dumps(good) + "\n" + json.dumps(good | {"LIST_QUANTITE": ["1", "2"]}))
    assert [(r["date"], r["QUANTITE"]) for r in text.read_payloads(spark, str(tmp_path)).collect()] == [(dt.date(2024, 1, 5), 0.0)]


def test_streaming_statistics_equal_batch(spark, tmp_path):
    series(spark, [5, 0, 0] * 10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ID_PRODUIT long, ID_SO long, date date, QUANTITE double").parquet(str(tmp_path / "in"))
    stats.stream_class_updates(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    row = read_current(spark, str(tmp_path / "out"), ["ID_PRODUIT", "ID_SO"]).first()
    assert (row["profil_demande"], row["nb_jours_obs"], row["nb_jours_demand"]) == ("intermittent", 30, 10)


def test_fill_next_day(spark):
    day = lambda n: dt.date(2024, 2, n)
    rows = spark.createDataFrame([(1, 1, 1, None), (1, 1, 2, day(28)), (1, 1, 3, None), (1, 1, 4, None), (1, 1, 5, day(3)), (1, 1, 6, None)], "ID_PRODUIT long, ID_SO long, i int, date date")
    assert [r["date"] for r in windows.fill_next_day(rows, "i").orderBy("i").collect()] == [None, day(28), day(29), dt.date(2024, 3, 1), day(3), day(4)]


def test_versions_learn_only_from_their_past(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([(1, 1, day(i), q, float(i)) for i, q in enumerate([2.0, 4.0, 6.0, 0.0, 9.0], 1)], "ID_PRODUIT long, ID_SO long, date date, QUANTITE double, x double")
    versions = spark.createDataFrame([(1, 1, day(2)), (1, 1, day(4))], "ID_PRODUIT long, ID_SO long, date date")
    got = {r["date"].day: (r["version"].day, round(r["prediction"], 6)) for r in windows.forecast_by_version(rows, versions, "x").collect()}
    assert got == {2: (2, 4.0), 3: (2, 6.0), 4: (4, 2.4)}


def test_totals_of_a_flag_need_ten_rows_off(spark):
    rows = series(spark, [5] * 20).withColumn("PARAM_STOCK", (F.dayofmonth("date") > 12).cast("double"))
    scorer = lambda x: 10 + 5 * x["PARAM_STOCK"]
    value = lambda df: totals.series_elasticity(df, ["PARAM_STOCK"], scorer, ["PARAM_STOCK"]).first()["value"]
    assert (value(rows), value(rows.filter("dayofmonth(date) > 4"))) == (0.5, 0.0)


def test_single_perturbation_of_a_line(spark):
    rows = series(spark, [5] * 4).withColumn("PARAM_PRIX", F.lit(2.0))
    assert totals.perturb_single(rows, ["PARAM_PRIX"], lambda x: 10 - 2 * x["PARAM_PRIX"], ["PARAM_PRIX"]).first()["value"] == -0.67


@pytest.mark.parametrize("bucket", [100_000, 50])
def test_nearly_all_rows_change_partner(spark, bucket):
    rows = spark.range(300).selectExpr("id % 30 as ID_PRODUIT", "1 as ID_SO", "date_add(date '2024-01-01', cast(id / 30 as int)) as date", "cast(id as double) as x", "if(id % 7 = 0, null, id) as y")
    got = [(r["ID_PRODUIT"], r["x"], r["y"], r["_other"]) for r in models.with_partner(rows, ["ID_PRODUIT", "x", "y"], bucket=bucket).collect()]
    assert sorted(r[1] for r in got) == sorted(r[3]["x"] for r in got) == list(range(300))
    assert all(x != o["x"] and o["y"] == (None if o["x"] % 7 == 0 else o["x"]) for _, x, _, o in got)
    assert sum(p != o["ID_PRODUIT"] for p, _, _, o in got) > 270


def test_permuted_importance_of_short_series(spark):
    rows = spark.range(300).selectExpr("id % 30 as ID_PRODUIT", "1 as ID_SO", "date_add(date '2024-01-01', cast(id / 30 as int)) as date", "cast(id % 30 as double) as x", "cast(id % 4 as double) as z")
    rows = rows.withColumn("QUANTITE", 10 * F.col("x"))
    rises = dict(models.permutation_importance(rows, models.fit_model(rows, ["x", "z"], "boosted"), ["x", "z"]))
    assert rises["x"] > 80 and abs(rises["z"]) < 1


def test_each_class_gets_its_own_model(spark):
    name = F.when(F.col("p") == 0, "smooth").when(F.col("p") == 1, "lumpy").otherwise("erratic")
    rows = spark.range(1000).selectExpr("id", "if(id < 450, 0, if(id < 900, 1, 2)) as p", "cast(id % 10 as double) as x").withColumn("sb_class", name)
    rows = rows.withColumn("QUANTITE", F.exp(F.when(F.col("p") == 0, F.col("x") / 10).otherwise(2 - F.col("x") / 10))).filter("id < 950")
    fitted = models.fit_by_class(rows, ["x"], ["smooth", "lumpy", "erratic"])
    out = models.predict_by_class(fitted, rows)
    assert sorted(fitted) == ["lumpy", "smooth"] and out.count() == 900
    assert out.filter("abs(prediction - QUANTITE) > 0.2").count() == 0
    assert models.predict_by_class({}, rows).count() == 0


def test_class_model_query(spark, monkeypatch):
    seen = []
    fit = models.fit_by_class
    monkeypatch.setattr(models, "fit_by_class", lambda df, *rest: seen.extend(r[0] for r in df.select("sb_class").distinct().collect()) or fit(df, *rest))
    out = registry.queries()["m2_fit_class_model"](spark, DATA)
    assert seen and set(seen) <= set(CLASSES) and out.columns == ["ID_PRODUIT", "ID_SO", "date", "QUANTITE", "prediction"] and out.count() > 0


def test_search_draws_without_repeats_and_over_the_space():
    assert sorted(p["a"] for p in models.draw_params({"a": [1, 2, 3]}, 15)) == [1, 2, 3]
    for space in models.SPACE.values():
        drawn = models.draw_params(space)
        assert len({tuple(p.items()) for p in drawn}) == len(drawn) == 15 and drawn == models.draw_params(space)
        assert all(len({p[k] for p in drawn}) > 1 for k in space)
    assert set().union(*models.SPACE.values()) == {"variancePower", "regParam", "maxDepth", "minInstancesPerNode", "stepSize", "subsamplingRate"}


def test_search_takes_the_least_error(spark):
    rows = spark.range(200).selectExpr("cast(id % 20 as double) as x", "cast(id % 20 as double) as QUANTITE")
    found, error = models.search_params(rows, rows, ["x"], {"maxDepth": [1, 3, 5], "maxIter": [1, 2]}, seed=1)
    assert found["maxDepth"] == 5 and error < 0.1


def test_queries_do_not_cut_boosting(spark, monkeypatch):
    seen, whole = [], models.regressor
    monkeypatch.setattr(models, "regressor", lambda *a, **p: seen.append(whole(*a, **p)) or seen[-1])
    for name in ("m4_fit_direct_model", "m9_refit_from_params", "e15_permutation_importance", "a31_signed_importance"):
        registry.queries()[name](spark, DATA)
    assert len(seen) == 4 and all(m.getMaxIter() >= 10 for m in seen)


@pytest.mark.parametrize(("horizon", "stride", "origins"), [(1, 1, range(61, 100)), (10, 15, (61, 76))])
def test_backtest_origins_and_targets(spark, horizon, stride, origins):
    rows = series(spark, range(1, 101)).withColumn("x", F.col("QUANTITE"))
    model = models.fit_model(windows.direct_samples(rows, ["x"]), ["x"], "boosted", label="y")
    out = models.rolling_backtest(model, rows, horizon, stride, ["x"]).select(F.datediff("_origin_date", F.lit(DAY)) + 1, F.datediff("_target_date", F.lit(DAY)) + 1, "y").collect()
    assert sorted(map(tuple, out)) == [(o, o + horizon, o + horizon) for o in origins if o + horizon <= 100 and o + horizon != 70]  # the purged day


def test_lag_regression_has_covariate_lags_and_is_tuned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "search_params", lambda train, holdout, features, space: seen.append((features, space)) or ({"maxIter": 1, "maxDepth": 1}, 0.0))
    assert registry.queries()["m15_lag_regression"](spark, DATA).count() > 0
    assert len(seen[0][0]) == 28 and seen[0][1] == models.SPACE["boosted"]


def test_dense_days_scan_the_lines_once(spark):
    """The calendar's span and its rows come from sales written before, not from two scans and joins of the tables."""
    files = registry.dense(spark, DATA).inputFiles()
    assert files and not [f for f in files if f.startswith(f"file://{DATA}")]


@pytest.mark.parametrize("name", ["m5_search_params", "m15_lag_regression"])
def test_searches_do_not_go_back_to_the_tables(spark, monkeypatch, name):
    """Each fit and each error would scan the lines and broadcast the parts again."""
    seen, fit = [], models.fit_model
    monkeypatch.setattr(models, "draw_params", lambda space, n, seed: [{"maxIter": 1}])
    monkeypatch.setattr(models, "fit_model", lambda train, *a, **k: seen.append(train.inputFiles()) or fit(train, *a, **k))
    assert registry.queries()[name](spark, DATA).count() > 0
    assert len(seen) == 2 and not [f for files in seen for f in files if f.startswith(f"file://{DATA}")]


def test_jdbc_query(spark):
    options = {"url": "jdbc:derby:memory:sales;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert text.read_sales_jdbc(spark, options, "select 7 as q from sysibm.sysdummy1").first()[0] == 7


def test_roles():
    names = ("PARAM_JS_1", "est_promo", "PARAM_PROMO_3", "PARAM_PRIX", "discount_pct", "PARAM_ANNEE", "roll_mean_7", "dow", "month_sin", "mois", "semaine", "jour_annee", "mean_dow_today", "ratio_dow", "target_week")
    assert [feature_role(n) for n in names] == ["binary", "binary", "promo", "continuous", "continuous"] + ["excluded"] * 10


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 30_000), np.zeros(20_000), r.integers(0, 5, 300)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    for accuracy in (100, 10_000):
        got = exact_quantiles(df, {"x": (F.col("x"), probs), "none": (F.col("none"), [0.5])}, accuracy)
        assert np.allclose(got["x"], np.quantile(x, probs), atol=1e-9) and got["none"] == [None]
    small = spark.createDataFrame([(float(i),) for i in (3, 1, 2)], "x double")
    assert exact_quantiles(small, {"x": (F.col("x"), [0.1, 0.5])})["x"] == pytest.approx([1.2, 2.0])


def promo_rows(spark, couples):
    rows = [(p, 1, DAY + dt.timedelta(i), float(q), float(x)) for p, values in couples.items() for i, (q, x) in enumerate(values)]
    return spark.createDataFrame(rows, "ID_PRODUIT int, ID_SO int, date date, QUANTITE double, PARAM_PROMO_1 double")


def test_promotions_by_history_or_simulated(spark):
    """Couple 1 ran promotions, 2 never did, 3 shows no empirical effect, 4 has noise below the threshold of activity."""
    scorer = lambda x: 10 * (1 + x["PARAM_PROMO_1"])
    rows = promo_rows(spark, {1: [(10, 0)] * 5 + [(20, 0.2), (20, 0.4)], 2: [(10, 0)] * 4, 3: [(10, 0), (10.5, 0.3)], 4: [(10, 1e-9)] * 3})
    out = {r["ID_PRODUIT"]: r for r in elasticity.elasticities(rows, ["PARAM_PROMO_1"], scorer, ["PARAM_PROMO_1"]).collect()}
    assert set(out) == {1, 2, 4}
    assert (out[1]["value"], out[1]["type"], out[1]["std"]) == (30.0, "impact_promo", 7.41)
    assert (out[2]["value"], out[2]["type"]) == (out[4]["value"], out[4]["type"]) == (30.0, "impact_promo_simule")
    never = elasticity.elasticities(promo_rows(spark, {2: [(10, 0)] * 4}), ["PARAM_PROMO_1"], scorer, ["PARAM_PROMO_1"]).collect()
    assert [(r["value"], r["type"], r["cv"]) for r in never] == [(100.0, "impact_promo_simule", 0.0)]


def test_continuous_effects_guards_and_zero(spark):
    rows = spark.createDataFrame([(p, 1, DAY, 5.0, float(v), 7.0, 100.0 + v, -float(v)) for p in (1, 2) for v in range(1, 11)], "ID_PRODUIT int, ID_SO int, date date, QUANTITE double, x double, same double, narrow double, minus double")
    names = ["x", "same", "narrow", "minus"]
    scorer = lambda c: F.when(F.col("ID_PRODUIT") == 1, 20 + c["x"] - c["minus"] + c["narrow"] + c["same"]).otherwise(30.0)
    out = elasticity.elasticities(rows, names, scorer, names).collect()
    y = [20 + v + v + 100 + v + 7 for v in range(1, 11)]
    e = np.mean([1.1 / v / 0.2 for v in y])
    # the step is a tenth of the signed mean; constant and narrow features and zero effects are left out
    assert {(r["ID_PRODUIT"], r["feature"]): r["value"] for r in out} == {(1, "x"): round(e, 2), (1, "minus"): round(e, 2)}


def test_elasticities_of_a_fitted_model(spark):
    rows = spark.createDataFrame([(p, 1, DAY + dt.timedelta(i), 50.0 - 2 * i + 5 * (i % 2), float(1 + i), float(i % 2)) for p in (1, 2) for i in range(12)], "ID_PRODUIT int, ID_SO int, date date, QUANTITE double, PARAM_PRIX double, PARAM_VACANCE double")
    names = ["PARAM_PRIX", "PARAM_VACANCE"]
    model = Pipeline(stages=[models.assemble(names), LinearRegression(labelCol="QUANTITE")]).fit(rows)
    w, b = model.stages[-1].coefficients, model.stages[-1].intercept
    line = lambda x: b + float(w[0]) * x["PARAM_PRIX"] + float(w[1]) * x["PARAM_VACANCE"]
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(elasticity.elasticities(rows, names, model, names)) == order(elasticity.elasticities(rows, names, line, names))
    assert len(order(elasticity.elasticities(rows, names, model, names))) == 4


def test_observations(spark):
    rows = series(spark, range(200)).unionByName(series(spark, [1] * 20, 2))
    tab = elasticity.observations(rows, "tabular", ["mois", "PARAM_X"])
    assert tab.columns == ["ID_PRODUIT", "ID_SO", "date", "mois", "PARAM_X", "QUANTITE"] and tab.count() == 90
    direct = elasticity.observations(rows, "direct", ["horizon", "y_origin_m0", "target_dow"])
    every = windows.direct_samples(rows, [], purged=0)
    assert direct.count() == every.count() > windows.direct_samples(rows, []).count()
    assert direct.filter("QUANTITE - y_origin_m0 <> horizon").count() == 0


def test_sign_audit_has_five_features(spark):
    long = spark.createDataFrame([(f, 1.0) for f in SIGNS], "feature string, value double")
    assert {r["feature"] for r in metrics.sign_audit(long).collect()} == {"PARAM_PRIX", "PARAM_LOG_PRIX", "PARAM_EST_PROMO", "PARAM_PRIX_VENTE_PROMO", "PARAM_DISCOUNT_PCT"}


def test_run_outputs_and_json(spark, tmp_path):
    rows = series(spark, [1, 2])
    text.write_kv_text(rows, text.to_kv_line(rows, ["ID_PRODUIT", "QUANTITE"]), f"{tmp_path}/kv")
    assert {r[0] for r in spark.read.text(f"{tmp_path}/kv").collect()} == {"{ID_PRODUIT=1, QUANTITE=1.0}", "{ID_PRODUIT=1, QUANTITE=2.0}"}
    text.write_run_metadata(spark.createDataFrame([("smooth", 1.5)], "sb_class string, mae double"), ["a", "b"], {"depth": 3}, rows, f"{tmp_path}/meta")
    row = text.read_json_table(spark, f"{tmp_path}/meta", "sb_class string, mae double, features array<string>, params string, date_min date, date_max date").first()
    assert (row["features"], json.loads(row["params"]), row["date_max"]) == (["a", "b"], {"depth": 3}, DAY + dt.timedelta(1))
    (tmp_path / "one.json").write_text('[\n{"a": 1},\n{"a": 2}]')
    assert text.read_json_table(spark, f"{tmp_path}/one.json", lines=False).count() == 2


def test_small_table_operators(spark):
    assert clean.split_numeric_exogenous(["PARAM_A", "QUANTITE", "B"]) == ["PARAM_A", "B"]
    nulls = spark.createDataFrame([(1.0, None), (float("nan"), 2)], "a double, b int")
    assert [tuple(r) for r in clean.fill_or_drop_nulls(nulls, ["a", "b"]).collect()] == [(1.0, 0), (0.0, 2)] and clean.fill_or_drop_nulls(nulls, ["a"], drop=True).count() == 1
    log = spark.createDataFrame([(1, 1, DAY, "x", 2.0), (1, 1, DAY, "y", 1.0), (1, 1, DAY - dt.timedelta(1), "z", 0.5)], "id_produit int, id_so int, date_entrainement date, model_name string, rmse_train double")
    assert clean.latest_training(log).first()["date_entrainement"] == DAY and clean.latest_training(log, best=True).first()["model_name"] == "y"
    bench = spark.createDataFrame([(1.0, 0.5), (1.0, 1.0), (1.0, 3.0), (1.0, None)], "MAE_perprod double, MAE_global double")
    *counts, mean = metrics.benchmark_summary(bench).first()
    assert counts == [3, 1, 2] and float(mean) == -0.5
    assert [r["feature"] for r in metrics.top_features(spark.createDataFrame([("a", 1.0), ("c", 2.0), ("b", 2.0)], "feature string, importance double"), 2).collect()] == ["b", "c"]
    rows = series(spark, [4, 8, 6])
    for how in ("minmax", "maxabs"):
        back = windows.unscale_series(windows.scale_series(rows, "QUANTITE", how).drop("QUANTITE"), rows, "QUANTITE", "QUANTITE_scaled", how)
        assert sorted(r["QUANTITE"] for r in back.collect()) == pytest.approx([4.0, 6.0, 8.0])


def test_early_stopping_and_two_kinds_of_rows(spark):
    rows = spark.createDataFrame([(1, 1, DAY + dt.timedelta(i), float(i % 7), float(i % 7), i % 5 == 0) for i in range(300)], "ID_PRODUIT int, ID_SO int, date date, QUANTITE double, x double, held boolean")
    model, errors = models.fit_boosted_early_stop(rows, ["x"], "held", rounds=30, patience=5)
    assert model.stages[-1].getNumTrees == models.best_round(errors, 5)[0] <= 30
    out = models.fitted_vs_future(model, rows, rows.limit(7).drop("QUANTITE"))
    assert {r["kind"]: r["n"] for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"QUANTITE_AJUSTE": 300, "QUANTITE_0": 7}


NEW = ["p2_date_from_parts", "p12_feature_role", "e0_observations", "e5_calendar_unit", "a27_benchmark_summary", "a29_latest_training", "t8_compare_elasticities", "w21_holdout_slice", "e10_ols_of_features", "m8_fit_per_series", "m14_fit_arx", "m17_ols", "e13_attribution_share", "e1_price_range", "e2_one_promo", "j6_version_intervals", "a6_counted_ingest", "e17_compare_lines", "s3_nomenclature", "t3_first_files", "p6_numeric_columns", "p9_narrow_types", "p17_exogenous", "t2_top_features"]
ROUND_TRIPS = ["s1_kv_text", "s2_kv_archives", "r3_stream_ingest", "s4_semicolon_csv", "s5_series_class", "s7_by_class", "s8_sample_cache", "s11_kv_by_nomenclature", "s13_payloads", "s16_run_metadata", "r2_stream_class_updates", "r3_stream_daily_demand", "r4_stream_score"]


@pytest.mark.parametrize("name", ["a4_sales_stats_report", "m3_direct_samples", "e7_elasticities", "e8_series_elasticity", "e16_elasticity_export", "m19_forecast_by_version", "w9_interpolate_linear", *NEW, *ROUND_TRIPS])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "orders", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    got = sorted([show(r[c]) for c in cols] for r in df.collect())
    rel = con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted([show(r[i]) for i in at] for r in rel.fetchall())


def test_correlation_of_a_constant_is_undefined(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (4.0, 3.0, 5.0)], "y double, x double, same double")
    r = rows.agg(metrics.correlation("y", "x").alias("x"), F.corr("y", "x").alias("c"), metrics.correlation("y", "same").alias("same"), metrics.correlation("same", "y").alias("turned")).first()
    assert r["x"] == pytest.approx(r["c"]) and r["same"] != r["same"] and r["turned"] != r["turned"]
    assert rows.limit(0).agg(metrics.correlation("y", "x")).first()[0] is None


@pytest.fixture(scope="module")
def no_promotions(tmp_path_factory):
    """The given tables with one discount for all lines, so that no couple has a promotion."""
    folder, con = tmp_path_factory.mktemp("flat"), duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation"):
        one = " replace (0.05::double as l_discount)" if t == "lineitem" else ""
        con.execute(f"copy (select *{one} from '{DATA}/{t}.parquet') to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["t2_top_features", "e11_perturb_single"])
def test_queries_equal_sql_without_promotions(spark, no_promotions, name):
    folder, con = no_promotions
    df = registry.queries()[name](spark, folder)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(registry.oracle_sql()[name]).fetchall()))


PLAIN = ["e10_ols_of_features", "m14_fit_arx", "m17_ols", "m8_fit_per_series", "e17_compare_lines", "t8_compare_elasticities"]


@pytest.mark.parametrize("name", PLAIN)
def test_fits_of_constant_features_equal_sql(spark, no_promotions, name):
    folder, con = no_promotions
    df, rel = registry.queries()[name](spark, folder), con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    wanted = sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert sorted(map(str, map(tuple, df.collect()))) == wanted and any("nan" in w for w in wanted)


def test_flags_that_a_couple_never_changes(spark):
    rows = series(spark, [5] * 4).withColumn("PARAM_PROMO_1", F.lit(0.0))
    run = lambda **how: [r["value"] for r in totals.perturb_single(rows, ["PARAM_PROMO_1"], lambda x: 10 + 5 * x["PARAM_PROMO_1"], ["PARAM_PROMO_1"], **how).collect()]
    assert run() == [] and run(constant_flags=True) == [50.0]


def test_plain_perturbations_move_flags_by_their_step(spark):
    rows = series(spark, [5] * 4).withColumns({"PARAM_PROMO_1": F.lit(0.0), "PARAM_VACANCE": F.lit(1.0)})
    run = lambda b: {r["feature"]: r["value"] for r in totals.perturb_single(rows, ["PARAM_PROMO_1", "PARAM_VACANCE"], lambda x: b + 10 * x["PARAM_VACANCE"] + 5 * x["PARAM_PROMO_1"], ["PARAM_PROMO_1", "PARAM_VACANCE"], plain=True).collect()}
    assert run(0) == {"PARAM_VACANCE": 1.0} and all(v != v for v in run(F.lit(float("nan"))).values()) and len(run(F.lit(float("nan")))) == 2


def test_lines_without_training_rows_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation"):
        one = " order by l_shipdate, l_orderkey limit 1" if t == "lineitem" else ""
        con.execute(f"copy (select * from '{DATA}/{t}.parquet'{one}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert registry.queries()["e17_compare_lines"](spark, str(tmp_path)).collect() == con.sql(registry.oracle_sql()["e17_compare_lines"]).fetchall() == []
