"""DuckDB SQL of the registered queries."""

from __future__ import annotations

SALES = """
sales AS (
  SELECT ID_PRODUIT, ID_SO, date, q AS QUANTITE, p / q AS PARAM_PRIX, CASE WHEN m >= 0.06 THEN m ELSE 0.0 END AS PARAM_PROMO_1,
         CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS PARAM_VACANCE
  FROM (SELECT p_type AS ID_PRODUIT, CAST(n_regionkey AS INTEGER) AS ID_SO, CAST(l_shipdate AS DATE) AS date,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS p,
               round(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS m
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY ALL))"""
DENSE = """,
dense AS (
  SELECT g.ID_PRODUIT, g.ID_SO, g.date, coalesce(s.QUANTITE, 0.0) AS QUANTITE, s.PARAM_PRIX, s.PARAM_PROMO_1
  FROM (SELECT ID_PRODUIT, ID_SO, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales GROUP BY 1, 2) g
  LEFT JOIN sales s USING (ID_PRODUIT, ID_SO, date))"""
NAIVE = """,
naive AS (SELECT *, lag(QUANTITE, 7) OVER (PARTITION BY ID_PRODUIT, ID_SO ORDER BY date) AS p FROM dense)"""
STATS = """,
st AS (
  SELECT ID_PRODUIT, ID_SO, count(*) AS nb_records, count(*) FILTER (WHERE QUANTITE > 0) AS nb_records_avec_vente, sum(QUANTITE) AS somme,
         avg(QUANTITE) AS moyenne_all, stddev_pop(QUANTITE) AS ecart_type_all, avg(QUANTITE) FILTER (WHERE QUANTITE > 0) AS moyenne_nz,
         stddev_pop(QUANTITE) FILTER (WHERE QUANTITE > 0) AS ecart_type_nz, count(DISTINCT date) AS nb_jours_obs,
         count(DISTINCT date) FILTER (WHERE QUANTITE > 0) AS nb_jours_demand
  FROM dense GROUP BY 1, 2),
rep AS (
  SELECT *, adi0 AS adi_full, CASE WHEN adi0 IS NULL OR c2 IS NULL THEN 'indetermine' WHEN adi0 < 1.32 AND c2 < 0.49 THEN 'smooth' WHEN adi0 >= 1.32 AND c2 < 0.49 THEN 'intermittent'
              WHEN adi0 < 1.32 THEN 'erratic' ELSE 'lumpy' END AS profil_demande
  FROM (SELECT *, nb_jours_obs / nullif(nb_jours_demand, 0) AS adi0, ecart_type_nz / moyenne_nz AS cv, (ecart_type_nz / moyenne_nz) * (ecart_type_nz / moyenne_nz) AS c2 FROM st))"""
CURVE = """,
cv AS (SELECT s.*, a, b FROM sales s JOIN (SELECT ID_PRODUIT, ID_SO, regr_intercept(ln(QUANTITE), ln(PARAM_PRIX)) AS a, regr_slope(ln(QUANTITE), ln(PARAM_PRIX)) AS b
       FROM sales WHERE QUANTITE > 0 AND PARAM_PRIX > 0 GROUP BY 1, 2) USING (ID_PRODUIT, ID_SO))"""
W = "PARTITION BY ID_PRODUIT, ID_SO ORDER BY date"
P = "PARTITION BY ID_PRODUIT, ID_SO"
_KEY_OF = "ID_PRODUIT, ID_SO"


def _score(price="PARAM_PRIX", promo="PARAM_PROMO_1", free="PARAM_VACANCE"):
    return f"exp(a + b * ln({price})) * (1 + 0.5 * {promo}) * (1 + 0.1 * {free})"


def _s(body):
    return f"WITH {SALES} {body}"


def _d(body, more=""):
    return f"WITH {SALES}{DENSE}{more} {body}"


def _origin():
    out = [f"coalesce(lag(QUANTITE, {k}) OVER ({W}), 0.0) AS y_origin_m{k}" for k in (0, 1, 2, 7, 14, 28, 91, 365)]
    for n in (7, 28, 91):
        f = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out += [f"avg(QUANTITE) {f} AS roll_mean_{n}", f"stddev_pop(QUANTITE) {f} AS roll_std_{n}", f"max(QUANTITE) {f} AS roll_max_{n}", f"avg(CAST(QUANTITE > 0 AS INTEGER)) {f} AS roll_nonzero_ratio_{n}"]
    return ", ".join(out)


_ORIGIN = f""",
n0 AS (SELECT *, row_number() OVER ({W}) AS rn FROM dense),
o AS (SELECT *, {_origin()},
        CASE WHEN rn >= 28 THEN regr_slope(QUANTITE, rn) OVER ({W} ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS trend_28,
        coalesce(rn - max(CASE WHEN QUANTITE > 0 THEN rn END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), rn) AS days_since_sale,
        count(*) OVER ({P}) AS n, max(date) OVER ({P}) AS last FROM n0)"""
_HORIZONS = [1, 2, 3, 7, 14, 21, 28, 45, 60, 75, 90]
# only what the samples show, and the targets by leads of the same window
_FEW = f""",
o AS (SELECT {_KEY_OF}, date AS _origin_date, QUANTITE AS y_origin_m0, row_number() OVER w AS rn, count(*) OVER ({P}) AS n, max(date) OVER ({P}) AS last,
        coalesce(lag(QUANTITE, 7) OVER w, 0.0) AS y_origin_m7, coalesce(lag(QUANTITE, 365) OVER w, 0.0) AS y_origin_m365, round(avg(QUANTITE) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 5) AS roll_mean_28,
        round(stddev_pop(QUANTITE) OVER (w ROWS BETWEEN 90 PRECEDING AND CURRENT ROW), 5) AS roll_std_91, round(regr_slope(QUANTITE, x) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 5) + 0.0 AS trend_28,
        {", ".join(f"lead(date, {h}) OVER w AS d{h}, lead(QUANTITE, {h}) OVER w AS q{h}, lead(PARAM_PROMO_1, {h}) OVER w AS p{h}" for h in _HORIZONS)}
      FROM (SELECT *, CAST(date - DATE '1990-01-01' AS DOUBLE) AS x FROM dense) WINDOW w AS ({W}))"""
_ORIGINS = "FROM o WHERE rn >= 61 AND (rn - 61) % 7 = 0 AND rn <= n - 1"
_SHOWN = "_origin_date, last, y_origin_m0, y_origin_m7, y_origin_m365, roll_mean_28, roll_std_91, trend_28"
_AHEAD = " UNION ALL ".join(f"SELECT {_KEY_OF}, {_SHOWN}, {h} AS horizon, d{h} AS d, q{h} AS y, p{h} AS PARAM_PROMO_1 {_ORIGINS}" for h in _HORIZONS)
_ROLLS = ", ".join(f"round({c}_{n}, 5) AS {c}_{n}" for n in (7, 28, 91) for c in ("roll_mean", "roll_std", "roll_max", "roll_nonzero_ratio"))
_KEY = "ID_PRODUIT, ID_SO"
_FULL = lambda n: f"CASE WHEN rn >= {n} THEN round(avg(QUANTITE) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 5) END AS mean_{n}, CASE WHEN rn >= {n} THEN round(var_samp(QUANTITE) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 5) END AS var_{n}"
_CLIP = lambda e: f"greatest(-300.0, least(300.0, {e}))"
_OLS = lambda x, rows="sales": f"SELECT {_KEY}, regr_slope(QUANTITE, {x}) * avg({x}) / avg(QUANTITE) AS e FROM {rows} GROUP BY 1, 2"
_LONG = """SELECT ID_PRODUIT, ID_SO, '{f}' AS feature, round({sign}, 2) AS value, round(s, 2) AS std,
  CASE WHEN abs(round({sign}, 2)) <= 1e-8 THEN 99.0 ELSE round(abs(round(s, 2) / round({sign}, 2)) + 1e-9, 2) END AS cv, {t} AS type FROM {x}"""

SQL = {
    "a1_series_stats": _d(f"SELECT {_KEY}, nb_records, nb_records_avec_vente, somme, round(moyenne_all, 6) AS moyenne_all, round(ecart_type_all, 6) AS ecart_type_all, round(moyenne_nz, 6) AS moyenne_nz, round(ecart_type_nz, 6) AS ecart_type_nz, round(ecart_type_all / moyenne_all, 6) AS cv_all, round(ecart_type_nz / moyenne_nz, 6) AS cv_nz FROM st", STATS),
    "a2_demand_days": _d(f"SELECT {_KEY}, nb_jours_obs, nb_jours_demand FROM st", STATS),
    "a4_sales_stats_report": _d(f"SELECT {_KEY}, nb_records, round(somme, 2) AS somme, round(moyenne_nz, 4) AS moyenne_nz, round(cv, 4) AS cv_nz, round(adi0, 4) AS adi, round(c2, 4) AS cv2, profil_demande FROM rep", STATS),
    "a5_class_distribution": _d("SELECT classe, count(profil_demande) AS n, round(100.0 * count(profil_demande) / sum(count(profil_demande)) OVER (), 4) AS pct FROM (SELECT unnest(['smooth','intermittent','erratic','lumpy','indetermine']) AS classe) LEFT JOIN rep ON profil_demande = classe GROUP BY 1", STATS),
    "a6_ingest_summary": _s("SELECT count(DISTINCT ID_PRODUIT) AS produits, count(DISTINCT ID_SO) AS magasins, count(DISTINCT (ID_PRODUIT, ID_SO)) AS couples, count(*) FILTER (WHERE ID_SO IS NULL) AS sans_so, min(date) AS date_min, max(date) AS date_max, CAST(max(date) - min(date) AS BIGINT) AS jours FROM sales"),
    "a7_date_gap_report": _s(f"SELECT *, e - nb_jours_presents AS nb_jours_manquants, round(100.0 * nb_jours_presents / e, 1) AS taux_couverture_pct FROM (SELECT {_KEY}, min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS nb_jours_presents, CAST(max(date) - min(date) + 1 AS BIGINT) AS e FROM sales GROUP BY 1, 2) WHERE e >= 2").replace("SELECT *, e -", "SELECT * EXCLUDE (e), e AS nb_jours_attendus, e -"),
    "a8_demand_segment": _d(f"SELECT {_KEY}, CASE WHEN k = 0 THEN 'lumpy' WHEN n / k <= 1.32 AND pow(s / m, 2) <= 0.49 THEN 'fast_regulier' WHEN n / k <= 1.32 AND pow(s / m, 2) > 0.49 THEN 'fast_irregulier' WHEN n / k > 1.32 AND pow(s / m, 2) <= 0.49 THEN 'slow' ELSE 'lumpy' END AS profil, CASE WHEN k = 0 THEN 999.0 ELSE round(n / k, 3) END AS adi, CASE WHEN k = 0 THEN 999.0 ELSE round(pow(s / m, 2), 3) END AS cv2 FROM (SELECT {_KEY}, count(*) AS n, count(*) FILTER (WHERE QUANTITE > 0) AS k, greatest(avg(QUANTITE) FILTER (WHERE QUANTITE > 0), 1e-6) AS m, stddev_samp(QUANTITE) FILTER (WHERE QUANTITE > 0) AS s FROM dense GROUP BY 1, 2)"),
    "a9_date_ranges": _s(f"SELECT {_KEY}, min(date) AS date_min, max(date) AS date_max FROM sales GROUP BY 1, 2"),
    "a11_daily_sales": _s(f"SELECT {_KEY}, date, sum(QUANTITE) AS QUANTITE FROM sales GROUP BY 1, 2, 3"),
    "a12_daily_mean": _s("SELECT ID_PRODUIT, date, round(avg(QUANTITE) + 1e-8, 6) AS QUANTITE, round(avg(PARAM_PRIX) + 1e-8, 6) AS PARAM_PRIX FROM sales GROUP BY 1, 2"),
    "a13_eligible_series": _s(f"SELECT {_KEY}, count(*) AS n FROM sales GROUP BY 1, 2 HAVING count(*) >= 180"),
    "a14_mean_std": _s(f"SELECT {_KEY}, round(avg(PARAM_PRIX), 5) AS moyenne, round(stddev_pop(PARAM_PRIX), 5) AS ecart_type FROM sales GROUP BY 1, 2"),
    "a15_median_iqr": _s(f"SELECT {_KEY}, round(median(PARAM_PRIX), 5) AS mediane, round(quantile_cont(PARAM_PRIX, 0.75) - quantile_cont(PARAM_PRIX, 0.25), 5) AS iqr, round((quantile_cont(PARAM_PRIX, 0.75) - quantile_cont(PARAM_PRIX, 0.25)) / 1.349, 5) AS robust_std FROM sales GROUP BY 1, 2"),
    "a16_forecast_metrics_by_series": _d(f"SELECT {_KEY}, count(*) AS N_OBS, sum(QUANTITE) AS SUM_ACTUAL, sum(p) AS SUM_PRED, round(avg(abs(p - QUANTITE)), 5) AS MAE, round(sqrt(avg((p - QUANTITE) * (p - QUANTITE))), 5) AS RMSE, round(avg(QUANTITE), 5) AS MEAN_ACTUAL, round(avg(abs(p - QUANTITE)) / avg(QUANTITE) * 100, 5) AS WMAPE, round((sum(p) - sum(QUANTITE)) / sum(QUANTITE) * 100, 5) AS DIFF_PCT FROM naive WHERE p IS NOT NULL GROUP BY 1, 2", NAIVE),
    "a17_forecast_metrics": _d("SELECT CAST(month(date) AS INTEGER) AS mois, count(*) AS n, round(avg(abs(p - QUANTITE)), 5) AS mae, round(sqrt(avg((p - QUANTITE) * (p - QUANTITE))), 5) AS rmse, round(avg(QUANTITE), 5) AS mean_y, round(avg(abs(p - QUANTITE)) / avg(QUANTITE) * 100, 5) AS mape_pct FROM naive WHERE p IS NOT NULL GROUP BY 1", NAIVE),
    "a18_tweedie_deviance": _d(f"SELECT {_KEY}, round(avg(2 * (pow(QUANTITE, 0.5) / (-0.25) - QUANTITE * pow(p + 1, -0.5) / (-0.5) + pow(p + 1, 0.5) / 0.5)), 5) AS deviance FROM naive WHERE p IS NOT NULL GROUP BY 1, 2", NAIVE),
    "a19_volume_accuracy": _d(f"SELECT {_KEY}, round(w, 5) AS wmape, round(greatest(100 - w, 0), 5) AS accuracy, round(v, 5) AS volume_error, round(greatest(100 - v / t * 100, 0), 5) AS volume_accuracy FROM (SELECT {_KEY}, sum(abs(p - QUANTITE)) / greatest(sum(QUANTITE), 1) * 100 AS w, abs(sum(p) - sum(QUANTITE)) AS v, greatest(sum(QUANTITE), 1) AS t FROM naive WHERE p IS NOT NULL GROUP BY 1, 2)", NAIVE),
    "a20_masked_rmse": _d("SELECT ID_PRODUIT, round(sqrt(avg((p - QUANTITE) * (p - QUANTITE))), 5) AS rmse FROM naive GROUP BY 1", NAIVE),
    "a21_smape": _d(f"SELECT {_KEY}, round(avg(CASE WHEN p + QUANTITE = 0 THEN 0 ELSE 200 * abs(p - QUANTITE) / (p + QUANTITE) END), 5) AS smape FROM naive WHERE p IS NOT NULL GROUP BY 1, 2", NAIVE),
    "a22_promo_lift": _s(f"SELECT {_KEY}, round(a, 5) AS q_avec, round(s, 5) AS q_sans, round(abs(a - s) / greatest(s, 0.01), 5) AS ratio FROM (SELECT {_KEY}, avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 > 0) AS a, avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 <= 0) AS s FROM sales GROUP BY 1, 2) WHERE a IS NOT NULL AND s IS NOT NULL"),
    "a23_range_check": _s(f"SELECT {_KEY}, stddev_pop(PARAM_PRIX) < 1e-6 AS constant, (quantile_cont(PARAM_PRIX, 0.9) - quantile_cont(PARAM_PRIX, 0.1)) / abs(quantile_cont(PARAM_PRIX, 0.1)) < 0.10 AS narrow FROM sales GROUP BY 1, 2"),
    "a26_accuracy_buckets": _d(f"SELECT count(*) FILTER (WHERE w <= 50) AS n_50, count(*) FILTER (WHERE w > 50 AND w <= 100) AS n_100, count(*) FILTER (WHERE w > 100) AS n_plus, round(median(w), 4) AS mediane_wmape FROM (SELECT avg(abs(p - QUANTITE)) / avg(QUANTITE) * 100 AS w FROM naive WHERE p IS NOT NULL GROUP BY {_KEY})", NAIVE),
    "a28_volume_pick": _d(f"SELECT {_KEY}, 'toutes' AS classe, volume FROM (SELECT *, row_number() OVER (ORDER BY volume DESC, {_KEY}) - 1 AS r, count(*) OVER () AS n FROM (SELECT {_KEY}, round(somme, 2) AS volume FROM rep)) WHERE list_contains(list_transform(range(0, 7), lambda i: CAST(round_even(i * (n - 1) / 6, 0) AS BIGINT)), r)", STATS),
    "a30_normalized_share": _s("SELECT ID_PRODUIT, round(sum(QUANTITE) / sum(sum(QUANTITE)) OVER (), 6) AS part FROM sales GROUP BY 1"),
    "j1_rows_of_class": _d(f"SELECT profil_demande, count(*) AS n, sum(QUANTITE) AS q FROM sales JOIN rep USING ({_KEY}) WHERE profil_demande <> 'indetermine' GROUP BY 1", STATS),
    "j4_update_quantity": _s(f"SELECT {_KEY}, date, CASE WHEN day(date) = 1 THEN QUANTITE * 2 ELSE QUANTITE END AS QUANTITE FROM sales"),
    "j6_version_intervals": _s(f", v AS (SELECT DISTINCT {_KEY}, CAST(date_trunc('month', date) AS DATE) AS f, m FROM (SELECT *, max(date) OVER ({P}) AS m FROM sales) WHERE month(date) IN (1, 7)), i AS (SELECT v.*, lead(f) OVER (PARTITION BY {_KEY} ORDER BY f) AS t FROM v) SELECT s.ID_PRODUIT, s.ID_SO, i.f AS valid_from, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM sales s JOIN i ON s.ID_PRODUIT = i.ID_PRODUIT AND s.ID_SO = i.ID_SO AND s.date >= i.f AND s.date < coalesce(i.t, i.m) GROUP BY 1, 2, 3"),
    "j7_calendar_spine": _d(f"SELECT {_KEY}, date, QUANTITE FROM dense"),
    "j10_with_and_without_promo": _s(f"SELECT {_KEY}, CAST(year(date) AS INTEGER) AS y, CASE WHEN bool_or(PARAM_PROMO_1 > 0.075) THEN 'A' ELSE 'B' END AS estimateur FROM sales GROUP BY 1, 2, 3"),
    "w1_origin_lags": _d(f"SELECT {_KEY}, date, COLUMNS('y_origin.*') FROM o", _ORIGIN),
    "w2_rolling_stats": _d(f"SELECT {_KEY}, date, {_ROLLS} FROM o", _ORIGIN),
    "w3_trend_sale_cv": _d(f"SELECT {_KEY}, date, round(trend_28, 5) + 0.0 AS trend_28, round(roll_std_28 / (roll_mean_28 + 1e-6), 5) AS cv_28, CAST(days_since_sale AS BIGINT) AS days_since_sale FROM o", _ORIGIN),
    "w6_calendar_rolling": _d(f"SELECT * FROM (SELECT {_KEY}, date, {_FULL(7)}, {_FULL(30)}, {_FULL(90)} FROM n0) WHERE mean_90 IS NOT NULL", f", n0 AS (SELECT *, row_number() OVER ({W}) AS rn FROM dense)"),
    "w7_expanding_stats": _d(f"SELECT {_KEY}, date, round(avg(QUANTITE) OVER ({W} ROWS UNBOUNDED PRECEDING) + 1e-8, 6) AS mean_exp, round(var_samp(QUANTITE) OVER ({W} ROWS UNBOUNDED PRECEDING) + 1e-8, 6) AS var_exp FROM dense"),
    "w8_impute_midpoint": _d(f"SELECT {_KEY}, date, round(coalesce((a + b) / 2, a, b) + 1e-8, 6) AS PARAM_PRIX FROM (SELECT *, last_value(PARAM_PRIX IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS a, first_value(PARAM_PRIX IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM dense)"),
    "w9_interpolate_linear": _d(f"SELECT {_KEY}, date, round(CASE WHEN e > f THEN a + (b - a) * (date - f) / (e - f) ELSE coalesce(a, b) END + 1e-8, 6) AS PARAM_PRIX FROM (SELECT *, last_value(PARAM_PRIX IGNORE NULLS) OVER u AS a, first_value(PARAM_PRIX IGNORE NULLS) OVER v AS b, last_value(d IGNORE NULLS) OVER u AS f, first_value(d IGNORE NULLS) OVER v AS e FROM (SELECT *, CASE WHEN PARAM_PRIX IS NOT NULL THEN date END AS d FROM dense) WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING), v AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"),
    "w12_split_with_purge": _s(f"SELECT {_KEY}, CASE WHEN date > m - 30 THEN 'test' WHEN date <= m - 31 THEN 'train' ELSE 'purged' END AS split, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM (SELECT *, max(date) OVER ({P}) AS m FROM sales) GROUP BY 1, 2, 3"),
    "w13_split_fraction": _s(f"SELECT {_KEY}, r <= least(365, floor(n * 0.3)) AS is_test, count(*) AS n, min(date) AS d0 FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY date DESC) AS r, count(*) OVER ({P}) AS n FROM sales) GROUP BY 1, 2, 3"),
    "w15_expanding_folds": _s(f"SELECT {_KEY}, fold, CASE WHEN rn < s THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(date) AS d0, max(date) AS d1 FROM (SELECT *, n - (6 - fold) * b AS s FROM (SELECT *, n // 6 AS b, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS fold FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER ({P}) AS n FROM sales))) WHERE rn < s + b GROUP BY 1, 2, 3, 4"),
    "w16_last_price": _s(f"SELECT {_KEY}, round(max_by(PARAM_PRIX, date), 6) AS prix FROM sales GROUP BY 1, 2"),
    "w17_winsorize": _s(f"SELECT {_KEY}, date, round(CASE WHEN n >= 20 THEN least(greatest(PARAM_PRIX, a), b) ELSE PARAM_PRIX END + 1e-8, 6) AS PARAM_PRIX FROM sales JOIN (SELECT {_KEY}, quantile_cont(PARAM_PRIX, 0.05) AS a, quantile_cont(PARAM_PRIX, 0.95) AS b, count(*) AS n FROM sales GROUP BY 1, 2) USING ({_KEY})"),
    "w20_scale_series": _s(f"SELECT {_KEY}, date, round((QUANTITE - min(QUANTITE) OVER ({P})) / (max(QUANTITE) OVER ({P}) - min(QUANTITE) OVER ({P})), 6) AS QUANTITE_scaled FROM sales"),
    "w22_regression_lags": _d(f"SELECT {_KEY}, date, QUANTITE, " + ", ".join(f"lag(QUANTITE, {k}) OVER ({W}) AS QUANTITE_lag{k}" for k in range(1, 8)) + " FROM dense"),
    "m3_direct_samples": _d(f"SELECT {_KEY}, _origin_date, d AS _target_date, d > last - 30 AS _is_test, CAST(horizon AS INTEGER) AS horizon, y_origin_m0, y_origin_m7, y_origin_m365, CAST(isodow(d) - 1 AS INTEGER) AS target_dow, CAST(dayofyear(d) AS INTEGER) AS target_doy, CAST(isodow(d) >= 6 AS INTEGER) AS target_is_weekend, PARAM_PROMO_1, y, roll_mean_28, roll_std_91, trend_28 FROM ({_AHEAD}) WHERE d IS NOT NULL AND (d > last - 30 OR d <= last - 31)", _FEW),
    "f4_build_features": _s(f", f AS (SELECT *, PARAM_PRIX * (1 - PARAM_PROMO_1) AS v FROM sales) SELECT {_KEY}, date, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS jour, CAST(dayofyear(date) AS INTEGER) AS jour_annee, CAST(weekofyear(date) AS INTEGER) AS semaine, CAST(month(date) AS INTEGER) AS mois, CAST(year(date) AS INTEGER) AS annee, CAST(day(date) = 1 AS INTEGER) AS debut_mois, CAST(date = last_day(date) AS INTEGER) AS fin_mois, CAST(isodow(date) >= 6 AS INTEGER) AS weekend, CAST(v > 0 AND v < PARAM_PRIX AS INTEGER) AS est_promo, round(sin(2 * pi() * dayofyear(date) / 365.25), 6) + 0.0 AS sin_jour, round(cos(2 * pi() * month(date) / 12.0), 6) + 0.0 AS cos_mois, round(v / PARAM_PRIX, 6) AS ratio_promo, round(CASE WHEN v < PARAM_PRIX THEN (PARAM_PRIX - v) / PARAM_PRIX ELSE 0.0 END, 6) AS discount_pct, round(ln(1 + PARAM_PRIX), 6) AS log_prix FROM f"),
    "p8_dedupe_days": _s("SELECT ID_PRODUIT, 0 AS ID_SO, date, QUANTITE FROM (SELECT *, row_number() OVER (PARTITION BY ID_PRODUIT, date ORDER BY QUANTITE, PARAM_PRIX) AS k FROM sales) WHERE k = 1"),
    "p14_history_window": _s(f"SELECT {_KEY}, count(*) AS n, sum(QUANTITE) AS q FROM (SELECT *, max(date) OVER ({P}) AS m FROM sales) WHERE m - date < 90 GROUP BY 1, 2"),
    "p15_systematic_sample": _s(f"SELECT {_KEY}, date, QUANTITE FROM (SELECT *, row_number() OVER ({W}) AS k FROM sales) WHERE k % 100 = 1"),
    "s9_kv_line": _s("SELECT '{ID_PRODUIT=' || ID_PRODUIT || ', ID_SO=' || ID_SO || ', date=' || strftime(date, '%Y-%m-%d') || '}' AS ligne FROM sales"),
    "t6_best_model": _d(f", e AS (SELECT {_KEY}, round(avg(abs(p - QUANTITE)), 6) AS a, round(avg(abs(q - QUANTITE)), 6) AS b FROM (SELECT *, lag(QUANTITE, 1) OVER ({W}) AS q FROM naive) WHERE p IS NOT NULL GROUP BY 1, 2) SELECT {_KEY}, CASE WHEN a <= b THEN 'saison' ELSE 'veille' END AS modele, least(a, b) AS mae FROM e", NAIVE),
    "u2_keys_in_both": _s(f"SELECT {_KEY}, CAST(dayofyear(date) AS INTEGER) AS j FROM sales WHERE PARAM_PROMO_1 > 0 INTERSECT SELECT {_KEY}, CAST(dayofyear(date) AS INTEGER) FROM sales WHERE PARAM_PROMO_1 = 0"),
    "u3_keys_minus": _s(f"SELECT {_KEY}, CAST(dayofyear(date) AS INTEGER) AS j FROM sales WHERE PARAM_PROMO_1 > 0 EXCEPT SELECT {_KEY}, CAST(dayofyear(date) AS INTEGER) FROM sales WHERE PARAM_PROMO_1 = 0"),
    "e1_price_scenarios": f"WITH {SALES}{CURVE} SELECT {_KEY}, 'PRIX_' || i AS scenario, round(sum(greatest({_score('(l * g)')}, 0)), 4) AS total FROM (SELECT cv.*, l, unnest([0.88, 0.96, 1.04, 1.12, 1.20]) AS g, unnest([1, 2, 3, 4, 5]) AS i FROM cv JOIN (SELECT {_KEY}, max_by(PARAM_PRIX, date) AS l FROM sales GROUP BY 1, 2) USING ({_KEY})) GROUP BY 1, 2, 3",
    "e2_promo_scenarios": f"WITH {SALES}{CURVE} SELECT {_KEY}, 'PARAM_PROMO_1_POURCENT_' || (5 * i) AS scenario, round(sum({_score(promo='(i / 20)')}), 4) AS total FROM (SELECT *, unnest(range(0, 19)) AS i FROM cv) GROUP BY 1, 2, 3",
    "e7_elasticities": f"""WITH {SALES}{CURVE},
w AS (SELECT avg(PARAM_PRIX) * 0.1 AS step, coalesce((SELECT median(PARAM_PROMO_1) FROM sales WHERE PARAM_PROMO_1 > 1e-8), 1.0) AS lev,
      stddev_pop(PARAM_PRIX) >= 1e-6 AND NOT (abs(quantile_cont(PARAM_PRIX, 0.1)) > 1e-6 AND (quantile_cont(PARAM_PRIX, 0.9) - quantile_cont(PARAM_PRIX, 0.1)) / abs(quantile_cont(PARAM_PRIX, 0.1)) < 0.1) AS ok FROM sales),
px AS (SELECT {_KEY}, avg(e) AS v, stddev_pop(e) AS s FROM (SELECT *, CASE WHEN y > 0.5 THEN {_CLIP('(u - d) / y / 0.2')} END AS e FROM (SELECT cv.*, {_score()} AS y, {_score('(PARAM_PRIX + step)')} AS u, CASE WHEN PARAM_PRIX - step > 0 THEN {_score('greatest(PARAM_PRIX - step, 1e-300)')} END AS d FROM cv, w WHERE ok) WHERE d IS NOT NULL) GROUP BY 1, 2),
bx AS (SELECT {_KEY}, avg(e) AS v, stddev_pop(e) AS s FROM (SELECT *, CASE WHEN {_score(free='0.0')} > 0.5 THEN {_CLIP(f"({_score(free='1.0')} - {_score(free='0.0')}) / ({_score(free='0.0')}) * 100")} END AS e FROM cv) GROUP BY 1, 2),
lift AS (SELECT {_KEY} FROM sales GROUP BY 1, 2 HAVING NOT coalesce(abs(avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 > 1e-8) - avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 <= 1e-8)) / greatest(avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 <= 1e-8), 0.01) < 0.15, false)),
pr AS (SELECT cv.*, lev, {_score()} AS y, {_score(promo='0.0')} AS off, {_score(promo='lev')} AS yon FROM cv JOIN lift USING ({_KEY}), w),
pe AS (SELECT {_KEY}, count(r) OVER ({P}) > 0 AS ran, CASE WHEN count(r) OVER ({P}) > 0 THEN r ELSE m END AS e FROM (SELECT *, CASE WHEN PARAM_PROMO_1 > 1e-8 AND off > 0.5 THEN (y - off) / off * 100 END AS r, CASE WHEN y > 0.5 THEN (yon - y) / y * 100 END AS m FROM pr)),
pc AS (SELECT {_KEY}, ran, CASE WHEN n >= 20 THEN least(greatest(e, a), b) ELSE e END AS e FROM pe JOIN (SELECT {_KEY}, quantile_cont(e, 0.05) AS a, quantile_cont(e, 0.95) AS b, count(e) AS n FROM pe GROUP BY 1, 2) USING ({_KEY}) WHERE e IS NOT NULL),
ppx AS (SELECT {_KEY}, CASE WHEN bool_or(ran) THEN 'impact_promo' ELSE 'impact_promo_simule' END AS t, greatest(-150.0, least(150.0, median(e))) AS v, (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) / 1.349 AS s FROM pc GROUP BY 1, 2)
{_LONG.format(f='PARAM_PRIX', t="'elasticite'", x='px', sign='least(v, 0.0)')} WHERE round(least(v, 0.0), 2) <> 0 UNION ALL {_LONG.format(f='PARAM_VACANCE', t="'impact_binaire'", x='bx', sign='v')} WHERE round(v, 2) <> 0 UNION ALL {_LONG.format(f='PARAM_PROMO_1', t='t', x='ppx', sign='v')}""",
    "e10_ols_elasticity": _s(f"SELECT {_KEY}, round(e * 100, 2) AS value FROM ({_OLS('PARAM_PRIX')}) WHERE e < -1e-8"),
    "e12_slope_pm10": f"WITH {SALES}{CURVE} SELECT {_KEY}, round(avg(({_score('(PARAM_PRIX * 1.1)')} - {_score('(PARAM_PRIX * 0.9)').replace('PARAM_PROMO_1', '(PARAM_PROMO_1)')}) / (PARAM_PRIX * 0.2)), 8) AS slope FROM cv GROUP BY 1, 2",
    "e13_attribution_share": _s(f""", x AS (SELECT *, CAST(isodow(date) - 1 AS DOUBLE) AS dow, coalesce(lag(QUANTITE, 1) OVER ({W}), 0.0) AS y1 FROM sales), m AS (SELECT avg(PARAM_PRIX) AS a, avg(PARAM_PROMO_1) AS b, avg(PARAM_VACANCE) AS c, avg(dow) AS d, avg(y1) AS e FROM x),
t AS (SELECT {_KEY}, avg(abs(-0.01 * (PARAM_PRIX - a))) AS x, avg(abs(40.0 * (PARAM_PROMO_1 - b))) AS y, avg(abs(5.0 * (PARAM_VACANCE - c))) AS z, avg(abs(0.7 * (dow - d))) AS u, avg(abs(0.1 * (y1 - e))) AS v FROM x, m GROUP BY 1, 2)
SELECT * FROM (SELECT {_KEY}, unnest(['PARAM_PRIX', 'PARAM_PROMO_1', 'PARAM_VACANCE', 'y_origin_m1']) AS feature, round(unnest([x, y, z, v]) * 100 / (x + y + z + u + v), 2) AS share FROM t) WHERE share > 0.01"""),
    "a24_elasticity_summary": _s(f", e AS (SELECT round(e * 100, 2) AS v FROM ({_OLS('PARAM_PRIX')}) WHERE e < -1e-8) SELECT 'PARAM_PRIX' AS feature, count(*) AS n, round(median(v), 3) AS mediane, round(avg(v), 3) AS moyenne FROM e"),
    "a25_sign_audit": _s(f", e AS (SELECT round(e * 100, 2) AS v FROM ({_OLS('PARAM_PRIX')}) WHERE e < -1e-8) SELECT 'PARAM_PRIX' AS feature, count(*) AS n, count(*) FILTER (WHERE v > 0) AS n_faux, CASE WHEN count(*) FILTER (WHERE v > 0) / count(*) < 0.1 THEN 'OK' WHEN count(*) FILTER (WHERE v > 0) / count(*) < 0.3 THEN 'ATTENTION' ELSE 'PROBLEME' END AS verdict FROM e"),
}

_DAY = "(1 + 0.02 * w)"
_HELD = f"""WITH {SALES}{CURVE},
x AS (SELECT *, CAST(isodow(date) - 1 AS DOUBLE) AS w FROM cv),
b AS (SELECT {_KEY}, avg(PARAM_PRIX) AS m, quantile_cont(PARAM_PRIX, 0.1) AS lo, quantile_cont(PARAM_PRIX, 0.9) AS hi, count(*) FILTER (WHERE PARAM_PROMO_1 > 0) AS np, avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 > 0) AS qa,
        coalesce(avg(QUANTITE) FILTER (WHERE PARAM_PROMO_1 = 0), 0.0) AS qs, stddev_samp(PARAM_PRIX) AS sp, stddev_samp(PARAM_PROMO_1) AS sr, stddev_samp(PARAM_VACANCE) AS sv, avg(PARAM_PROMO_1) AS mr, count(*) FILTER (WHERE PARAM_VACANCE = 0) AS nz FROM x GROUP BY 1, 2),
t AS (SELECT {_KEY}, greatest(sum({_score()} * {_DAY}), 1) AS q, {", ".join(f"sum({_score(f'(lo + (hi - lo) * {i} / 4)')} * {_DAY}) AS p{i}" for i in range(1, 5))},
        {", ".join(f"sum({_score(promo=f'{i / 10}')} * {_DAY}) AS r{i}" for i in range(6))}, sum({_score('(PARAM_PRIX * 1.01)')} * {_DAY}) AS up, sum({_score(promo='least(PARAM_PROMO_1 * 1.01, 1.0)')} * {_DAY}) AS ur,
        sum({_score(free='0.0')} * {_DAY}) FILTER (WHERE PARAM_VACANCE = 0) AS z0, sum({_score(free='1.0')} * {_DAY}) FILTER (WHERE PARAM_VACANCE = 0) AS z1 FROM x JOIN b USING ({_KEY}) GROUP BY 1, 2),
g AS (SELECT *, {", ".join(f"CASE WHEN abs((lo + (hi - lo) * {i} / 4 - m) / m) > 1e-6 THEN (p{i} - q) / q / ((lo + (hi - lo) * {i} / 4 - m) / m) END AS e{i}" for i in range(1, 5))}, (r3 - r0) / greatest(r0, 1) AS ru FROM t JOIN b USING ({_KEY}))"""
_FLAG = "CASE WHEN sv < 1e-6 OR nz < 10 THEN 0.0 ELSE (z1 - z0) / greatest(z0, 1) END"
_VALUE = lambda f, e: f"SELECT {_KEY}, '{f}' AS feature, round({e}, 4) + 0.0 AS value FROM g"

SQL |= {
    "e8_series_elasticity": f"""{_HELD},
lv AS (SELECT {_KEY}, v, sum({_score()} * (1 + 0.02 * v)) AS q FROM x JOIN (SELECT DISTINCT {_KEY}, w AS v FROM x) USING ({_KEY}) GROUP BY 1, 2, 3)
{_VALUE('PARAM_PRIX', 'CASE WHEN sp < 1e-6 OR (hi - lo) / greatest(lo, 1e-6) < 0.10 THEN 0.0 ELSE coalesce(least(list_median([e1, e2, e3, e4]), 0.0), 0.0) END').replace('list_median([', "list_aggregate([").replace('])', "], 'median')")}
UNION ALL {_VALUE('PARAM_PROMO_1', 'CASE WHEN sr < 1e-6 OR np < 5 THEN 0.0 WHEN qs < 0.01 AND qa > 0 THEN 1.0 WHEN abs(qa - qs) / greatest(qs, 0.01) < 0.15 OR ru < 0.05 THEN 0.0 ELSE ru END')}
UNION ALL {_VALUE('PARAM_VACANCE', _FLAG)}
UNION ALL SELECT {_KEY}, 'PARAM_JOUR_SEMAIN' AS feature, round((quantile_cont(q, 0.75) - median(q)) / greatest(median(q), 1), 4) + 0.0 AS value FROM lv GROUP BY 1, 2""",
    "e9_series_elasticity_1pct": f"""{_HELD} {_VALUE('PARAM_PRIX', 'CASE WHEN sp < 1e-6 THEN 0.0 ELSE least((up - q) / q / 0.01, 0.0) END')}
UNION ALL {_VALUE('PARAM_PROMO_1', 'CASE WHEN sr < 1e-6 OR abs(mr) < 1e-6 THEN 0.0 ELSE greatest((ur - q) / q / 0.01, 0.0) END')} UNION ALL {_VALUE('PARAM_VACANCE', f'least(greatest({_FLAG}, -1.0), 10.0)')}""",
    "e11_perturb_single": f"""WITH {SALES}{CURVE}, m AS (SELECT {_KEY}, avg(PARAM_PRIX) * 0.1 AS sp, avg(PARAM_PROMO_1) * 0.1 AS sr FROM sales GROUP BY 1, 2),
y AS (SELECT {_KEY}, {_score()} AS y, {_score('(PARAM_PRIX + sp)')} AS pu, CASE WHEN PARAM_PRIX > sp THEN {_score('greatest(PARAM_PRIX - sp, 1e-300)')} ELSE 0.0 END AS pd, {_score(promo='(PARAM_PROMO_1 + sr)')} AS ru, {_score(promo='(PARAM_PROMO_1 - sr)')} AS rd, {_score(free='0.0')} AS z0, {_score(free='1.0')} AS z1 FROM cv JOIN m USING ({_KEY}))
SELECT * FROM (SELECT {_KEY}, 'PARAM_PRIX' AS feature, round(avg((pu - pd) / y / 0.1 / 2) FILTER (WHERE y > 1e-8), 2) + 0.0 AS value FROM y GROUP BY 1, 2
UNION ALL SELECT {_KEY}, 'PARAM_PROMO_1', round(avg((ru - rd) / y / 0.1 / 2) FILTER (WHERE y > 1e-8), 2) + 0.0 FROM y GROUP BY 1, 2
UNION ALL SELECT {_KEY}, 'PARAM_VACANCE', round(median((z1 - z0) / z0 * 100) FILTER (WHERE z0 > 0.5), 2) + 0.0 FROM y GROUP BY 1, 2) WHERE abs(value) > 1e-8""",
    "w19_fill_next_day": _s(f"SELECT {_KEY}, ordre, CAST(last_value(d IGNORE NULLS) OVER u + CAST(ordre - last_value(o IGNORE NULLS) OVER u AS INTEGER) AS DATE) AS date FROM (SELECT *, CASE WHEN d IS NOT NULL THEN ordre END AS o FROM (SELECT {_KEY}, row_number() OVER ({W}) AS ordre, CASE WHEN day(date) % 3 > 0 THEN date END AS d FROM sales)) WINDOW u AS (PARTITION BY {_KEY} ORDER BY ordre ROWS UNBOUNDED PRECEDING)"),
    "m19_forecast_by_version": _s(f", v AS (SELECT DISTINCT {_KEY}, CAST(date_trunc('month', date) AS DATE) AS d FROM sales WHERE month(date) IN (1, 7)), c AS (SELECT v.ID_PRODUIT, v.ID_SO, v.d, regr_intercept(QUANTITE, PARAM_PRIX) AS a, regr_slope(QUANTITE, PARAM_PRIX) AS b FROM v LEFT JOIN sales s ON s.ID_PRODUIT = v.ID_PRODUIT AND s.ID_SO = v.ID_SO AND s.date <= v.d GROUP BY 1, 2, 3) SELECT s.ID_PRODUIT, s.ID_SO, s.date, c.d AS version, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE greatest(a + b * PARAM_PRIX, 0.0) END, 4) AS prediction FROM (SELECT *, max(date) OVER ({P}) AS last FROM sales) s ASOF JOIN c ON s.ID_PRODUIT = c.ID_PRODUIT AND s.ID_SO = c.ID_SO AND s.date >= c.d WHERE s.date < last"),
}
SQL["e16_elasticity_export"] = _d(f"""SELECT r.ID_PRODUIT, r.ID_SO, round(avg(abs(n.p - n.QUANTITE)), 5) AS MAE, any_value(SHAP_PARAM_PRIX) AS SHAP_PARAM_PRIX, any_value(ELAST_PARAM_PRIX) AS ELAST_PARAM_PRIX, any_value(TYPE_PARAM_PRIX) AS TYPE_PARAM_PRIX, min(n.date) AS DATE_HIST_MIN, max(n.date) AS DATE_HIST_MAX, any_value(profil_demande) AS CLASSE_SB, 'curve' AS MODELE, 1 AS OK
FROM rep r JOIN naive n USING ({_KEY}) LEFT JOIN (SELECT {_KEY}, share AS SHAP_PARAM_PRIX FROM (SELECT {_KEY}, round(x * 100 / (x + y + z), 2) AS share FROM (SELECT {_KEY}, avg(abs(-0.01 * (PARAM_PRIX - a))) AS x, avg(abs(40.0 * (PARAM_PROMO_1 - b))) AS y, avg(abs(5.0 * (PARAM_VACANCE - c))) AS z FROM sales, (SELECT avg(PARAM_PRIX) AS a, avg(PARAM_PROMO_1) AS b, avg(PARAM_VACANCE) AS c FROM sales) GROUP BY 1, 2)) WHERE share > 0.01) USING ({_KEY})
LEFT JOIN (SELECT {_KEY}, value AS ELAST_PARAM_PRIX, type AS TYPE_PARAM_PRIX FROM ({SQL['e7_elasticities']}) WHERE feature = 'PARAM_PRIX' AND value <> 0) USING ({_KEY}) GROUP BY 1, 2""", NAIVE + STATS)
SQL |= {
    "e14_mean_attribution": _s(f", m AS (SELECT avg(PARAM_PRIX) AS a, avg(PARAM_PROMO_1) AS b FROM sales) SELECT {_KEY}, 'PARAM_PRIX' AS feature, round(avg(-0.01 * (PARAM_PRIX - a)), 6) + 0.0 AS attribution FROM sales, m GROUP BY 1, 2 UNION ALL SELECT {_KEY}, 'PARAM_PROMO_1', round(avg(40.0 * (PARAM_PROMO_1 - b)), 6) + 0.0 FROM sales, m GROUP BY 1, 2"),
    "w14_split_at_fraction": _s(f"SELECT {_KEY}, k > floor(n * 0.75) AS is_test, count(*) AS n, min(date) AS d0 FROM (SELECT *, row_number() OVER ({W}) AS k, count(*) OVER ({P}) AS n FROM sales) GROUP BY 1, 2, 3"),
    "e18_product_profile": _d(f"SELECT o.ID_PRODUIT, o.ID_SO, value, profil FROM ({{ols}}) o JOIN ({{seg}}) s USING ({_KEY})").replace("{ols}", f"SELECT {_KEY}, round(e * 100, 2) AS value FROM ({_OLS('PARAM_PRIX')}) WHERE e < -1e-8").replace("{seg}", SQL["a8_demand_segment"]),
}

# The roles that names have, one for each rule.
ROLES = {
    "PARAM_JS_1": "binary", "PARAM_VACANCE": "binary", "est_promo": "binary", "PARAM_PROMO_1": "promo", "PARAM_PRIX": "continuous", "discount_pct": "continuous", "log_prix": "continuous", "jour": "continuous", "weekend": "continuous",
    "PARAM_ANNEE": "excluded", "PARAM_MOIS": "excluded", "dow": "excluded", "mois": "excluded", "semaine": "excluded", "jour_annee": "excluded", "sin_jour": "excluded", "cos_mois": "excluded", "y_origin_m7": "excluded", "roll_mean_28": "excluded", "mean_dow_today": "excluded", "ratio_dow": "excluded",
}
_EST = f"WITH {SALES}, m AS (SELECT date, {_KEY}, QUANTITE, strftime(date, '%Y-%m') AS mois FROM sales)"
SQL |= {
    "p1_coerce_numeric": "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) || '.0' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS x FROM part",
    "p2_date_from_parts": "WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) + o_orderkey % 4 AS j FROM orders) SELECT o_orderkey, CASE WHEN y >= 2000 AND j <= 31 AND TRY_CAST(y || '-' || m || '-' || j AS DATE) - DATE '1998-06-01' BETWEEN 0 AND 999 THEN TRY_CAST(y || '-' || m || '-' || j AS DATE) END AS date FROM d",
    "p3_valid_sales": _s(f"SELECT {_KEY}, count(*) AS n, sum(QUANTITE) AS q FROM sales WHERE CAST(QUANTITE AS BIGINT) % 7 <> 0 AND ID_SO <> 2 GROUP BY 1, 2"),
    "p4_usable_target": _s(f"SELECT {_KEY}, count(*) FILTER (WHERE QUANTITE >= 30) AS n_train, sum(QUANTITE - 30) FILTER (WHERE QUANTITE >= 30) AS q_train, count(*) AS n_clip, sum(greatest(QUANTITE - 30, 0.0)) AS q_clip FROM sales GROUP BY 1, 2"),
    "p5_fill_or_drop_nulls": _d(f"SELECT {_KEY}, count(*) AS n_fill, count(PARAM_PRIX) AS n_drop, round(sum(PARAM_PROMO_1), 6) AS s FROM dense GROUP BY 1, 2"),
    "p7_drop_uninformative": _d("SELECT c AS colonne FROM (SELECT unnest(['QUANTITE', 'PARAM_PRIX', 'PARAM_RARE', 'PARAM_STOCK']) AS c, unnest([count(DISTINCT QUANTITE) > 1 AND count(QUANTITE) >= count(*) * 0.5, count(DISTINCT PARAM_PRIX) > 1 AND count(PARAM_PRIX) >= count(*) * 0.5, count(DISTINCT PARAM_PRIX) FILTER (WHERE dayofmonth(date) = 1) > 1 AND count(PARAM_PRIX) FILTER (WHERE dayofmonth(date) = 1) >= count(*) * 0.5, false]) AS k FROM dense) WHERE k"),
    "p10_align_features": _s(f"SELECT {_KEY}, date, 0.0::DOUBLE AS PARAM_ABSENT, PARAM_PROMO_1 FROM sales"),
    "p12_feature_role": _s("SELECT feature, role, count(*) AS n FROM sales, (SELECT unnest([" + ", ".join(f"'{f}'" for f in ROLES) + "]) AS feature, unnest([" + ", ".join(f"'{r}'" for r in ROLES.values()) + "]) AS role) GROUP BY 1, 2"),
    "p13_normalize_feature_name": "SELECT p_type AS nom, CASE WHEN p_partkey % 2 = 0 THEN 'PARAM_' || lower(p_type) ELSE 'PARAM_' || upper(p_type) END AS feature, count(*) AS n FROM part GROUP BY 1, 2",
    "e5_calendar_unit": f"""WITH {SALES}{CURVE}, e AS (SELECT {_KEY}, CASE WHEN y > 0.5 THEN {_CLIP('(u - d) / y / 2 * 100')} END AS e FROM (SELECT {_KEY}, {_score()} * (1 + 0.02 * (year(date) - 1990)) AS y, {_score()} * (1 + 0.02 * (year(date) - 1989)) AS u, {_score()} * (1 + 0.02 * (year(date) - 1991)) AS d FROM cv)),
x AS (SELECT {_KEY}, median(e) AS v, (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) / 1.349 AS s FROM e WHERE e IS NOT NULL GROUP BY 1, 2) {_LONG.format(f='PARAM_ANNEE', t="'impact_annuel'", x='x', sign='v')} WHERE round(v, 2) <> 0""",
    "e0_observations": _s(f", r AS (SELECT * FROM sales WHERE (SELECT max(date) FROM sales) - date < 90), k AS (SELECT {_KEY} FROM r GROUP BY 1, 2 HAVING count(*) >= 30) SELECT {_KEY}, date, QUANTITE, PARAM_PRIX, CAST(month(date) AS INTEGER) AS mois, 0.0::DOUBLE AS PARAM_ABSENT FROM r JOIN k USING ({_KEY})"),
    "a10_first_nomenclature": _s(f"SELECT {_KEY}, min_by(n, date) AS ID_NOMENCLATURE FROM (SELECT *, CASE WHEN dayofmonth(date) % 3 = 0 THEN CAST(month(date) AS INTEGER) END AS n FROM sales) WHERE n IS NOT NULL GROUP BY 1, 2"),
    "a27_benchmark_summary": _d(f", e AS (SELECT {_KEY}, round(avg(abs(p - QUANTITE)), 4) AS a, round(avg(abs(q - QUANTITE)), 4) AS b FROM (SELECT *, lag(QUANTITE, 1) OVER ({W}) AS q FROM naive) WHERE p IS NOT NULL AND ID_SO <> 3 GROUP BY 1, 2) SELECT n, global_gagne, perprod_gagne, CAST(sign(s) * ((20 * abs(s) + n) // (2 * n)) AS DOUBLE) / 100000 AS delta_moyen FROM (SELECT count(*) AS n, count(*) FILTER (WHERE round(a - b, 4) > 0) AS global_gagne, count(*) FILTER (WHERE round(a - b, 4) <= 0) AS perprod_gagne, CAST(sum(CAST(round((a - b) * 10000) AS BIGINT)) AS BIGINT) AS s FROM e)", NAIVE),
    "a29_latest_training": f"{_EST}, l AS (SELECT ID_PRODUIT AS id_produit, ID_SO AS id_so, date_trunc('month', date)::DATE AS d, round(stddev_pop(QUANTITE), 6) AS rmse, w AS model_name FROM (SELECT *, unnest(['lundi', 'autre']) AS w FROM m) WHERE (isodow(date) = 1) = (w = 'lundi') GROUP BY ALL) SELECT id_produit, id_so, d AS date_entrainement, model_name, rmse AS rmse_train FROM (SELECT *, row_number() OVER (PARTITION BY id_produit, id_so ORDER BY d DESC, rmse, model_name) AS k FROM l) WHERE k = 1",
    "t8_compare_elasticities": _s(f", o AS (SELECT {_KEY}, 'PARAM_PRIX' AS feature, round(e * 100, 2) AS ols FROM ({_OLS('PARAM_PRIX')}) WHERE e < -1e-8 UNION ALL SELECT {_KEY}, 'PARAM_PROMO_1', round(e * 100, 2) FROM ({_OLS('PARAM_PROMO_1')}) WHERE e > 1e-8), g AS (SELECT {_KEY}, 'PARAM_PRIX' AS feature, round(e * 100, 2) AS promo FROM ({_OLS('PARAM_PRIX', '(SELECT * FROM sales WHERE PARAM_PROMO_1 > 0)')}) WHERE e < -1e-8) SELECT {_KEY}, feature, ols, promo FROM o FULL JOIN g USING ({_KEY}, feature)"),
    "w20_unscale_series": _s(f"SELECT {_KEY}, date, round(QUANTITE, 6) AS QUANTITE FROM sales"),
    "s14_forecast_json": _s(f"SELECT {_KEY}, '[' || string_agg('{{\"date\":\"' || strftime(date, '%d/%m/%Y') || '\",\"value\":\"' || CAST(QUANTITE AS VARCHAR) || '\"}}', ',' ORDER BY date) || ']' AS forecast FROM sales WHERE year(date) = 1999 GROUP BY 1, 2"),
}
SQL["w21_holdout_slice"] = f"WITH s AS ({SQL['m3_direct_samples']}) SELECT {_KEY}, _origin_date, _target_date, horizon, y FROM s WHERE NOT _is_test AND (SELECT max(_target_date) FROM s WHERE NOT _is_test) - _target_date < 10"
_LINES = "SELECT l_partkey AS ID_PRODUIT, l_suppkey AS ID_SO, CAST(l_shipdate AS DATE) AS date, l_quantity AS q FROM lineitem"
SQL |= {
    "s1_kv_text": _s(f"SELECT {_KEY}, count(*) AS n, sum(QUANTITE) AS q, round(sum(PARAM_PROMO_1), 4) AS s FROM sales GROUP BY 1, 2"),
    "s4_semicolon_csv": _s(f"SELECT {_KEY}, date, QUANTITE FROM sales"),
    "s5_series_class": f"SELECT {_KEY}, CASE WHEN count(*) >= 8 THEN 'smooth' ELSE 'lumpy' END AS classification FROM ({_LINES}) GROUP BY 1, 2",
    "s7_by_class": _d(f"SELECT {_KEY}, profil_demande AS sb_class, nb_records, round(somme, 2) AS somme FROM rep", STATS),
    "s8_sample_cache": _s("SELECT CASE WHEN QUANTITE > 50 THEN 'erratic' ELSE 'smooth' END AS sb_class, CAST(year(date) >= 1998 AS INTEGER) AS is_test, count(*) AS n, sum(QUANTITE) AS q FROM sales GROUP BY 1, 2"),
    "s11_kv_by_nomenclature": _s(f"SELECT {_KEY}, CASE WHEN ID_SO = 2 THEN 'unknown' ELSE CAST(ID_SO * 100 AS VARCHAR) END AS ID_NOMENCLATURE, count(*) AS n FROM sales GROUP BY 1, 2, 3"),
    "s13_payloads": f"SELECT {_KEY}, date, greatest(sum(q) - 20, 0.0) AS QUANTITE FROM ({_LINES}) GROUP BY 1, 2, 3",
    "s16_run_metadata": _d("SELECT profil_demande, count(*) AS n, CAST(sum(nb_records) AS BIGINT) AS lignes, (SELECT min(date) FROM sales) AS date_min, (SELECT max(date) FROM sales) AS date_max, 'PARAM_PRIX,PARAM_PROMO_1,PARAM_VACANCE' AS features, '{\"depth\": 4}' AS params FROM rep GROUP BY 1", STATS),
    "p11_select_sales_columns": _s(f"SELECT {_KEY}, date, QUANTITE, PARAM_PROMO_1 FROM sales"),
    "r2_stream_class_updates": _d(f"SELECT {_KEY}, profil_demande, nb_records AS n, somme, (SELECT sum(QUANTITE * QUANTITE) FROM dense x WHERE x.ID_PRODUIT = rep.ID_PRODUIT AND x.ID_SO = rep.ID_SO) AS carres, somme AS somme_nz, nb_records_avec_vente AS n_nz, nb_jours_obs, nb_jours_demand FROM rep", STATS),
    "r3_stream_daily_demand": "SELECT CAST(ts AS DATE) AS day, event_type, user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
    "r4_stream_score": _s(f", l AS (SELECT regr_slope(QUANTITE, PARAM_PRIX) AS b, regr_intercept(QUANTITE, PARAM_PRIX) AS a FROM sales WHERE year(date) < 1998) SELECT {_KEY}, date, round(greatest(a + b * PARAM_PRIX, 0.0), 4) AS prediction FROM sales, l WHERE year(date) >= 1998"),
}


def _fitted(name: str, rows: str, features: list[str], keys: str = _KEY, ridge: float = 0.0) -> str:
    """CTEs that end with ``name``: weights w1, w2, … and intercept b of a least-squares fit for each key, by Gauss-Jordan elimination of the moments."""
    p, out = len(features), []
    cols = [*features, "QUANTITE"]
    moments = [f"avg({c}) AS m{i}" for i, c in enumerate(cols)] + [f"covar_pop({a}, {b}) AS c{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i] + [f"sqrt(var_pop({c})) AS s{i}" for i, c in enumerate(features)]
    means = ", ".join(f"m{i}" for i in range(p + 1)) + ", " + ", ".join(f"s{i}" for i in range(p))
    out.append(f"{name}_m AS MATERIALIZED (SELECT {keys}, count(*) AS n, {', '.join(moments)} FROM {rows} GROUP BY ALL)")
    cell = lambda i, j: f"n * c{min(i, j)}_{max(i, j)} / s{i}" + (f" / s{j}" if j < p else "") + (f" + {ridge}" if i == j else "")
    out.append(f"{name}_0 AS MATERIALIZED (SELECT {keys}, {means}, {', '.join(f'{cell(i, j)} AS a{i}_{j}' for i in range(p) for j in range(p + 1))} FROM {name}_m)")
    for k in range(p):
        step = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(p) for j in range(p + 1)]
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {keys}, {means}, {', '.join(step)} FROM {name}_{k})")
    weights = ", ".join(f"a{i}_{p} / s{i} AS w{i + 1}" for i in range(p))
    out.append(f"{name} AS MATERIALIZED (SELECT *, m{p} - {' - '.join(f'w{i + 1} * m{i}' for i in range(p))} AS b FROM (SELECT {keys}, {', '.join(f'm{i}' for i in range(p + 1))}, {weights} FROM {name}_{p}))")
    return ", ".join(out)


def _weights(features: list[str], digits: int) -> str:
    named = ", ".join(f"'{f}'" for f in [*features, "intercept"])
    values = ", ".join([*[f"w{i + 1}" for i in range(len(features))], "b"])
    return f"SELECT {_KEY}, unnest([{named}]) AS feature, round(unnest([{values}]), {digits}) + 0.0 AS weight FROM fit"


_THREE = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE"]
_FIVE = ["PARAM_PRIX", "PARAM_PROMO_1", "PARAM_VACANCE", "dow", "y1"]
_SIGNED = lambda i, f: f"w{i} * m{i - 1} / m5" if f not in ("PARAM_PRIX", "PARAM_PROMO_1") else f"{'least' if f == 'PARAM_PRIX' else 'greatest'}(w{i} * m{i - 1} / m5, 0.0)"
SQL |= {
    "m17_ols": f"WITH {SALES}, {_fitted('fit', 'sales', ['PARAM_PRIX', 'PARAM_PROMO_1'])} {_weights(['PARAM_PRIX', 'PARAM_PROMO_1'], 5)}",
    "m8_fit_per_series": f"WITH {SALES}, {_fitted('fit', 'sales', _THREE, ridge=1e-3)} {_weights(_THREE, 4)}",
    "m14_fit_arx": f"WITH {SALES}, x AS (SELECT *, coalesce(lag(QUANTITE, 1) OVER ({W}), 0.0) AS ar_1, CAST(row_number() OVER ({W}) AS DOUBLE) AS t FROM sales), {_fitted('fit', 'x', ['ar_1', 't', *_THREE], ridge=1e-3)} {_weights(['ar_1', 't', *_THREE], 4)}",
    "e10_ols_of_features": f"WITH {SALES}, x AS (SELECT *, CAST(isodow(date) - 1 AS DOUBLE) AS dow, coalesce(lag(QUANTITE, 1) OVER ({W}), 0.0) AS y1 FROM sales), {_fitted('fit', 'x', _FIVE)} SELECT {_KEY}, feature, round(e * 100, 2) AS value FROM (SELECT {_KEY}, unnest(['PARAM_PRIX', 'PARAM_PROMO_1', 'PARAM_VACANCE', 'y_origin_m1']) AS feature, unnest([{', '.join(_SIGNED(i, f) for i, f in enumerate(_FIVE, 1) if f != 'dow')}]) AS e FROM fit) WHERE abs(e) > 1e-8",
    "e1_price_range": f"WITH {SALES}{CURVE} SELECT {_KEY}, 'PRIX_' || (i + 1) AS scenario, round(sum({_score('(lo + (hi - lo) * i / 4)')}), 4) AS total FROM (SELECT cv.*, lo, hi, unnest([0, 1, 2, 3, 4]) AS i FROM cv JOIN (SELECT {_KEY}, min(PARAM_PRIX) AS lo, max(PARAM_PRIX) AS hi FROM sales GROUP BY 1, 2) USING ({_KEY})) GROUP BY 1, 2, 3",
    "e2_one_promo": f"WITH {SALES}{CURVE} SELECT {_KEY}, 'PROMO_' || (5 * i) AS scenario, round(sum({_score(promo='(i / 20)')}), 4) AS total FROM (SELECT *, unnest(range(0, 19)) AS i FROM cv) GROUP BY 1, 2, 3",
}
_RAW = f"""WITH {SALES}, r AS (SELECT CASE WHEN dayofyear(date) % 11 <> 0 THEN ID_PRODUIT END AS ID_PRODUIT, CASE WHEN dayofyear(date) % 7 <> 0 OR ID_SO <> 2 THEN ID_SO END AS ID_SO, year(date) + 20 AS y, month(date) AS m, day(date) + ID_SO % 4 AS j, CASE WHEN dayofyear(date) % 13 <> 0 THEN QUANTITE END AS q FROM sales),
i AS (SELECT *, CASE WHEN j <= 31 AND TRY_CAST(y || '-' || m || '-' || j AS DATE) - DATE '2018-01-01' BETWEEN 0 AND 1099 THEN TRY_CAST(y || '-' || m || '-' || j AS DATE) END AS date FROM r),
k AS (SELECT * FROM i WHERE ID_PRODUIT IS NOT NULL AND q IS NOT NULL AND ID_SO IS NOT NULL),
c AS (SELECT count(*) AS lignes, count(*) FILTER (WHERE ID_PRODUIT IS NULL OR q IS NULL) AS sans_produit, count(*) FILTER (WHERE ID_PRODUIT IS NOT NULL AND q IS NOT NULL AND ID_SO IS NULL) AS sans_so, count(*) FILTER (WHERE ID_PRODUIT IS NOT NULL AND q IS NOT NULL AND ID_SO IS NOT NULL AND date IS NULL) AS dates_invalides FROM i)"""
SQL |= {
    "a6_counted_ingest": f"{_RAW} SELECT c.*, gardees, produits, couples, date_min, date_max FROM c, (SELECT count(*) AS gardees, count(DISTINCT ID_PRODUIT) AS produits, count(DISTINCT (ID_PRODUIT, ID_SO)) AS couples, min(date) AS date_min, max(date) AS date_max FROM k)",
    "r3_stream_ingest": f"{_RAW} SELECT {_KEY}, gardees, datees, c.* FROM (SELECT {_KEY}, count(*) AS gardees, count(date) AS datees FROM k GROUP BY 1, 2), c",
    "s2_kv_archives": _s(f"SELECT CAST(ID_SO * 100 + 7 AS INTEGER) AS ID_NOMENCLATURE, {_KEY}, count(*) AS n, sum(QUANTITE) AS q FROM sales GROUP BY 1, 2, 3"),
}


def _pushed(name: str, rows: str, raw: str, weights: list[str]) -> str:
    """CTE of the effect in % of steps of a tenth of the mean of price and promotion on a linear prediction ``raw``, by couple."""
    ys = {f: (f"greatest({raw} + {w} * {step}, 0)", f"greatest({raw} - {w} * {step}, 0)") for f, w, step in zip("pr", weights, ("sp", "sr"))}
    effects = ", ".join(f"round(avg(({u} - {d}) / greatest({raw}, 0) / 0.2) FILTER (WHERE {raw} > 1e-8), 2) AS {f}" for f, (u, d) in ys.items())
    steps = ", ".join(f"CASE WHEN abs(avg({c}) OVER ({P})) > 1e-8 THEN avg({c}) OVER ({P}) * 0.1 WHEN stddev_pop({c}) OVER ({P}) > 1e-8 THEN stddev_pop({c}) OVER ({P}) * 0.1 END AS {n}" for c, n in (("PARAM_PRIX", "sp"), ("PARAM_PROMO_1", "sr")))
    return f"{name} AS (SELECT {_KEY}, {effects} FROM (SELECT *, {steps} FROM {rows}) GROUP BY 1, 2)"


_LINE = lambda t: f"{t}b + " + " + ".join(f"{t}{i} * {c}" for i, c in enumerate(_THREE, 1))
_OWN = lambda t, fit: ", ".join([f"{fit}.w{i} AS {t}{i}" for i in (1, 2, 3)] + [f"{fit}.b AS {t}b"])
_ERROR = lambda y, n: f"round(avg(abs(greatest({y}, 0) - QUANTITE)) FILTER (WHERE is_test), 4) AS MAE_{n}, round(sqrt(avg(pow(greatest({y}, 0) - QUANTITE, 2)) FILTER (WHERE is_test)), 4) AS RMSE_{n}"
_SEEN = lambda e: f"CASE WHEN abs({e}) > 1e-8 THEN {e} END"
SQL["e17_compare_lines"] = f"""WITH {SALES}, s AS (SELECT *, max(date) OVER ({P}) AS last FROM sales), tr AS (SELECT *, 1 AS tous FROM s WHERE date <= last - 31), {_fitted('g', 'tr', _THREE, 'tous')},
pick AS (SELECT {_KEY} FROM (SELECT *, row_number() OVER (ORDER BY v DESC, {_KEY}) - 1 AS r, count(*) OVER () AS n FROM (SELECT {_KEY}, sum(QUANTITE) AS v FROM tr GROUP BY 1, 2)) WHERE list_contains(list_transform(range(0, 7), lambda i: CAST(round_even(i * (n - 1) / 6, 0) AS BIGINT)), r)),
a AS (SELECT s.*, date > last - 30 AS t0, date <= last - 31 AS r0, row_number() OVER (PARTITION BY {_KEY} ORDER BY date DESC) AS back FROM s JOIN pick USING ({_KEY})),
f AS (SELECT *, count(*) FILTER (WHERE t0) OVER ({P}) < 5 OR count(*) FILTER (WHERE r0) OVER ({P}) < 30 AS few, count(*) FILTER (WHERE date > last - 90) OVER ({P}) AS late FROM a),
x AS MATERIALIZED (SELECT *, CASE WHEN few THEN back <= 30 ELSE t0 END AS is_test, CASE WHEN few THEN back > 30 ELSE r0 END AS is_train FROM f),
{_fitted('o', '(SELECT * FROM x WHERE is_train)', _THREE, ridge=1e-3)}, {_fitted('l', 'x', _THREE)},
y AS MATERIALIZED (SELECT x.*, {_OWN('u', 'o')}, {_OWN('v', 'g')} FROM x JOIN o USING ({_KEY}), g),
e AS (SELECT {_KEY}, count(*) FILTER (WHERE is_train) AS n_train, count(*) FILTER (WHERE is_test) AS n_test, {_ERROR(_LINE('u'), 'perprod')}, {_ERROR(_LINE('v'), 'global')} FROM y GROUP BY 1, 2),
{_pushed('pp', 'y', _LINE('u'), ['u1', 'u2'])}, {_pushed('gl', '(SELECT * FROM y WHERE date > last - 90 OR late < 30)', _LINE('v'), ['v1', 'v2'])},
k AS (SELECT {_KEY}, least(w1 * m0 / m3, 0.0) AS p, greatest(w2 * m1 / m3, 0.0) AS r FROM l)
SELECT {_KEY}, n_train, n_test, MAE_perprod, RMSE_perprod, CASE WHEN n_test >= 5 THEN MAE_global END AS MAE_global, CASE WHEN n_test >= 5 THEN RMSE_global END AS RMSE_global, CASE WHEN n_test >= 5 THEN round(MAE_perprod - MAE_global, 4) END AS delta_MAE,
CASE WHEN k.p < -1e-8 THEN round(k.p * 100, 2) END AS ELAST_PRIX_ols, {_SEEN('pp.p')} AS ELAST_PRIX_pert_pp, {_SEEN('gl.p')} AS ELAST_PRIX_global, CASE WHEN k.r > 1e-8 THEN round(k.r * 100, 2) END AS ELAST_PROMO_ols, {_SEEN('pp.r')} AS ELAST_PROMO_pert_pp, {_SEEN('gl.r')} AS ELAST_PROMO_global
FROM e LEFT JOIN k USING ({_KEY}) LEFT JOIN pp USING ({_KEY}) LEFT JOIN gl USING ({_KEY})"""
SQL |= {
    "s3_nomenclature": "SELECT CAST(substr(f, 15, strpos(substr(f, 15), '_') - 1) AS INTEGER) AS nomenclature, CAST(regexp_extract(f, '_(\\d+)\\.zip$', 1) AS INTEGER) AS fichier, count(*) AS n FROM (SELECT 'data_CENTRALE_' || p_size || '_' || (p_partkey % 7) || '.zip' AS f FROM part) GROUP BY 1, 2",
    "p6_numeric_columns": "SELECT 'lineitem' AS t, unnest(['l_discount', 'l_extendedprice', 'l_linenumber', 'l_quantity', 'l_tax']) AS colonne, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'part', unnest(['p_retailprice', 'p_size']), count(*) FROM part GROUP BY 1",
    "p9_narrow_types": "SELECT 'QUANTITE' AS colonne, 'float' AS type, CAST(min(l_quantity) AS DOUBLE) AS a, CAST(max(l_quantity) AS DOUBLE) AS b FROM lineitem UNION ALL SELECT 'cle', 'int', CAST(min(l_orderkey) AS DOUBLE), CAST(max(l_orderkey) AS DOUBLE) FROM lineitem UNION ALL SELECT 'large', 'bigint', CAST(min(l_orderkey) * 1000003 AS DOUBLE) * 1000, CAST(max(l_orderkey) * 1000003 AS DOUBLE) * 1000 FROM lineitem",
    "p17_exogenous": _s("SELECT unnest(['PARAM_PRIX', 'PARAM_PROMO_1', 'PARAM_VACANCE']) AS colonne, unnest([round(sum(PARAM_PRIX), 2), round(sum(PARAM_PROMO_1), 2), round(sum(PARAM_VACANCE), 2)]) AS total FROM sales"),
    "t2_top_features": f"WITH {SALES} SELECT feature, round(importance, 5) AS importance FROM (SELECT unnest(['PARAM_PRIX', 'PARAM_PROMO_1', 'PARAM_VACANCE', 'dow', 'mois']) AS feature, unnest([abs(corr(QUANTITE, PARAM_PRIX)), abs(corr(QUANTITE, PARAM_PROMO_1)), abs(corr(QUANTITE, PARAM_VACANCE)), abs(corr(QUANTITE, isodow(date))), abs(corr(QUANTITE, month(date)))]) AS importance FROM sales) ORDER BY importance DESC LIMIT 3",
    "t3_first_files": _s("SELECT CAST(ID_SO * 100 + 7 AS INTEGER) AS ID_NOMENCLATURE, count(*) AS n FROM sales WHERE ID_SO IN (SELECT ID_SO FROM (SELECT DISTINCT ID_SO FROM sales) ORDER BY 'data_CENTRALE_' || (ID_SO * 100 + 7) || '_0.zip' LIMIT 3) GROUP BY 1"),
}
