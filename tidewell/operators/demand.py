"""Demand statistics and classes of product-store series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.schema import ADI_LIMIT, CV2_LIMIT, K


def daily_sales(df: DataFrame) -> DataFrame:
    return df.groupBy(*K, "date").agg(F.sum("QUANTITE").alias("QUANTITE"))


def dense_calendar(df: DataFrame) -> DataFrame:
    """A row for each day between a series' first and last; quantity 0 on the added ones."""
    span = df.groupBy(*K).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = span.select(*K, F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.join(df, [*K, "date"], "left").withColumn("QUANTITE", F.coalesce("QUANTITE", F.lit(0.0)))


def series_stats(df: DataFrame, by: list[str] = K) -> DataFrame:
    """Counts, sum, mean, population deviation and cv over all rows and over rows with demand."""
    q, some = F.col("QUANTITE"), F.when(F.col("QUANTITE") > 0, F.col("QUANTITE"))
    cv = lambda s, m: F.when(F.col(m) > 0, F.col(s) / F.col(m))
    out = df.groupBy(*by).agg(
        F.count("*").alias("nb_records"), F.count(some).alias("nb_records_avec_vente"), F.sum(q).alias("somme"),
        F.avg(q).alias("moyenne_all"), F.stddev_pop(q).alias("ecart_type_all"), F.avg(some).alias("moyenne_nz"), F.stddev_pop(some).alias("ecart_type_nz"),
        F.count_distinct("date").alias("nb_jours_obs"), F.count_distinct(F.when(q > 0, F.col("date"))).alias("nb_jours_demand"),
    )
    return out.withColumn("cv_all", cv("ecart_type_all", "moyenne_all")).withColumn("cv_nz", cv("ecart_type_nz", "moyenne_nz"))


def classify_demand(adi: Column, cv2: Column) -> Column:
    """Null cv2 or null (infinite) adi is indetermine."""
    return (
        F.when(adi.isNull() | cv2.isNull(), "indetermine")
        .when((adi < ADI_LIMIT) & (cv2 < CV2_LIMIT), "smooth")
        .when((adi >= ADI_LIMIT) & (cv2 < CV2_LIMIT), "intermittent")
        .when((adi < ADI_LIMIT) & (cv2 >= CV2_LIMIT), "erratic")
        .otherwise("lumpy")
    )


def sales_stats_report(df: DataFrame) -> DataFrame:
    """Statistics, ADI, squared cv and class of each series; means to 4 digits, sums to 2."""
    out = series_stats(df).withColumn("adi", F.try_divide("nb_jours_obs", "nb_jours_demand")).withColumn("cv2", F.col("cv_nz") * F.col("cv_nz"))
    out = out.withColumn("profil_demande", classify_demand(F.col("adi"), F.col("cv2")))
    four = ["moyenne_all", "ecart_type_all", "cv_all", "moyenne_nz", "ecart_type_nz", "cv_nz", "adi", "cv2"]
    return out.withColumns({c: F.round(c, 4) for c in four} | {"somme": F.round("somme", 2)})


def class_distribution(classes: DataFrame, names: list[str]) -> DataFrame:
    """Count and share of each class; classes without series stay with 0."""
    every = classes.sparkSession.createDataFrame([(i, c) for i, c in enumerate(names)], "rang int, classe string")
    n = classes.groupBy(F.col("profil_demande").alias("classe")).agg(F.count("*").alias("n"))
    out = every.join(n, "classe", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4)).select("classe", "n", "pct")


def date_gap_report(df: DataFrame) -> DataFrame:
    out = df.groupBy(*K).agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count_distinct("date").alias("nb_jours_presents"))
    out = out.withColumn("nb_jours_attendus", (F.datediff("date_max", "date_min") + 1).cast("long")).filter("nb_jours_attendus >= 2")
    out = out.withColumn("nb_jours_manquants", F.col("nb_jours_attendus") - F.col("nb_jours_presents"))
    return out.withColumn("taux_couverture_pct", F.round(100.0 * F.col("nb_jours_presents") / F.col("nb_jours_attendus"), 1))


def demand_segment(df: DataFrame) -> DataFrame:
    """Serving form: row-based ADI, sample deviation, four labels; no sale gives lumpy 999."""
    some = F.when(F.col("QUANTITE") > 0, F.col("QUANTITE"))
    out = df.groupBy(*K).agg(F.count("*").alias("n"), F.count(some).alias("k"), F.avg(some).alias("m"), F.stddev_samp(some).alias("s"))
    adi, cv2 = F.try_divide("n", "k"), F.pow(F.col("s") / F.greatest("m", F.lit(1e-6)), 2.0)
    label = F.when(F.col("k") == 0, "lumpy").when((adi <= ADI_LIMIT) & (cv2 <= CV2_LIMIT), "fast_regulier").when((adi <= ADI_LIMIT) & (cv2 > CV2_LIMIT), "fast_irregulier").when((adi > ADI_LIMIT) & (cv2 <= CV2_LIMIT), "slow").otherwise("lumpy")
    none = F.col("k") == 0
    return out.select(*K, label.alias("profil"), F.when(none, 999.0).otherwise(F.round(adi, 3)).alias("adi"), F.when(none, 999.0).otherwise(F.round(cv2, 3)).alias("cv2"))


def volume_stratified_pick(volumes: DataFrame, k: int) -> DataFrame:
    """k couples of each class at evenly spaced volume ranks, the largest first."""
    w = Window.partitionBy("classe").orderBy(F.col("volume").desc(), *K)
    ranked = volumes.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("classe")))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(k - 1, 1)).cast("int"))
    return ranked.filter(F.array_contains(steps, F.col("_r"))).drop("_r", "_n")
