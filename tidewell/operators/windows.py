"""Row-positional features of series; all use one window, so one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.schema import HORIZONS, K, LAGS, MIN_ROWS, ROLLING, STRIDE, TEST_DAYS



def by_date() -> WindowSpec:
    """The window that all positional features share."""
    return Window.partitionBy(*K).orderBy("date")


def whole() -> WindowSpec:
    return Window.partitionBy(*K)


def origin_features(df: DataFrame) -> DataFrame:
    """Lags, rolling statistics, 28-row trend, rows since a sale and cv, seen from each row."""
    y, row = F.col("QUANTITE"), F.row_number().over(by_date())
    df = df.withColumn("_rn", row.cast("double"))
    out = {f"y_origin_m{k}": F.coalesce(F.lag(y, k).over(by_date()), F.lit(0.0)) for k in LAGS}
    for n in ROLLING:
        frame = by_date().rowsBetween(-(n - 1), 0)
        out |= {f"roll_mean_{n}": F.avg(y).over(frame), f"roll_std_{n}": F.stddev_pop(y).over(frame), f"roll_max_{n}": F.max(y).over(frame), f"roll_nonzero_ratio_{n}": F.avg((y > 0).cast("double")).over(frame)}
    last = F.last(F.when(y > 0, F.col("_rn")), ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    out |= {"trend_28": F.when(F.col("_rn") >= 28, F.regr_slope(y, F.col("_rn")).over(by_date().rowsBetween(-27, 0))).otherwise(0.0), "days_since_sale": F.coalesce(F.col("_rn") - last, F.col("_rn"))}
    df = df.withColumns(out)
    return df.withColumn("cv_28", F.col("roll_std_28") / (F.col("roll_mean_28") + 1e-6)).drop("_rn")


def is_origin(rn: Column, n: Column, stride: int = STRIDE) -> Column:
    return (rn >= MIN_ROWS) & ((rn - MIN_ROWS) % stride == 0) & (rn <= n - 1)


def direct_samples(df: DataFrame, covariates: list[str], horizons: list[int] = HORIZONS, stride: int = STRIDE, purged: int = 1) -> DataFrame:
    """(origin, horizon, target) rows: features at the origin, covariates and y at the target.

    Horizons count rows.  Test targets lie in the last 30 days of the series, training
    targets at least ``purged`` days before them; targets on days between are dropped.
    """
    target = F.struct("date", F.col("QUANTITE").alias("y"), *covariates)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(target, h).over(by_date()).alias("t")) for h in horizons])
    df = origin_features(df).withColumns({"_rn": F.row_number().over(by_date()), "_n": F.count("*").over(whole()), "_end": F.max("date").over(whole()), "_ahead": ahead})
    features = [c for c in df.columns if c.startswith(("y_origin", "roll_", "trend_", "days_", "cv_"))]
    rows = df.filter(is_origin(F.col("_rn"), F.col("_n"), stride)).select(*K, F.col("date").alias("_origin_date"), "_end", *features, F.explode("_ahead").alias("_a")).filter("_a.t is not null")
    day = F.col("_a.t.date")
    cut = F.date_sub("_end", TEST_DAYS)
    rows = rows.withColumn("_is_test", F.when(day > cut, True).when(day <= F.date_sub(cut, purged), False)).filter("_is_test is not null")
    calendar = [F.weekday(day).alias("target_dow"), F.month(day).alias("target_month"), F.dayofmonth(day).alias("target_day"), F.dayofyear(day).alias("target_doy"), (F.weekday(day) >= 5).cast("int").alias("target_is_weekend")]
    return rows.select(*K, "_origin_date", day.alias("_target_date"), "_is_test", F.col("_a.horizon").alias("horizon"), *features, *calendar, *[F.col(f"_a.t.{c}").alias(c) for c in covariates], F.col("_a.t.y").alias("y"))


def split_with_purge(df: DataFrame, by: list[str] = K, days: int = TEST_DAYS) -> DataFrame:
    cut = F.date_sub(F.max("date").over(Window.partitionBy(*by)), days)
    return df.withColumn("split", F.when(F.col("date") > cut, "test").when(F.col("date") <= F.date_sub(cut, 1), "train").otherwise("purged"))


def split_fraction(df: DataFrame, share: float = 0.3, most: int = 365) -> DataFrame:
    n = F.count("*").over(whole())
    back = F.row_number().over(Window.partitionBy(*K).orderBy(F.col("date").desc()))
    return df.withColumn("is_test", back <= F.least(F.lit(most), F.floor(n * share)))


def split_aligned(df: DataFrame, days: int = TEST_DAYS, purged: int = 1, least_test: int = 5, least_train: int = 30) -> DataFrame:
    """is_test: the last ``days`` days of each couple; is_train: rows at least ``purged`` days before them.

    Where this leaves fewer than ``least_test`` or ``least_train`` rows, the last ``days`` rows test and all others train.
    """
    w = Window.partitionBy(*K)
    cut = F.date_sub(F.max("date").over(w), days)
    df = df.withColumns({"_test": F.col("date") > cut, "_train": F.col("date") <= F.date_sub(cut, purged), "_back": F.row_number().over(Window.partitionBy(*K).orderBy(F.col("date").desc()))})
    few = (F.count_if("_test").over(w) < least_test) | (F.count_if("_train").over(w) < least_train)
    df = df.withColumn("_few", few)
    last = F.col("_back") <= days
    out = df.withColumns({"is_test": F.when(F.col("_few"), last).otherwise(F.col("_test")), "is_train": F.when(F.col("_few"), ~last).otherwise(F.col("_train"))})
    return out.drop("_test", "_train", "_back", "_few")


def split_at_fraction(df: DataFrame, share: float = 0.75) -> DataFrame:
    """The first ``share`` of a series' rows train, the rest test."""
    return df.withColumn("is_test", F.row_number().over(by_date()) > F.floor(F.count("*").over(whole()) * share))


def expanding_folds(df: DataFrame, k: int) -> DataFrame:
    """k time-ordered folds: all rows before a block train, the block tests."""
    rn, n = F.row_number().over(by_date()) - 1, F.count("*").over(whole())
    block = F.floor(n / (k + 1))
    df = df.withColumns({"_rn": rn, "_n": n, "_b": block}).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("_n") - (k + 1 - F.col("fold")) * F.col("_b")
    return df.withColumn("role", F.when(F.col("_rn") < start, "train").when(F.col("_rn") < start + F.col("_b"), "test")).filter("role is not null").drop("_rn", "_n", "_b")


def calendar_rolling(df: DataFrame, sizes: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Mean and sample variance of full windows; rows with an incomplete one are dropped."""
    rn = F.row_number().over(by_date())
    cols = {}
    for n in sizes:
        frame = by_date().rowsBetween(-(n - 1), 0)
        cols |= {f"mean_{n}": F.when(rn >= n, F.avg("QUANTITE").over(frame)), f"var_{n}": F.when(rn >= n, F.var_samp("QUANTITE").over(frame))}
    return df.withColumns(cols).na.drop(subset=list(cols))


def expanding_stats(df: DataFrame) -> DataFrame:
    frame = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"mean_exp": F.avg("QUANTITE").over(frame), "var_exp": F.var_samp("QUANTITE").over(frame)})


def _neighbours(value: Column) -> tuple[Column, Column]:
    return F.last(value, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)), F.first(value, ignorenulls=True).over(by_date().rowsBetween(0, Window.unboundedFollowing))


def impute_midpoint(df: DataFrame, col: str) -> DataFrame:
    before, after = _neighbours(F.col(col))
    return df.withColumn(col, F.coalesce((before + after) / 2, before, after))


def interpolate_linear(df: DataFrame, col: str) -> DataFrame:
    """Interior gaps linearly by date, the ends with the nearest value."""
    known = F.when(F.col(col).isNotNull(), F.struct("date", F.col(col).alias("v")))
    before, after = _neighbours(known)
    df = df.withColumns({"_p": before, "_q": after})
    gap = F.datediff("_q.date", "_p.date")
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * F.datediff(F.col("date"), F.col("_p.date")) / gap
    return df.withColumn(col, F.when(gap > 0, line).otherwise(F.coalesce("_p.v", "_q.v"))).drop("_p", "_q")


def scale_series(df: DataFrame, col: str, how: str = "minmax") -> DataFrame:
    v = F.col(col)
    low, high = F.min(v).over(whole()), F.max(v).over(whole())
    top = F.max(F.abs(v)).over(whole())
    scaled = F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)) if how == "minmax" else F.coalesce(F.try_divide(v, top), F.lit(0.0))
    return df.withColumn(f"{col}_scaled", scaled)


def unscale_series(df: DataFrame, history: DataFrame, col: str, scaled: str, how: str = "minmax") -> DataFrame:
    """Scaled values of ``df`` back on the scale of each series' history, as column ``col``."""
    span = history.groupBy(*K).agg(F.min(col).alias("_low"), F.max(col).alias("_high"), F.max(F.abs(F.col(col))).alias("_top"))
    back = F.col("_low") + F.col(scaled) * (F.col("_high") - F.col("_low")) if how == "minmax" else F.col(scaled) * F.col("_top")
    return df.join(span, K).withColumn(col, back).drop("_low", "_high", "_top")


def holdout_slice(samples: DataFrame, days: int = 10, most: int = 300_000) -> DataFrame:
    """Training samples whose target lies in the last ``days`` days before the last training target of all, ``most`` at most.

    The bound is the operator's own; of more samples those of the least hashes are taken, so reruns agree.
    """
    train = samples.filter("not _is_test")
    last = train.agg(F.max("_target_date").alias("_last"))
    late = train.crossJoin(F.broadcast(last)).filter(F.datediff("_last", "_target_date") < days).drop("_last")
    at = [*K, "_origin_date", "horizon"]
    return late.orderBy(F.xxhash64(*at), *at).limit(most)


def winsorize_by_series(df: DataFrame, col: str, least: int = 20) -> DataFrame:
    p = F.percentile(col, F.array(F.lit(0.05), F.lit(0.95))).over(whole())
    clipped = F.least(F.greatest(F.col(col), p[0]), p[1])
    return df.withColumn(col, F.when(F.count(col).over(whole()) >= least, clipped).otherwise(F.col(col)))


def regression_lags(df: DataFrame, cols: list[str], n: int = 7) -> DataFrame:
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(by_date()) for c in cols for k in range(1, n + 1)})


def version_intervals(versions: DataFrame, end: DataFrame) -> DataFrame:
    """Validity [date, next date) of model versions; the last one ends at the last history day, which it leaves out."""
    after = F.lead("date").over(by_date())
    return versions.join(end, K).withColumn("valid_to", F.coalesce(after, F.col("last_date"))).drop("last_date")


def version_in_force(df: DataFrame, versions: DataFrame, cols: list[str], inside: bool = True) -> DataFrame:
    """As-of: each row with ``cols`` and date (as version) of the latest version of its couple dated on or before it.

    Versions join the series as marked rows, so the version in force comes from one window: one
    exchange by couple, and no row meets any version but its own.  With ``inside`` only rows in a
    version's validity stay: from its date to the next one, the last day of the series left out.
    """
    carried = F.struct(F.col("date").alias("version"), *cols)
    marks = versions.select(*K, "date", carried.alias("_v"), F.lit(True).alias("_mark"))
    both = df.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    up_to = by_date().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({"_v": F.last("_v", ignorenulls=True).over(up_to), "_end": F.max(F.when(~F.col("_mark"), F.col("date"))).over(whole())}).filter(~F.col("_mark"))
    if inside:
        out = out.filter("_v is not null and date < _end")
    return out.select(*df.columns, "_v.version", *[F.col(f"_v.{c}").alias(c) for c in cols])


def fill_next_day(df: DataFrame, order: str) -> DataFrame:
    """An empty date becomes the day after the row before it, chained; rows before the first date stay empty."""
    w = Window.partitionBy(*K).orderBy(order)
    known = F.when(F.col("date").isNotNull(), F.struct("date", F.row_number().over(w).alias("rn")))
    df = df.withColumns({"_rn": F.row_number().over(w), "_known": known})
    last = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_last", last)
    return df.withColumn("date", F.date_add("_last.date", F.col("_rn") - F.col("_last.rn"))).drop("_rn", "_known", "_last")


def forecast_by_version(df: DataFrame, versions: DataFrame, x: str) -> DataFrame:
    """Forecast of each row by the line q = a + b x fitted on all rows up to its version's date.

    Versions join the series as marked rows, so running fits and the version in force come
    from one window; a row takes the latest version dated on or before it.  The last
    day of a series is in no version's validity.
    """
    rows = df.select(*K, "date", "QUANTITE", x, F.lit(False).alias("_mark"))
    marks = versions.select(*K, "date", F.lit(None).cast("double").alias("QUANTITE"), F.lit(None).cast("double").alias(x), F.lit(True).alias("_mark"))
    w = by_date().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fitted = rows.unionByName(marks).withColumns({"_a": F.regr_intercept("QUANTITE", x).over(w), "_b": F.regr_slope("QUANTITE", x).over(w)})
    version = F.when(F.col("_mark"), F.struct(F.col("date").alias("d"), "_a", "_b"))
    out = fitted.withColumn("_v", F.last(version, ignorenulls=True).over(w)).withColumn("_end", F.max(F.when(~F.col("_mark"), F.col("date"))).over(whole())).filter("not _mark and _v is not null and date < _end")
    return out.select(*K, "date", F.col("_v.d").alias("version"), "QUANTITE", F.greatest(F.col("_v._a") + F.col("_v._b") * F.col(x), F.lit(0.0)).alias("prediction"))
