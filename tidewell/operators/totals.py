"""Elasticities of a couple's total demand, with a column scorer or a fitted model.

Statistics of the couple come from one aggregate, the totals of all variants of all
features from a second one on the same key, so features add columns and no shuffles.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.elasticity import Scorer, with_predictions
from tidewell.schema import BENCH_EXCLUDED, K, MIN_PROMO_LIFT, MIN_RANGE, ORDINAL, TOTALS_BINARY, TOTALS_SKIPPED

# Guards, levels and shocks that results must share.
MIN_OFF_ROWS, MIN_PROMO_ROWS, MIN_UPLIFT = 10, 5, 0.05
UPLIFT_LEVELS = [0.10, 0.20, 0.30, 0.40, 0.50]
SHOCKS = [0.01, 0.05]
PRICE_STEPS = 4


def _kind(f: str) -> str:
    if f in TOTALS_BINARY or f.startswith("PARAM_JS_"):
        return "binary"
    if f in ORDINAL:
        return "ordinal"
    if f == "PARAM_PRIX":
        return "price"
    return "promo" if "PARAM_PROMO" in f else "rival" if "PARAM_CONC" in f else "other"


def _middle(values: Column) -> Column:
    """Median of the values of an array that are not null; null without any."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    at = lambda i: F.get(v, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def _long(wide: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(v, 4).alias("value")) for f, v in values.items()])
    return wide.select(*K, F.explode(pairs).alias("_p")).select(*K, "_p.feature", "_p.value")


class Variants:
    """Collects the changes of a row whose predictions are summed, and gives each a column."""

    def __init__(self) -> None:
        self.changes: dict[str, dict[str, Column]] = {}

    def at(self, feature: str = "", value: Column | None = None) -> Column:
        name = f"_v{len(self.changes)}"
        self.changes[name] = {feature: value} if feature else {}
        return F.coalesce(name, F.lit(0.0))

    def of(self, df: DataFrame, scorer: Scorer | Transformer, names: list[str]) -> DataFrame:
        return with_predictions(df, self.changes, scorer, names)


def _ordinal(df: DataFrame, feature: str, scorer: Scorer | Transformer, names: list[str]) -> DataFrame:
    """Upper quartile against median of the totals at each level that the couple has seen (at most 12 or 7)."""
    levels = df.groupBy(*K).agg(F.collect_set(feature).alias("_levels"), F.stddev_samp(feature).alias("_std"))
    tried = Variants()
    here = tried.at(feature, F.col("_level"))
    rows = tried.of(df.join(levels, K).withColumn("_level", F.explode("_levels")), scorer, names)
    totals = rows.groupBy(*K, "_level").agg(F.sum(here).alias("_q"), F.first("_std").alias("_std"))
    q = F.percentile("_q", F.array(F.lit(0.5), F.lit(0.75)))
    wide = totals.groupBy(*K).agg(q.alias("_q"), F.first("_std").alias("_std"))
    e = (F.col("_q")[1] - F.col("_q")[0]) / F.greatest(F.col("_q")[0], F.lit(1.0))
    return _long(wide, {feature: F.when(F.col("_std") < 1e-6, 0.0).otherwise(e)})


def series_elasticity(df: DataFrame, features: list[str], scorer: Scorer | Transformer, names: list[str]) -> DataFrame:
    """Response of each couple's total by the kind of the feature: (couple, feature, value), zeros kept.

    Flags: switching on where off, with at least ten such rows.  Prices and rival prices: median
    elasticity over levels between the observed deciles.  Promotions: median uplift over fixed
    levels, if demand on and off promotion differs enough.  Others: shocks of 1 and 5 %.
    """
    named = {f: _kind(f) for f in features if f not in TOTALS_SKIPPED}
    flat = {f"_{i}": (f, k) for i, (f, k) in enumerate(named.items()) if k != "ordinal"}
    tried, stats = Variants(), []
    sums = [F.greatest(F.sum(tried.at()), F.lit(1.0)).alias("_q")]
    for p, (f, k) in flat.items():
        c, on = F.col(f), F.col(f) > 0
        d = F.percentile(f, F.array(F.lit(0.1), F.lit(0.9)))
        stats += [F.stddev_samp(f).alias(f"{p}_std"), F.avg(f).alias(f"{p}_avg")]
        at = lambda v, f=f: F.sum(tried.at(f, v))
        if k == "binary":
            off = lambda v, f=f: F.sum(F.when(F.col(f) == 0, tried.at(f, F.lit(v))))
            sums += [F.count_if(c == 0).alias(f"{p}_n"), off(0.0).alias(f"{p}_a"), off(1.0).alias(f"{p}_b")]
        elif k in ("price", "rival"):
            stats += [d[0].alias(f"{p}_lo"), d[1].alias(f"{p}_hi")]
            level = lambda i, p=p: F.col(f"{p}_lo") + (F.col(f"{p}_hi") - F.col(f"{p}_lo")) * i / PRICE_STEPS
            sums += [at(level(i)).alias(f"{p}_{i}") for i in range(1, PRICE_STEPS + 1)]
        elif k == "promo":
            stats += [F.count_if(on).alias(f"{p}_n"), F.avg(F.when(on, F.col("QUANTITE"))).alias(f"{p}_qa"), F.coalesce(F.avg(F.when(c == 0, F.col("QUANTITE"))), F.lit(0.0)).alias(f"{p}_qs")]
            sums += [at(F.lit(v)).alias(f"{p}_{i}") for i, v in enumerate([0.0, *UPLIFT_LEVELS])]
        else:
            sums += [at(c * (1 + s)).alias(f"{p}_{i}") for i, s in enumerate(SHOCKS)]
    parts = [_ordinal(df, f, scorer, names) for f, k in named.items() if k == "ordinal"]
    if flat:
        known = df.groupBy(*K).agg(*stats)
        totals = tried.of(df.join(known, K), scorer, names).groupBy(*K).agg(*sums)
        wide = known.join(totals, K)
        parts.append(_long(wide, {f: F.when(F.col(f"{p}_std") < 1e-6, 0.0).otherwise(F.coalesce(_total_response(p, k), F.lit(0.0))) for p, (f, k) in flat.items()}))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _total_response(p: str, kind: str) -> Column:
    """Value of a feature from its statistics and totals; null where a guard leaves none."""
    c, zero = lambda s: F.col(f"{p}_{s}"), F.lit(0.0)
    if kind == "binary":
        return F.when(c("n") >= MIN_OFF_ROWS, (c("b") - c("a")) / F.greatest(c("a"), F.lit(1.0)))
    if kind in ("price", "rival"):
        lo, hi, mean = c("lo"), c("hi"), F.greatest(c("avg"), F.lit(1e-6))
        step = lambda i: (lo + (hi - lo) * i / PRICE_STEPS - c("avg")) / mean
        ratios = F.array(*[F.when(F.abs(step(i)) > 1e-6, (c(i) - F.col("_q")) / F.col("_q") / step(i)) for i in range(1, PRICE_STEPS + 1)])
        middle = _middle(ratios)
        e = F.when(middle.isNotNull(), F.least(middle, zero) if kind == "price" else F.greatest(middle, zero))
        e = F.when((hi - lo) / F.greatest(lo, F.lit(1e-6)) >= MIN_RANGE, e)
        return e if kind == "price" else F.when(F.abs(c("avg")) >= 1e-6, e)
    if kind == "promo":
        uplift = _middle(F.array(*[(c(i + 1) - c(0)) / F.greatest(c(0), F.lit(1.0)) for i in range(len(UPLIFT_LEVELS))]))
        e = F.when(F.abs(c("qa") - c("qs")) / F.greatest(c("qs"), F.lit(0.01)) >= MIN_PROMO_LIFT, F.when(uplift >= MIN_UPLIFT, uplift))
        return F.when(c("n") >= MIN_PROMO_ROWS, F.when((c("qs") < 0.01) & (c("qa") > 0), 1.0).otherwise(e))
    return F.when(F.abs(c("avg")) >= 1e-6, _middle(F.array(*[(c(i) - F.col("_q")) / F.col("_q") / s for i, s in enumerate(SHOCKS)])))


def series_elasticity_1pct(df: DataFrame, features: list[str], scorer: Scorer | Transformer, names: list[str]) -> DataFrame:
    """Older form: a shock of 1 %, promotions at most 1, flags cut to [-1, 10]; one aggregate for all features."""
    named = {f: _kind(f) for f in features if f not in TOTALS_SKIPPED}
    tried, values = Variants(), {}
    aggs = [F.sum(tried.at()).alias("_q")]
    for i, (f, k) in enumerate(named.items()):
        c, p = F.col(f), f"_{i}"
        aggs += [F.stddev_samp(f).alias(f"{p}_std"), F.avg(f).alias(f"{p}_avg")]
        if k == "binary":
            off = lambda v, f=f: F.sum(F.when(F.col(f) == 0, tried.at(f, F.lit(v))))
            aggs += [F.count_if(c == 0).alias(f"{p}_n"), off(0.0).alias(f"{p}_a"), off(1.0).alias(f"{p}_b")]
            e = (F.col(f"{p}_b") - F.col(f"{p}_a")) / F.greatest(F.col(f"{p}_a"), F.lit(1.0))
            e = F.when(F.col(f"{p}_n") >= MIN_OFF_ROWS, F.greatest(F.least(e, F.lit(10.0)), F.lit(-1.0)))
        else:
            shocked = F.least(c * 1.01, F.lit(1.0)) if k == "promo" else c * 1.01
            aggs.append(F.sum(tried.at(f, shocked)).alias(f"{p}_u"))
            e = (F.col(f"{p}_u") - F.col("_q")) / F.greatest("_q", F.lit(1.0)) / 0.01
            e = F.least(e, F.lit(0.0)) if k == "price" else F.greatest(e, F.lit(0.0)) if k in ("promo", "rival") else e
            e = F.when(F.abs(F.col(f"{p}_avg")) >= 1e-6, e)
        values[f] = F.when(F.col(f"{p}_std") < 1e-6, 0.0).otherwise(F.coalesce(e, F.lit(0.0)))
    return _long(tried.of(df, scorer, names).groupBy(*K).agg(*aggs), values)


def perturb_single(df: DataFrame, features: list[str], scorer: Scorer | Transformer, names: list[str], constant_flags: bool = False, plain: bool = False) -> DataFrame:
    """Benchmark form, per couple, in %: features that only hold 0 and 1 by their median impact,
    others by the mean of both 10 % steps; no clip, no sign rule, zeros left out.

    A couple that knows only one of 0 and 1 has no impact of that feature, as a model of its own
    drops it; with ``constant_flags``, for models of all couples, it has.  With ``plain`` every
    feature is moved by its step, flags too; without a step it moves nothing, and NaN stays NaN.
    """
    used = [f for f in features if f not in BENCH_EXCLUDED]
    tried = Variants()
    y = tried.at()
    stats = [s for i, f in enumerate(used) for s in (F.every(F.col(f).isin(0, 1)).alias(f"_{i}_flag"), (F.min(f) < F.max(f)).alias(f"_{i}_both"), F.avg(f).alias(f"_{i}_m"), F.stddev_pop(f).alias(f"_{i}_s"))]
    rows, aggs, values = df.join(df.groupBy(*K).agg(*stats), K), [], {}
    for i, f in enumerate(used):
        m, s = F.col(f"_{i}_m"), F.col(f"_{i}_s")
        step = F.when(F.abs(m) > 1e-8, m * 0.1).when(s > 1e-8, s * 0.1)
        off, on, up, down = tried.at(f, F.lit(0.0)), tried.at(f, F.lit(1.0)), tried.at(f, F.col(f) + step), tried.at(f, F.col(f) - step)
        flag = F.lit(False) if plain else F.col(f"_{i}_flag")
        moved = F.coalesce(up - down, F.lit(0.0)) if plain else F.when(step.isNotNull(), up - down)
        known = flag if constant_flags else flag & F.col(f"_{i}_both")
        aggs += [F.median(F.when(known & (off > 0.5), (on - off) / off * 100)).alias(f"_{i}_b"), F.avg(F.when(~flag & (y > 1e-8), moved / y / 0.1 / 2)).alias(f"_{i}_c")]
        values[f] = F.round(F.coalesce(f"_{i}_b", f"_{i}_c"), 2)
    return _long(tried.of(rows, scorer, names).groupBy(*K).agg(*aggs), values).filter("abs(value) > 1e-8")
