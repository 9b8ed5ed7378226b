"""Regressors: in-sample fits, cross-validation and walk-forward forecasts.

Linear fits come from summed moments, so a fit, its error and its correlation
cost one pass however many folds or test rows there are.  The target is the
same-row close, which ``mean_7d`` already contains; ``target="next_close"`` in
the pipelines gives a real forecast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from candlewick.config import FOLDS, MIN_TRAIN_ROWS, MODEL_FEATURES, TEST_DAYS, SeriesSpec
from candlewick.functions.least_squares import (
    absolute_errors,
    expanding_predictions,
    fold_coefficients,
    fold_errors,
    merged,
    monomials,
    pooled_errors,
    reduce_rows,
)
from candlewick.operators.features import (
    complete_rows,
    rolling_features,
    series_layout,
    tail_split,
)
from candlewick.operators.layout import Layout
from candlewick.storage import settle

# Strategies a single feature can express, next to the naive last-close one.
SIMPLE_STRATEGIES = {"ols_mean_7d": "mean_7d", "ols_momentum_7d": "momentum_7d"}
NAIVE = "naive"

# Features measured on the price scale: shifted by the mean price before
# squaring, or their sums of squares would lose digits.
_LEVEL = {"mean_7d"}
_PRICE_SCALE = {"mean_7d", "std_7d", "momentum_7d"}


# -- one feature ---------------------------------------------------------------
def _line(y: Column, x: Column) -> tuple[Column, Column]:
    """Slope and intercept; a constant feature predicts the mean."""
    slope = F.coalesce(F.try_divide(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0))
    return slope, F.avg(y) - slope * F.avg(x)


def ols_simple(matrix: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Slope and intercept of close on each single feature, per group."""
    aggregates = []
    for name, feature in SIMPLE_STRATEGIES.items():
        slope, intercept = _line(F.col("close"), F.col(feature))
        aggregates += [slope.alias(f"{name}_slope"), intercept.alias(f"{name}_intercept")]
    return matrix.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggregates)


def fit_in_sample(matrix: DataFrame, naive: str | None = "previous_close") -> DataFrame:
    """Pooled in-sample predictions, one column ``p_<strategy>`` per strategy.

    The coefficients are a one-row scalar subquery, not a join.
    """
    columns = {}
    if naive:
        columns[f"p_{NAIVE}"] = F.col(naive)
    fit = []
    for name, feature in SIMPLE_STRATEGIES.items():
        slope, intercept = _line(F.col("close"), F.col(feature))
        fit += [slope.alias(f"{name}_slope"), intercept.alias(f"{name}_intercept")]
    lines = matrix.agg(*fit).select(F.struct("*").alias("fit")).scalar()
    rows = matrix.withColumn("__fit", lines)
    for name, feature in SIMPLE_STRATEGIES.items():
        slope, intercept = F.col(f"__fit.{name}_slope"), F.col(f"__fit.{name}_intercept")
        columns[f"p_{name}"] = slope * F.col(feature) + intercept
    return rows.withColumns(columns).drop("__fit")


def strategies_of(wide: DataFrame) -> list[str]:
    return [c[2:] for c in wide.columns if c.startswith("p_")]


def long_predictions(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., strategy, prediction) rows from the ``p_`` columns."""
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), F.col(f"p_{s}").alias("prediction"))
            for s in strategies_of(wide)
        ]
    )
    exploded = wide.select(*keep, F.explode(pairs).alias("__p"))
    return exploded.select(*keep, "__p.strategy", "__p.prediction")


def fit_quality(wide: DataFrame, y: str = "close") -> DataFrame:
    """Per strategy: n, mse, rmse, r2, correlation and the RMSE to the best
    strategy (highest R2, first listed on a tie), with an equality flag.

    One global aggregate over the wide table gives everything, including all
    pairwise prediction differences, so nothing is refitted or self-joined.
    """
    names = strategies_of(wide)
    rows = wide.dropna(subset=[y, *[f"p_{s}" for s in names]])
    target = F.col(y)
    aggregates = [F.count(F.lit(1)).alias("n"), F.var_pop(target).alias("__var")]
    for i, s in enumerate(names):
        p = F.col(f"p_{s}")
        aggregates += [
            F.avg((target - p) * (target - p)).alias(f"__mse{i}"),
            F.corr(target, p).alias(f"__corr{i}"),
        ]
        for j in range(i):
            gap = p - F.col(f"p_{names[j]}")
            aggregates.append(F.avg(gap * gap).alias(f"__gap{j}_{i}"))
    one = rows.agg(*aggregates)
    table = F.array(
        *[
            F.struct(
                F.lit(s).alias("strategy"),
                F.lit(i).alias("ord"),
                F.col("n"),
                F.col(f"__mse{i}").alias("mse"),
                F.sqrt(f"__mse{i}").alias("rmse"),
                (1 - F.try_divide(F.col(f"__mse{i}"), F.col("__var"))).alias("r2"),
                F.col(f"__corr{i}").alias("correlation"),
                F.array(
                    *[
                        F.lit(0.0) if i == j else F.col(f"__gap{min(i, j)}_{max(i, j)}")
                        for j in range(len(names))
                    ]
                ).alias("gaps"),
            )
            for i, s in enumerate(names)
        ]
    )
    listed = one.select(table.alias("t"))
    # Order by (R2, earlier position): the first of equal scores wins, and any
    # score wins over an undefined one.
    best = F.array_max(
        F.transform(
            "t",
            lambda s: F.named_struct(
                F.lit("r2"), F.when(~F.isnan(s["r2"]), s["r2"]), F.lit("at"), -s["ord"], F.lit("name"), s["strategy"]
            ),
        )
    )
    return (
        listed.select(F.explode("t").alias("s"), best.alias("best"))
        .select("s.*", F.col("best.name").alias("best"), (-F.col("best.at")).alias("__at"))
        .withColumn("__gap", F.element_at("gaps", F.col("__at") + 1))
        .withColumns(
            {
                "rmse_vs_best": F.sqrt("__gap"),
                "identical_to_best": F.col("__gap") == 0.0,
            }
        )
        .drop("gaps", "__gap", "__at")
    )


# -- k-fold ----------------------------------------------------------------------
def kfold_simple(
    matrix: DataFrame, strategies: dict[str, str], fold: Column, y: str = "close"
) -> DataFrame:
    """Mean of the per-fold MSEs of one-feature fits, and its root.

    One pass: central moments per fold, which merge without losing digits.  A
    fold is trained on all others, and its error follows from its own moments.
    """
    target = F.col(y)
    aggregates = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("my")]
    aggregates.append(F.regr_syy(target, target).alias("cyy"))
    for i, feature in enumerate(strategies.values()):
        x = F.col(feature)
        aggregates += [
            F.avg(x).alias(f"mx{i}"),
            F.regr_sxx(target, x).alias(f"cxx{i}"),
            F.regr_sxy(target, x).alias(f"cxy{i}"),
        ]
    # One row per fold from here on.
    per_fold = matrix.groupBy(fold.alias("fold")).agg(*aggregates)
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("strategy"),
                F.col(f"mx{i}").alias("mx"),
                F.col(f"cxx{i}").alias("cxx"),
                F.col(f"cxy{i}").alias("cxy"),
            )
            for i, name in enumerate(strategies)
        ]
    )
    rows = per_fold.select("n", "my", "cyy", F.explode(table).alias("s")).select(
        "n", "my", "cyy", "s.*"
    )
    every = W.partitionBy("strategy")
    n = F.col("n").cast("double")
    # Distances to the overall means.
    dx = F.col("mx") - F.sum(n * F.col("mx")).over(every) / F.sum(n).over(every)
    dy = F.col("my") - F.sum(n * F.col("my")).over(every) / F.sum(n).over(every)
    rows = rows.withColumns({"dx": dx, "dy": dy})
    dx, dy = F.col("dx"), F.col("dy")
    own = {
        "n1": n,
        "sx": n * dx,
        "sy": n * dy,
        "sxx": F.col("cxx") + n * dx * dx,
        "sxy": F.col("cxy") + n * dx * dy,
        "syy": F.col("cyy") + n * dy * dy,
    }
    rows = rows.withColumns(own)
    rows = rows.withColumns({f"t_{k}": F.sum(k).over(every) - F.col(k) for k in own})
    tn, sx, sy, sxx, sxy = (F.col(f"t_{k}") for k in ("n1", "sx", "sy", "sxx", "sxy"))
    slope = F.coalesce(F.try_divide(tn * sxy - sx * sy, tn * sxx - sx * sx), F.lit(0.0))
    rows = rows.withColumn("b", slope).withColumn("a", (sy - F.col("b") * sx) / tn)
    a, b = F.col("a"), F.col("b")
    sse = (
        F.col("syy")
        - 2 * a * F.col("sy")
        - 2 * b * F.col("sxy")
        + n * a * a
        + 2 * a * b * F.col("sx")
        + b * b * F.col("sxx")
    )
    scored = rows.withColumn("mse", sse / n).groupBy("strategy")
    return scored.agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mse").alias("mse")
    ).withColumn("rmse", F.sqrt("mse"))


def fold_of(key: str, folds: int = FOLDS) -> Column:
    """Deterministic fold: the same row is always in the same fold."""
    return F.pmod(F.col(key), F.lit(folds)).cast("int")


def hashed_fold(*keys: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int")


def kfold_polynomial(
    matrix: DataFrame,
    degrees: Sequence[int],
    fold: Column,
    features: Sequence[str] = MODEL_FEATURES,
    y: str = "close",
) -> DataFrame:
    """Cross-validated mean MSE and its root for several polynomial degrees.

    One pass: each task reduces the rows of the highest degree's terms to one
    triangular factor per fold.  The factors merge in two steps, so no task
    receives one from every other task.  Fits and errors of all degrees and folds
    follow from them.
    """
    top = max(degrees)
    per_fold, unit, _ = _pooled_factors(matrix, top, features, y, fold)
    # ``folds`` rows meet here.
    scored = per_fold.select("fold", "factor", unit.alias("unit")).groupBy()
    return scored.applyInPandas(
        fold_errors(len(features), top, degrees), "degree int, folds int, mse double, r2 double"
    ).select(
        strategy_column("degree").alias("strategy"),
        "degree",
        "folds",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "r2",
    )


def kfold_absolute(
    matrix: DataFrame,
    degrees: Sequence[int],
    fold: Column,
    features: Sequence[str] = MODEL_FEATURES,
    y: str = "close",
) -> DataFrame:
    """Mean absolute held-out error (strategy, mae) of the fits that
    ``kfold_polynomial`` scores, by one more pass over the rows.

    The fits come to the driver: a few numbers per fold, degree and term.
    """
    top = max(degrees)
    per_fold, unit, rows = _pooled_factors(matrix, top, features, y, fold)
    fitted = per_fold.select("fold", "factor").groupBy().applyInPandas(
        fold_coefficients(len(features), top, degrees), "fold int, degree int, beta array<double>"
    )
    fits = {(r["fold"], r["degree"]): list(r["beta"]) for r in fitted.collect()}
    if not fits:
        return matrix.sparkSession.createDataFrame([], "strategy string, mae double")
    inputs = [f"x{i}" for i in range(len(features) + 1)]
    sums = rows.select("fold", *inputs).mapInArrow(
        absolute_errors(inputs, top, fits), "fold int, degree int, n long, total double"
    )
    means = sums.groupBy("degree", "fold").agg((F.sum("total") / F.sum("n")).alias("mae"))
    return means.groupBy("degree").agg(F.avg("mae").alias("mae")).select(
        strategy_column("degree").alias("strategy"), (F.col("mae") * unit).alias("mae")
    )


def in_sample_polynomial(
    matrix: DataFrame,
    degrees: Sequence[int],
    features: Sequence[str] = MODEL_FEATURES,
    y: str = "close",
) -> DataFrame:
    """In-sample quality of several polynomial degrees from one pass over the rows.

    A least-squares fit with a constant explains the variance by its R2, and its
    predictions correlate with the target by the root of it.
    """
    top = max(degrees)
    pooled, unit, _ = _pooled_factors(matrix, top, features, y, F.lit(0))
    fitted = pooled.select("factor", unit.alias("unit")).groupBy().applyInPandas(
        pooled_errors(len(features), top, degrees), "degree int, n long, mse double, variance double"
    )
    r2 = 1 - F.try_divide("mse", "variance")
    return fitted.select(
        strategy_column("degree").alias("strategy"),
        "n",
        "mse",
        F.sqrt("mse").alias("rmse"),
        r2.alias("r2"),
        F.sqrt(F.greatest(r2, F.lit(0.0))).alias("correlation"),
    )


def _pooled_factors(
    matrix: DataFrame, degree: int, features: Sequence[str], y: str, fold: Column
) -> tuple[DataFrame, Column, DataFrame]:
    """(fold, factor) of the standardised rows, the target's unit, the rows."""
    names = [*features, y]
    aggregates = [F.avg(c).alias(f"m_{c}") for c in names]
    aggregates += [F.stddev_samp(c).alias(f"s_{c}") for c in names]
    level = matrix.agg(F.struct(*aggregates)).scalar()

    def standard(c: str) -> Column:
        spread = F.col(f"__l.s_{c}")
        return (F.col(c) - F.col(f"__l.m_{c}")) / F.when(spread > 0, spread).otherwise(1.0)

    inputs = [f"x{i}" for i in range(len(names))]
    rows = matrix.withColumn("__l", level).select(
        fold.alias("fold"),
        F.spark_partition_id().alias("task"),
        *[standard(c).alias(x) for c, x in zip(names, inputs)],
    )
    schema = "fold int, task int, factor array<double>"
    partial = rows.mapInArrow(reduce_rows(("fold", "task"), inputs, degree), schema)
    return merge_factors(partial, ["fold"]), matrix.agg(F.stddev_samp(y)).scalar(), rows


def merge_factors(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One factor per key from those of its tasks (column ``task``), in two steps."""
    listed = F.collect_list("factor").alias("factors")
    halfway = parts.groupBy(*keys, F.pmod("task", F.lit(64)).alias("task")).agg(listed)
    halfway = halfway.select(*keys, merged("factors").alias("factor"))
    return halfway.groupBy(*keys).agg(listed).select(*keys, merged("factors").alias("factor"))


def strategy_name(degree: int) -> str:
    return "LinearRegression" if degree == 1 else f"PolynomialRegression_degree_{degree}"


def strategy_column(degree: str) -> Column:
    return F.when(F.col(degree) == 1, "LinearRegression").otherwise(
        F.format_string("PolynomialRegression_degree_%d", F.col(degree))
    )


# -- MLlib -----------------------------------------------------------------------
def polynomial_pipeline(degree: int, features: Sequence[str] = MODEL_FEATURES) -> Pipeline:
    """Standardise, expand to all monomials up to ``degree``, solve exactly."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True),
    ]
    column = "__scaled"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="__scaled", outputCol="__poly"))
        column = "__poly"
    stages.append(
        LinearRegression(
            featuresCol=column, labelCol="close", solver="normal", predictionCol="prediction"
        )
    )
    return Pipeline(stages=stages)


TREES = {
    "DecisionTreeRegressor": DecisionTreeRegressor,
    "RandomForestRegressor": RandomForestRegressor,
    "GradientBoostingRegressor": GBTRegressor,
}


def tree_pipeline(kind: str, features: Sequence[str] = MODEL_FEATURES, **params) -> Pipeline:
    regressor = TREES[kind](
        featuresCol="__raw", labelCol="close", predictionCol="prediction", seed=42, **params
    )
    return Pipeline(
        stages=[VectorAssembler(inputCols=list(features), outputCol="__raw"), regressor]
    )


def pipelines(degrees: Sequence[int], trees: Sequence[str] = ()) -> dict[str, Pipeline]:
    named = {strategy_name(d): polynomial_pipeline(d) for d in degrees}
    return named | {t: tree_pipeline(t) for t in trees}


#: Rows of one task in fits that read the rows many times.
TASK_ROWS = 250_000


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` persisted and, above TASK_ROWS, dealt evenly over tasks of about that
    many.  After a window a whole series is one task's, in every pass of a fit.

    Deal and order follow from the rows alone: the samples that MLlib draws depend on both.
    """
    stored = rows.persist()
    tasks = -(-stored.count() // TASK_ROWS)
    if tasks < 2:
        return stored
    out = stored.repartition(tasks, *rows.columns).sortWithinPartitions(*rows.columns).persist()
    out.count()
    stored.unpersist()
    return out


_STAGE_COLUMNS = ("__raw", "__scaled", "__poly", "prediction")


def fit_models(matrix: DataFrame, models: dict[str, Pipeline]) -> DataFrame:
    """Fit every model once on the pooled rows; one ``p_<name>`` column each."""
    wide = matrix
    for name, pipeline in models.items():
        predicted = pipeline.fit(matrix).transform(wide)
        wide = predicted.withColumn(f"p_{name}", F.col("prediction")).drop(*_STAGE_COLUMNS)
    return wide


def in_sample_quality(matrix: DataFrame, models: dict[str, Pipeline]) -> DataFrame:
    quality = fit_quality(fit_models(matrix, models))
    return quality.select("strategy", "n", "mse", "rmse", "r2", "correlation")


def kfold_pipeline(
    matrix: DataFrame, name: str, pipeline: Pipeline, fold: Column, folds: int = FOLDS
) -> DataFrame:
    """Cross-validation of any MLlib pipeline: one fit per fold, all folds at the same
    time on the stored rows, so one fit's short jobs fill the other's gaps."""
    rows = settle(matrix.withColumn("fold", fold))

    def part(k: int) -> DataFrame:
        model = pipeline.fit(rows.where(F.col("fold") != k))
        return model.transform(rows.where(F.col("fold") == k)).select("fold", "close", "prediction")

    with ThreadPool(folds) as pool:
        tested = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(matrix.sparkSession)(part), range(folds)))
    gap = F.col("close") - F.col("prediction")
    per_fold = tested.groupBy("fold").agg(
        F.avg(gap * gap).alias("mse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.var_pop("close").alias("spread"),
    )
    out = per_fold.agg(
        F.count(F.lit(1)).cast("int").alias("folds"),
        F.avg("mse").alias("mse"),
        F.avg("mae").alias("mae"),
        F.avg(1 - F.try_divide("mse", "spread")).alias("r2"),
    )
    return out.select(
        F.lit(name).alias("strategy"), "folds", "mse", F.sqrt("mse").alias("rmse"), "r2", "mae"
    )


# -- walk-forward ------------------------------------------------------------------
def test_frame(
    prices: DataFrame,
    test_days: int = TEST_DAYS,
    min_train: int = MIN_TRAIN_ROWS,
    spec: SeriesSpec = SeriesSpec(),
    layout: Layout | None = None,
    target: str = "close",
    drop_any: bool = False,
) -> DataFrame:
    """Complete feature rows with the tail split, the target ``y`` and the price
    level of the series (``__mean``, ``__spread``) for shifting."""
    layout = layout or series_layout(prices, spec)
    features = rolling_features(prices, spec, layout, keep_slice=True, neighbours=True)
    whole = [c for c in features.columns if c not in ("previous_close", "next_close")]
    # Dropping rows with any null looks at the input's own columns too.
    rows = features.dropna(subset=whole) if drop_any else complete_rows(features)
    if target == "next_close":
        rows = rows.where(F.col("next_close").isNotNull())
    rows = rows.withColumn("y", F.col(spec.value if target == "close" else "next_close"))
    return tail_split(rows, test_days, min_train, spec, layout, level=spec.value)


def skipped_series(
    prices: DataFrame,
    test_days: int = TEST_DAYS,
    min_train: int = MIN_TRAIN_ROWS,
    spec: SeriesSpec = SeriesSpec(),
    drop_any: bool = False,
) -> DataFrame:
    """Series too short for the tail split, with their number of usable rows.  Series
    without any usable row count as 0."""
    features = rolling_features(prices, spec)
    rows = features.dropna() if drop_any else complete_rows(features)
    keys = list(spec.keys)
    usable = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("usable_rows"))
    every = prices.dropna(subset=keys).select(*keys).distinct()
    counted = every.join(usable, keys, "left").fillna(0, ["usable_rows"])
    return counted.where(F.col("usable_rows") < test_days + min_train)


def _scaled(c: Column, feature: str) -> Column:
    shift = F.col("__mean") if feature in _LEVEL else F.lit(0.0)
    scale = F.col("__spread") if feature in _PRICE_SCALE else F.lit(1.0)
    return (c - shift) / scale


def _scaled_target() -> Column:
    return (F.col("y") - F.col("__mean")) / F.col("__spread")


def fold_history(frame: DataFrame, degree: int = 1, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """One row per series: the triangular factor of its training rows and its
    test rows.

    This is the only pass over the history.  Each task reduces its training rows
    before anything is shuffled, and factors of a series merge in two steps; the
    test rows, at most ``test_days`` per series, come along as a sorted list.
    Every walk-forward strategy of up to ``degree`` follows from the result.
    """
    keys = list(spec.keys)
    inputs = [f"__x{i}" for i in range(len(MODEL_FEATURES))] + ["__y"]
    scaled = [_scaled(F.col(f), f) for f in MODEL_FEATURES] + [_scaled_target()]
    row = [*spec.order, spec.value, "y", "previous_close", *MODEL_FEATURES]
    passed = [*row, "__mean", "__spread"]
    rows = frame.select(
        *keys,
        *passed,
        "is_test",
        F.spark_partition_id().alias("task"),
        *[c.alias(n) for c, n in zip(scaled, inputs)],
    )
    schema = StructType([rows.schema[c] for c in (*keys, "task", *passed)])
    schema = schema.add("factor", ArrayType(DoubleType()))
    # Reduced rows carry nulls in the passed columns.
    for field in schema.fields:
        field.nullable = True
    parts = rows.mapInArrow(reduce_rows([*keys, "task"], inputs, degree, passed), schema)
    test_row = F.when(F.col("factor").isNull(), F.struct(*row))
    level = [F.max(c).alias(c) for c in ("__mean", "__spread")]
    halfway = parts.groupBy(*keys, F.pmod("task", F.lit(64)).alias("task")).agg(
        F.collect_list("factor").alias("factors"), F.collect_list(test_row).alias("rows"), *level
    )
    halfway = halfway.withColumn("factor", merged("factors"))
    whole = halfway.groupBy(*keys).agg(
        F.collect_list("factor").alias("factors"),
        F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"),
        *level,
    )
    return whole.select(*keys, merged("factors").alias("factor"), "rows", "__mean", "__spread")


def test_rows(history: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """The test rows as rows again."""
    exploded = history.select(*spec.keys, F.explode("rows").alias("__r"))
    return exploded.select(*spec.keys, "__r.*")


def _kept(spec: SeriesSpec) -> list[str]:
    return [*spec.keys, *spec.order, spec.value, "y"]


def naive_forecast(history: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Last close as the prediction."""
    return test_rows(history, spec).select(
        *_kept(spec), F.lit(NAIVE).alias("strategy"), F.col("previous_close").alias("prediction")
    )


def walk_forward_simple(
    history: DataFrame, degree: int = 1, spec: SeriesSpec = SeriesSpec()
) -> DataFrame:
    """Expanding one-feature fits: each test row is predicted from all earlier
    rows of its series.  ``degree`` is that of ``history``.

    The window runs over the test rows only, at most ``test_days`` per series.
    """
    # Columns of the factor: constant, features, ..., target.
    width = len(monomials(len(MODEL_FEATURES), degree)) + 1
    last = width - 1

    def base(i: int, j: int) -> Column:
        """Sum over the training rows of the product of two columns."""
        products = [
            F.element_at("factor", k * width + i + 1) * F.element_at("factor", k * width + j + 1)
            for k in range(min(i, j) + 1)
        ]
        return reduce(add, products)

    exploded = history.withColumn("__r", F.explode("rows")).select(
        *spec.keys, "__mean", "__spread", "factor", "__r.*"
    )
    w = W.partitionBy(*spec.keys).orderBy(*spec.order).rowsBetween(W.unboundedPreceding, -1)

    def so_far(start: Column, row: Column) -> Column:
        return start + F.coalesce(F.sum(row).over(w), F.lit(0.0))

    y = _scaled_target()
    sums = {"n": so_far(base(0, 0), F.lit(1.0)), "sy": so_far(base(0, last), y)}
    for name, feature in SIMPLE_STRATEGIES.items():
        x, at = _scaled(F.col(feature), feature), MODEL_FEATURES.index(feature) + 1
        sums[f"{name}_sx"] = so_far(base(0, at), x)
        sums[f"{name}_sxx"] = so_far(base(at, at), x * x)
        sums[f"{name}_sxy"] = so_far(base(at, last), x * y)
    summed = exploded.withColumns({f"__{k}": c for k, c in sums.items()})
    columns = {}
    n, sy = F.col("__n"), F.col("__sy")
    for name, feature in SIMPLE_STRATEGIES.items():
        sx, sxx, sxy = (F.col(f"__{name}_{k}") for k in ("sx", "sxx", "sxy"))
        slope = F.coalesce(F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))
        line = (sy - slope * sx) / n + slope * _scaled(F.col(feature), feature)
        columns[f"p_{name}"] = F.col("__mean") + F.col("__spread") * line
    wide = summed.withColumns(columns).select(*_kept(spec), *columns)
    return long_predictions(wide, _kept(spec))


def walk_forward_polynomial(
    history: DataFrame,
    degrees: Sequence[int] = (1,),
    degree: int | None = None,
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """Expanding fits on all model features, for several degrees at once.
    ``degree`` is that of ``history`` (by default the highest of ``degrees``).
    """
    top = degree or max(degrees)
    keys = list(spec.keys)
    features = F.transform(
        "rows", lambda r: F.array(*[_scaled(r[f], f) for f in MODEL_FEATURES])
    )
    target = F.transform("rows", lambda r: (r["y"] - F.col("__mean")) / F.col("__spread"))
    predict = expanding_predictions(len(MODEL_FEATURES), top, degrees)
    out = history.withColumn("p", predict("factor", features, target))
    size = F.size("rows")

    def labelled(at: int, d: int) -> Column:
        # Predictions come degree by degree, each in row order.
        return F.transform(
            "rows",
            lambda r, i: F.named_struct(
                F.lit("strategy"),
                F.lit(strategy_name(d)),
                F.lit("row"),
                r,
                F.lit("p"),
                F.element_at("p", (i + size * at + 1).cast("int")),
            ),
        )

    picked = F.explode(F.flatten(F.array(*[labelled(k, d) for k, d in enumerate(degrees)])))
    rows = out.select(*keys, "__mean", "__spread", picked.alias("__r"))
    kept = [F.col(f"__r.row.{n}").alias(n) for n in (*spec.order, spec.value, "y")]
    return rows.select(
        *keys,
        *kept,
        F.col("__r.strategy").alias("strategy"),
        (F.col("__mean") + F.col("__spread") * F.col("__r.p")).alias("prediction"),
    )


def direction_accuracy(predictions: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Share of steps whose direction was predicted, and suggested buys.

    Runs over test rows, so a window holds at most ``test_days`` rows.
    """
    keys = [*spec.keys, "strategy"]
    w = W.partitionBy(*keys).orderBy(*spec.order)
    y, p = F.col(spec.value), F.col("prediction")
    next_y, next_p = F.lead(y).over(w), F.lead(p).over(w)
    hit = F.when(next_y.isNotNull(), ((y < next_y) == (p < next_p)).cast("double"))
    rows = predictions.withColumn("__hit", hit)
    accuracy = F.coalesce(F.avg("__hit") * 100, F.lit(0.0))
    return rows.groupBy(*keys).agg(
        accuracy.alias("accuracy_pct"),
        (100 - accuracy).alias("error_pct"),
        F.count_if(p > y).alias("suggested_buys"),
        F.count(F.lit(1)).alias("total_days"),
    )
