"""DuckDB SQL that computes each registered query independently.

Written from the definitions, with other methods where there is a choice:
sorted lists for quantiles, window regressions for expanding fits,
Gram-Schmidt for multiple regression, the power series for tail probabilities.
Doubles are rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from candlewick.config import MODEL_FEATURES
from candlewick.functions.least_squares import monomials
from candlewick.operators import inference, reports
from candlewick.operators.features import FEATURES
from candlewick.plans.queries import GAP_BELOW, LONG_TAIL, RETURNS_EXPECTED, SHORT_TAIL, WIDER

ORACLES: dict[str, str] = {}


def r(expr: str, digits: int, alias: str | None = None) -> str:
    scale = f"{10.0**digits}::DOUBLE"
    text = f"(round_even(({expr}) * {scale}, 0) / {scale} + 0.0::DOUBLE)"
    return f"{text} AS {alias}" if alias else text


def fixed(expr: str, digits: int) -> str:
    value = r(expr, digits)
    return f"CASE WHEN ({expr}) IS NOT NULL THEN printf('%.{digits}f', {value}) END"


def with_(ctes: Sequence[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# -- shared pieces -----------------------------------------------------------------
PRICES = "prices AS (SELECT event_type AS symbol, ts AS date, event_id AS id, value AS close FROM events)"
WIDE = (
    "prices AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS date, event_id AS id,"
    " value AS close FROM events)"
)
ORDERS = (
    "prices AS (SELECT o_orderpriority AS symbol, o_orderdate AS date, o_orderkey AS id,"
    " o_totalprice AS close FROM orders)"
)
GAPPED = (
    "prices AS (SELECT event_type AS symbol, ts AS date, event_id AS id,"
    f" CASE WHEN value >= {GAP_BELOW}::DOUBLE THEN value END AS close FROM events)"
)
RETURNS = (
    "returns AS (SELECT l_returnflag AS symbol, l_linestatus AS strategy,"
    " l_discount - CAST(0.05 AS DOUBLE) AS return_pct,"
    " CASE WHEN l_quantity > 10 THEN 'Yes' ELSE 'No' END AS investment_made FROM lineitem)"
)
FEATURE_STEPS = [
    """filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol
      ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM prices)""",
    """daily_change AS (SELECT *, filled / nullif(lag(filled) OVER w, 0) - 1 AS return_1d,
      filled / nullif(lag(filled, 7) OVER w, 0) - 1 AS return_7d,
      close - lag(close, 7) OVER w AS momentum_7d,
      lag(close) OVER w AS previous_close
      FROM filled WINDOW w AS (PARTITION BY symbol ORDER BY date, id))""",
    """features AS (SELECT symbol, date, id, close, return_1d, return_7d, momentum_7d, previous_close,
      CASE WHEN count(close) OVER w = 7 THEN avg(close) OVER w END AS mean_7d,
      CASE WHEN count(close) OVER w = 7 THEN stddev_samp(close) OVER w END AS std_7d,
      CASE WHEN count(close) OVER w = 7 THEN max(close) OVER w END AS rolling_max_7d,
      CASE WHEN count(close) OVER w = 7 THEN min(close) OVER w END AS rolling_min_7d,
      CASE WHEN count(return_1d) OVER w = 7 THEN stddev_samp(return_1d) OVER w END AS volatility_7d
      FROM daily_change WINDOW w AS (PARTITION BY symbol ORDER BY date, id
        ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
    "complete AS (SELECT * FROM features WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in MODEL_FEATURES)
    + ")",
]


def features(source: str) -> list[str]:
    return [source, *FEATURE_STEPS]


def _columns(names: Sequence[str], digits: int) -> str:
    return ", ".join(r(c, digits, c) for c in names)


# -- projections and filters -------------------------------------------------------
ORACLES["filter_symbols"] = with_(
    [PRICES], "SELECT symbol, id AS event_id, close FROM prices WHERE symbol IN ('click', 'view')"
)
ORACLES["filter_invested"] = with_(
    [RETURNS],
    f"SELECT symbol, strategy, {r('return_pct', 6, 'return_pct')}, investment_made"
    " FROM returns WHERE investment_made = 'Yes'",
)
ORACLES["distinct_symbols"] = with_([PRICES], "SELECT DISTINCT symbol FROM prices")
ORACLES["features_complete_rows"] = with_(
    features(GAPPED),
    f"SELECT symbol, id AS event_id, {_columns(('close', *FEATURES), 4)} FROM complete",
)
ORACLES["drop_any_null"] = with_(
    features(GAPPED),
    f"SELECT symbol, id AS event_id, {r('close', 4, 'close')} FROM features WHERE close IS NOT NULL"
    + "".join(f" AND {c} IS NOT NULL" for c in FEATURES),
)
ORACLES["model_matrix"] = with_(
    features(PRICES),
    f"SELECT symbol, id AS event_id, {_columns((*MODEL_FEATURES, 'close'), 4)} FROM complete",
)
ORACLES["trade_signal"] = with_(
    features(PRICES),
    "SELECT symbol, id AS event_id, close, previous_close AS prediction,"
    " CASE WHEN previous_close > close THEN 'Yes' ELSE 'No' END AS investment_made"
    " FROM features WHERE previous_close IS NOT NULL",
)
ORACLES["union_by_name"] = """
SELECT event_type AS symbol, event_id, NULL::BIGINT AS o_orderkey, value AS close FROM events
UNION ALL BY NAME
SELECT o_orderpriority AS symbol, o_orderkey, o_totalprice AS close FROM orders"""
ORACLES["sanitize_symbol"] = (
    "SELECT event_id, replace(event_type || '/USDT', '/', '_') AS symbol FROM events"
)
ORACLES["format_run_timestamp"] = (
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M') AS prefix FROM events"
)
ORACLES["round_half_even"] = (
    f"SELECT event_id, {r('value / 8', 2, 'rounded_2')}, {r('value / 8', 4, 'rounded_4')} FROM events"
)


# -- statistics ----------------------------------------------------------------------
def _quantile(values: str, p: float) -> str:
    """Linear interpolation between the neighbours in a sorted list."""
    at = f"((len({values}) - 1) * {p}::DOUBLE)"
    low = f"{values}[CAST(floor({at}) AS BIGINT) + 1]"
    high = f"{values}[CAST(ceil({at}) AS BIGINT) + 1]"
    if p == 0.5:
        return f"(({low} + {high}) / 2)"
    part = f"({at} - floor({at}))"
    return (
        f"(CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part}"
        f" ELSE {high} - ({high} - {low}) * (1 - {part}) END)"
    )


def described(by: str = "symbol", source: str = "prices") -> list[str]:
    return [
        f"""sorted AS (SELECT {by}, list_sort(list(close)) AS vals, avg(close) AS mean,
          stddev_samp(close) AS sd, var_samp(close) AS variance, min(close) AS low, max(close) AS high
          FROM {source} WHERE close IS NOT NULL GROUP BY {by})""",
        f"""frequent AS (SELECT {by}, close AS mode FROM (SELECT {by}, close,
          row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, close) AS rank
          FROM {source} WHERE close IS NOT NULL GROUP BY {by}, close) WHERE rank = 1)""",
        f"""described AS (SELECT sorted.*, mode, {_quantile('vals', 0.25)} AS q1,
          {_quantile('vals', 0.5)} AS median, {_quantile('vals', 0.75)} AS q3,
          list_avg(list_transform(vals, lambda v: abs(v - mean))) AS mad
          FROM sorted JOIN frequent USING ({by}))""",
    ]


ORACLES["summary_statistics"] = with_(
    [PRICES, *described()],
    f"""SELECT symbol, {r('mean', 2, 'mean')}, {r('median', 2, 'median')}, {r('mode', 2, 'mode')},
      {r('low', 2, 'min')}, {r('high', 2, 'max')} FROM described""",
)
DISPERSION = f"""dispersion AS (SELECT symbol, {r('sd', 2, 'std_dev')}, {r('variance', 2, 'variance')},
  {r(f"{r('sd', 2)} / nullif(mean, 0) * 100", 2, 'coef_variation')}, {r('high - low', 2, 'range')},
  {r('q1', 2, 'q1')}, {r('q3', 2, 'q3')}, {r(f"{r('q3', 2)} - {r('q1', 2)}", 2, 'iqr')} FROM described)"""
ORACLES["dispersion_statistics"] = with_(
    [PRICES, *described(), DISPERSION], "SELECT * FROM dispersion"
)
ORACLES["export_fixed_decimals"] = with_(
    [PRICES, *described(), DISPERSION],
    "SELECT symbol, "
    + ", ".join(
        f"{fixed(c, 2)} AS {c}"
        for c in ("std_dev", "variance", "coef_variation", "range", "q1", "q3", "iqr")
    )
    + " FROM dispersion",
)
COMPARISON = f"""comparison AS (SELECT symbol, {r('sd', 2, 'desvio_padrao')}, {r('variance', 2, 'variancia')},
  {r(f"{r('sd', 2)} / nullif({r('mean', 2)}, 0) * 100", 2, 'coef_variacao')},
  {r('high - low', 2, 'amplitude')},
  {r(f"{r('q3', 2)} - {r('q1', 2)}", 2, 'amplitude_interquartil')},
  {r(f"{r(f'''{r('q3', 2)} - {r('q1', 2)}''', 2)} / 2", 2, 'semi_iqr')},
  {r('mad', 2, 'desvio_medio_absoluto')}, {r('mean', 2, 'media')}, {r('q1', 2, 'q1')}, {r('q3', 2, 'q3')}
  FROM described)"""
ORACLES["dispersion_comparison"] = with_(
    [PRICES, *described(), COMPARISON],
    "SELECT * FROM comparison ORDER BY coef_variacao DESC NULLS LAST, symbol",
)
ORACLES["volatility_ranking"] = with_(
    [PRICES, *described(), COMPARISON],
    """SELECT symbol, coef_variacao, desvio_padrao,
      row_number() OVER (ORDER BY coef_variacao DESC NULLS LAST, symbol) AS position,
      rank() OVER (ORDER BY coef_variacao DESC NULLS LAST) AS rank FROM comparison""",
)
ORACLES["mean_abs_deviation"] = with_(
    [WIDE, *described()], "SELECT symbol, mad::FLOAT::DOUBLE AS mean_abs_deviation FROM described"
)
VARIABILITY = "spread AS (SELECT symbol, stddev_samp(close) AS variability FROM prices GROUP BY symbol)"
ORACLES["compare_variability"] = with_(
    [WIDE, VARIABILITY], f"SELECT symbol, {r('variability', 6, 'variability')} FROM spread"
)
MONTHLY = [
    ORDERS,
    "monthly AS (SELECT *, strftime(date, '%Y-%m') AS month_year FROM prices)",
]
ORACLES["price_trends_monthly"] = with_(
    [
        *MONTHLY,
        *described("symbol, month_year", "monthly"),
        """final AS (SELECT symbol, month_year, close FROM monthly WHERE close IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY symbol, month_year ORDER BY date DESC, id DESC) = 1)""",
    ],
    f"""SELECT symbol, month_year, mean::FLOAT::DOUBLE AS mean, {r('median', 4, 'median')},
      {r('mode', 4, 'mode')}, {r('close', 4, 'close')}
      FROM final LEFT JOIN described USING (symbol, month_year)""",
)


# -- features --------------------------------------------------------------------------
def _feature_query(source: str, key: str) -> str:
    return with_(
        features(source),
        f"SELECT symbol, id AS {key}, {_columns(('close', *FEATURES), 4)} FROM features",
    )


ORACLES["features_7d"] = _feature_query(PRICES, "event_id")
ORACLES["features_7d_wide"] = _feature_query(WIDE, "event_id")
ORACLES["features_7d_tied"] = _feature_query(ORDERS, "o_orderkey")
ORACLES["features_7d_sliced"] = _feature_query(ORDERS, "o_orderkey")
ORACLES["features_7d_gaps"] = _feature_query(GAPPED, "event_id")
ORACLES["return_1d"] = with_(
    features(PRICES), f"SELECT symbol, id AS event_id, {r('return_1d', 6, 'return_1d')} FROM features"
)
ORACLES["features_gap_fill"] = with_(
    features(GAPPED), "SELECT symbol, id AS event_id, close, filled AS close_filled FROM filled"
)
ORACLES["trade_days"] = with_(
    [
        PRICES,
        """following AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date, id)
          AS next_price FROM prices)""",
    ],
    "SELECT symbol, id AS event_id, close, next_price FROM following WHERE next_price IS NOT NULL",
)


# -- models ----------------------------------------------------------------------------
def tail_steps(test_rows: int, min_train: int = 30) -> list[str]:
    """Expanding one-feature fits and the tail split over ``complete``."""
    return [
        """fits AS (SELECT *,
          row_number() OVER (PARTITION BY symbol ORDER BY date, id) AS rn,
          count(*) OVER (PARTITION BY symbol) AS n,
          regr_slope(close, mean_7d) OVER w AS b1, regr_intercept(close, mean_7d) OVER w AS a1,
          regr_slope(close, momentum_7d) OVER w AS b2, regr_intercept(close, momentum_7d) OVER w AS a2
          FROM complete WINDOW w AS (PARTITION BY symbol ORDER BY date, id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        f"split AS (SELECT *, rn > n - {test_rows} AS is_test FROM fits WHERE n - {test_rows} >= {min_train})",
        "tail AS (SELECT * FROM split WHERE is_test)",
        """simple AS (
          SELECT symbol, date, id, close, 'ols_mean_7d' AS strategy, a1 + b1 * mean_7d AS prediction FROM tail
          UNION ALL
          SELECT symbol, date, id, close, 'ols_momentum_7d', a2 + b2 * momentum_7d FROM tail)""",
        """predicted AS (SELECT * FROM simple UNION ALL
          SELECT symbol, date, id, close, 'naive', previous_close FROM tail)""",
    ]


ORACLES["train_test_split_tail"] = with_(
    [*features(WIDE), *tail_steps(SHORT_TAIL)],
    "SELECT symbol, id AS event_id, rn, n, is_test FROM split",
)
ORACLES["walk_forward_simple"] = with_(
    [*features(WIDE), *tail_steps(SHORT_TAIL)],
    f"SELECT symbol, id AS event_id, close, strategy, {r('prediction', 4, 'prediction')} FROM simple",
)
LINES = """lines AS (SELECT regr_slope(close, mean_7d) AS b1, regr_intercept(close, mean_7d) AS a1,
  regr_slope(close, momentum_7d) AS b2, regr_intercept(close, momentum_7d) AS a2 FROM complete)"""
IN_SAMPLE = [
    *features(PRICES),
    LINES,
    """pairs AS (
      SELECT symbol, id, close, 0 AS ord, 'naive' AS strategy, previous_close AS p FROM complete
      UNION ALL
      SELECT symbol, id, close, 1, 'ols_mean_7d', a1 + b1 * mean_7d FROM complete, lines
      UNION ALL
      SELECT symbol, id, close, 2, 'ols_momentum_7d', a2 + b2 * momentum_7d FROM complete, lines)""",
    """quality AS (SELECT strategy, ord, count(*) AS n, avg((close - p) * (close - p)) AS mse,
      sqrt(avg((close - p) * (close - p))) AS rmse, corr(close, p) AS correlation,
      1 - sum((close - p) * (close - p)) / (var_pop(close) * count(*)) AS r2
      FROM pairs GROUP BY strategy, ord)""",
    "best AS (SELECT strategy AS best, r2 AS score FROM quality ORDER BY r2 DESC, ord LIMIT 1)",
]
ORACLES["ols_simple"] = with_(
    features(PRICES),
    f"""SELECT symbol, count(*) AS n,
      {r('regr_slope(close, mean_7d)', 6, 'ols_mean_7d_slope')},
      {r('regr_intercept(close, mean_7d)', 6, 'ols_mean_7d_intercept')},
      {r('regr_slope(close, momentum_7d)', 6, 'ols_momentum_7d_slope')},
      {r('regr_intercept(close, momentum_7d)', 6, 'ols_momentum_7d_intercept')}
      FROM complete GROUP BY symbol""",
)
ORACLES["actual_vs_predicted"] = with_(
    IN_SAMPLE,
    f"SELECT symbol, id AS event_id, {r('close', 4, 'close')}, strategy, {r('p', 4, 'prediction')} FROM pairs",
)
ORACLES["model_rmse"] = with_(
    IN_SAMPLE, f"SELECT strategy, n, {r('mse', 6, 'mse')}, {r('rmse', 6, 'rmse')} FROM quality"
)
ORACLES["model_r2"] = with_(IN_SAMPLE, f"SELECT strategy, {r('r2', 6, 'r2')} FROM quality")
ORACLES["model_correlation"] = with_(
    IN_SAMPLE, f"SELECT strategy, {r('correlation', 6, 'correlation')} FROM quality"
)
ORACLES["best_model"] = with_(
    IN_SAMPLE, f"SELECT best AS strategy, {r('score', 6, 'score')} FROM best"
)
ORACLES["rmse_vs_best"] = with_(
    IN_SAMPLE,
    f"""SELECT a.strategy, best, {r('sqrt(avg((a.p - b.p) * (a.p - b.p)))', 6, 'rmse_vs_best')},
      bool_and(a.p = b.p) AS identical_to_best
      FROM best JOIN pairs b ON b.strategy = best JOIN pairs a ON a.symbol = b.symbol AND a.id = b.id
      GROUP BY a.strategy, best""",
)


def _kfold_simple(name: str, feature: str) -> str:
    return f"""
    SELECT '{name}' AS strategy, count(*)::BIGINT AS folds, {r('avg(mse)', 6, 'mse')},
      {r('sqrt(avg(mse))', 6, 'rmse')}
    FROM (SELECT h.fold, avg((close - (a + b * {feature})) * (close - (a + b * {feature}))) AS mse
      FROM held h JOIN (SELECT k AS fold, regr_slope(close, {feature}) AS b,
          regr_intercept(close, {feature}) AS a
        FROM held, range(0, 5) t(k) WHERE held.fold <> k GROUP BY k) f USING (fold)
      GROUP BY h.fold)"""


ORACLES["kfold_rmse"] = with_(
    [*features(PRICES), "held AS (SELECT *, id % 5 AS fold FROM complete)"],
    _kfold_simple("ols_mean_7d", "mean_7d")
    + " UNION ALL "
    + _kfold_simple("ols_momentum_7d", "momentum_7d"),
)


def gram_schmidt(source: str, name: str, keys: str, terms: Sequence[str]) -> list[str]:
    """Least-squares residuals by sequential orthogonalisation.

    ``source`` has the group ``keys``, a flag ``train``, the terms and ``y``.
    Each step removes one term's direction, measured on the training rows, from
    the remaining columns; what is left of y is the residual ``e``.
    """
    columns = [*terms, "y"]
    part = f"PARTITION BY {keys}"
    centred = ", ".join(f"{c} - avg({c}) FILTER (train) OVER ({part}) AS {c}" for c in columns)
    steps = [f"{name}_0 AS (SELECT * EXCLUDE ({', '.join(columns)}), y AS target, {centred} FROM {source})"]
    for i, t in enumerate(terms):
        later = columns[i + 1 :]
        removed = ", ".join(
            f"{c} - {t} * coalesce(sum({c} * {t}) FILTER (train) OVER ({part})"
            f" / nullif(sum({t} * {t}) FILTER (train) OVER ({part}), 0), 0) AS {c}"
            for c in later
        )
        drop = ", ".join([t, *later])
        steps.append(
            f"{name}_{i + 1} AS (SELECT * EXCLUDE ({drop}), {removed} FROM {name}_{i})"
        )
    steps.append(f"{name} AS (SELECT * EXCLUDE (y), y AS e FROM {name}_{len(terms)})")
    return steps


# Any affine scaling spans the same polynomials; these keep the steps accurate.
SCALED = """scaled AS (SELECT *, (mean_7d - avg(mean_7d) OVER ()) / stddev_samp(mean_7d) OVER () AS x0,
  (std_7d - avg(std_7d) OVER ()) / stddev_samp(std_7d) OVER () AS x1,
  (return_7d - avg(return_7d) OVER ()) / stddev_samp(return_7d) OVER () AS x2,
  (momentum_7d - avg(momentum_7d) OVER ()) / stddev_samp(momentum_7d) OVER () AS x3,
  (volatility_7d - avg(volatility_7d) OVER ()) / stddev_samp(volatility_7d) OVER () AS x4 FROM complete)"""


def _terms(degree: int) -> tuple[list[str], str]:
    names, exprs = [], []
    for i, powers in enumerate(monomials(len(MODEL_FEATURES), degree)[1:]):
        names.append(f"z{i}")
        factors = [f"x{j}" for j, p in enumerate(powers) for _ in range(p)]
        exprs.append(" * ".join(factors) + f" AS z{i}")
    return names, ", ".join(exprs)


def _fitted(degree: int, name: str) -> list[str]:
    names, exprs = _terms(degree)
    return [
        f"{name}_rows AS (SELECT symbol, id, close, true AS train, 1 AS g, close AS y, {exprs} FROM scaled)",
        *gram_schmidt(f"{name}_rows", name, "g", names),
    ]


def _polynomial_quality() -> str:
    steps, selects = [*features(PRICES), SCALED], []
    for d in (2, 3):
        steps += _fitted(d, f"poly{d}")
        p = "(target - e)"
        selects.append(
            f"""SELECT 'PolynomialRegression_degree_{d}' AS strategy, count(*) AS n,
              {r('avg(e * e)', 3, 'mse')}, {r('sqrt(avg(e * e))', 3, 'rmse')},
              {r('1 - avg(e * e) / var_pop(target)', 3, 'r2')}, {r(f'corr(target, {p})', 3, 'correlation')}
              FROM poly{d}"""
        )
    return with_(steps, " UNION ALL ".join(selects))


ORACLES["poly_regression"] = _polynomial_quality()


ORACLES["ols_in_sample"] = with_(
    [*features(PRICES), SCALED, *_fitted(1, "fitted")],
    f"""SELECT symbol, id AS event_id, {r('close', 4, 'close')}, 'LinearRegression' AS strategy,
      {r('target - e', 4, 'prediction')} FROM fitted""",
)


def _kfold(degree: int, label: str) -> tuple[list[str], str]:
    names, exprs = _terms(degree)
    n = f"fold{degree}"
    steps = [
        f"""{n}_rows AS (SELECT k AS model, id % 5 <> k AS train, close AS y, {exprs}
          FROM scaled, range(0, 5) t(k))""",
        *gram_schmidt(f"{n}_rows", n, "model", names),
    ]
    select = f"""SELECT '{label}' AS strategy, count(*)::INTEGER AS folds, {r('avg(mse)', 4, 'mse')},
      {r('sqrt(avg(mse))', 4, 'rmse')}
      FROM (SELECT model, avg(e * e) AS mse FROM {n} WHERE NOT train GROUP BY model)"""
    return steps, select


def _kfold_linear() -> str:
    one, first = _kfold(1, "LinearRegression")
    two, second = _kfold(2, "PolynomialRegression_degree_2")
    return with_([*features(PRICES), SCALED, *one, *two], f"{first} UNION ALL {second}")


ORACLES["kfold_linear"] = _kfold_linear()


def _walk_forward(source: str, test_rows: int, degrees: Sequence[int], digits: int) -> str:
    """Each test row with a copy of all rows before it as its training set."""
    steps = [*features(source), SCALED]
    steps.append(
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, id) AS rn,
          count(*) OVER (PARTITION BY symbol) AS n FROM scaled)"""
    )
    selects = []
    for d in degrees:
        names, exprs = _terms(d)
        label = "LinearRegression" if d == 1 else f"PolynomialRegression_degree_{d}"
        steps.append(
            f"""walk{d}_rows AS (SELECT a.symbol, a.id, a.close, t.rn AS model, a.rn < t.rn AS train,
              a.close AS y, {', '.join(_qualified(exprs))}
              FROM placed t JOIN placed a ON a.symbol = t.symbol AND a.rn <= t.rn
              WHERE t.rn > t.n - {test_rows} AND t.n - {test_rows} >= 30)"""
        )
        steps += gram_schmidt(f"walk{d}_rows", f"walk{d}", "symbol, model", names)
        selects.append(
            f"""SELECT symbol, id AS event_id, {r('close', digits, 'close')}, '{label}' AS strategy,
              {r('target - e', digits, 'prediction')} FROM walk{d} WHERE NOT train"""
        )
    return with_(steps, " UNION ALL ".join(selects))


def _qualified(exprs: str) -> list[str]:
    return [" * ".join(f"a.{f}" for f in e.split(" * ")) for e in exprs.split(", ")]


def _stump(source: str, test_rows: int) -> str:
    """Before each test row the one split of greatest gain over all features and bins."""
    names = ("mean_7d", "std_7d", "return_7d", "momentum_7d", "volatility_7d")
    level = ", ".join(
        f"avg({c}) FILTER (NOT is_test) AS m{i}, stddev_samp({c}) FILTER (NOT is_test) AS s{i}" for i, c in enumerate(names)
    )
    bins = ", ".join(
        f"CASE WHEN s{i} > 0 THEN least(greatest(floor(({c} - m{i}) / s{i} * 3.2 + 8), 0), 15) ELSE 8 END"
        for i, c in enumerate(names)
    )
    prediction = """my + CASE WHEN NOT top > 1e-12 * s * s THEN s / n
      WHEN own <= c THEN sl / nl ELSE (s - sl) / (n - nl) END"""
    return with_(
        [
            *features(source),
            *tail_steps(test_rows),
            f"level AS (SELECT symbol, avg(close) FILTER (NOT is_test) AS my, {level} FROM split GROUP BY symbol)",
            f"""binned AS (SELECT symbol, id, rn, is_test, close, close - my AS y, my,
              unnest(range(0, 5)) AS f, unnest([{bins}]) AS bin FROM split JOIN level USING (symbol))""",
            """cuts AS (SELECT t.symbol, t.id, t.f, c, t.bin AS own, t.close, t.my, count(*) AS n, sum(b.y) AS s,
              count(*) FILTER (b.bin <= c) AS nl, coalesce(sum(b.y) FILTER (b.bin <= c), 0) AS sl
              FROM binned t JOIN binned b ON t.is_test AND b.symbol = t.symbol AND b.f = t.f AND b.rn < t.rn,
                range(0, 15) g(c) GROUP BY ALL)""",
            """gains AS (SELECT *, CASE WHEN nl > 0 AND nl < n
              THEN sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n ELSE '-inf'::DOUBLE END AS gain FROM cuts)""",
            "tops AS (SELECT *, max(gain) OVER (PARTITION BY symbol, id) AS top FROM gains)",
            """chosen AS (SELECT * FROM tops WHERE gain >= top - 1e-9 * abs(top)
              QUALIFY row_number() OVER (PARTITION BY symbol, id ORDER BY f, c) = 1)""",
        ],
        f"""SELECT symbol, id AS event_id, close, 'DecisionStump' AS strategy, {r(prediction, 9, 'prediction')}
          FROM chosen""",
    )


ORACLES["walk_forward_stump"] = _stump(WIDE, SHORT_TAIL)
ORACLES["estimator_in_sample"] = ORACLES["ols_in_sample"]
ORACLES["walk_forward_linear"] = _walk_forward(WIDE, SHORT_TAIL, (1,), 3)
ORACLES["walk_forward_polynomial"] = _walk_forward(PRICES, LONG_TAIL, (1, 2), 2)


# -- backtest --------------------------------------------------------------------------
DAILY_STEPS = [
    """steps AS (SELECT *, lead(close) OVER (PARTITION BY symbol, strategy ORDER BY date, id) AS next_price,
      prediction > close AS buy FROM predicted)""",
    """gains AS (SELECT *, (next_price - close) / nullif(close, 0) AS rate FROM steps
      WHERE next_price IS NOT NULL)""",
    """capital AS (SELECT *, 1000.0::DOUBLE * product(CASE WHEN buy THEN 1 + rate ELSE 1 END) OVER (
      PARTITION BY symbol, strategy ORDER BY date, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM gains)""",
    """signal AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY symbol, strategy ORDER BY date, id),
      1000.0::DOUBLE) AS before FROM capital)""",
    """held AS (SELECT *, lead(close) OVER w AS next_price, first_value(close) OVER w AS start FROM tail
      WINDOW w AS (PARTITION BY symbol ORDER BY date, id))""",
    """trades AS (
      SELECT date, id, symbol, strategy, close, prediction, next_price, buy, rate, before, after FROM signal
      UNION ALL
      SELECT date, id, symbol, 'Buy and Hold', close, close, next_price, true,
        (next_price - close) / close, 1000.0::DOUBLE * (close / start), 1000.0::DOUBLE * (next_price / start)
      FROM held WHERE next_price IS NOT NULL)""",
    f"""daily AS (SELECT date, id AS event_id, symbol, strategy, {r('close', 2, 'current_price')},
      {r('prediction', 2, 'predicted_price')}, {r('next_price', 2, 'next_price')},
      CASE WHEN buy THEN 'Yes' ELSE 'No' END AS investment_made,
      {r('before', 2, 'capital_before')},
      {r('CASE WHEN buy THEN before ELSE 0 END', 2, 'capital_invested')},
      {r('after', 2, 'capital_after')}, {r('after - before', 2, 'capital_gained')},
      {r('CASE WHEN buy THEN rate ELSE 0 END', 4, 'return_pct')} FROM trades)""",
]


def daily(source: str, test_rows: int) -> list[str]:
    return [*features(source), *tail_steps(test_rows), *DAILY_STEPS]


LONG_DAILY, WIDE_DAILY = daily(PRICES, LONG_TAIL), daily(WIDE, SHORT_TAIL)
ORACLES["backtest_daily"] = with_(LONG_DAILY, "SELECT * FROM daily")
ORACLES["backtest_daily_wide"] = with_(WIDE_DAILY, "SELECT * EXCLUDE (date, event_id) FROM daily")
ORACLES["buy_and_hold"] = with_(
    WIDE_DAILY, "SELECT * EXCLUDE (date) FROM daily WHERE strategy = 'Buy and Hold'"
)
ORACLES["backtest_consolidated"] = with_(
    [
        *WIDE_DAILY,
        """ended AS (SELECT symbol, strategy, arg_max(after, (date, id)) AS final
          FROM trades GROUP BY symbol, strategy)""",
    ],
    f"""SELECT symbol, strategy, 1000.0::DOUBLE AS initial_value, {r('final', 2, 'final_value')},
      {r('(final - 1000.0::DOUBLE) / 1000.0::DOUBLE', 4, 'return_pct')} FROM ended""",
)
ORACLES["capital_curve"] = with_(
    [
        *features(PRICES),
        *tail_steps(LONG_TAIL),
        """earlier AS (SELECT *, lag(close) OVER (PARTITION BY symbol, strategy ORDER BY date, id) AS before
          FROM predicted)""",
        """curve AS (SELECT symbol, strategy, id, 1000.0::DOUBLE * product(
            CASE WHEN prediction > before THEN close / before ELSE 1 END) OVER (
            PARTITION BY symbol, strategy ORDER BY date, id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capital FROM earlier
          UNION ALL
          SELECT symbol, 'Buy and Hold', id, 1000.0::DOUBLE * (close / first_value(close) OVER (
            PARTITION BY symbol ORDER BY date, id)) FROM tail)""",
    ],
    f"SELECT symbol, strategy, id AS event_id, {r('capital', 4, 'capital')} FROM curve",
)
ORACLES["direction_accuracy"] = with_(
    [
        *features(WIDE),
        *tail_steps(SHORT_TAIL),
        """ahead AS (SELECT *, lead(close) OVER w AS next_y, lead(prediction) OVER w AS next_p FROM predicted
          WINDOW w AS (PARTITION BY symbol, strategy ORDER BY date, id))""",
        """scored AS (SELECT symbol, strategy, coalesce(avg(CASE WHEN next_y IS NOT NULL
            THEN ((close < next_y) = (prediction < next_p))::INTEGER END) * 100, 0) AS accuracy,
          count(*) FILTER (prediction > close) AS buys, count(*) AS days
          FROM ahead GROUP BY symbol, strategy)""",
    ],
    f"""SELECT symbol, strategy, {r('accuracy', 6, 'accuracy_pct')}, {r('100 - accuracy', 6, 'error_pct')},
      buys AS suggested_buys, days AS total_days FROM scored""",
)


# -- tests on returns ------------------------------------------------------------------
def _series(a: str, b: str, x: str) -> str:
    """I_x(a, b) by its all-positive power series."""
    terms = (
        f"list_sum(list_transform(range(0, 3000), lambda step: exp(lgamma({a} + {b} + step)"
        f" - lgamma({a} + {b}) - lgamma({a} + 1 + step) + lgamma({a} + 1) + step * ln({x}))))"
    )
    front = (
        f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a}"
    )
    return f"({front} * {terms})"


def _t_two_sided(t: str, df: str) -> str:
    x = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    y = f"(({df}) / (({df}) + ({t}) * ({t})))"
    half = f"(({df}) / 2.0::DOUBLE)"
    a = "0.5::DOUBLE"
    return (
        f"(CASE WHEN {t} IS NULL OR {df} <= 0 THEN NULL WHEN isinf({t}) THEN 0 WHEN {t} = 0 THEN 1"
        f" WHEN {x} < 0.5 THEN 1 - {_series(a, half, x)} ELSE {_series(half, a, y)} END)"
    )


def _f_upper(f: str, d1: str, d2: str) -> str:
    x = f"({d1} * {f} / ({d2} + {d1} * {f}))"
    a, b = f"({d1} / 2.0::DOUBLE)", f"({d2} / 2.0::DOUBLE)"
    y = f"({d2} / ({d2} + {d1} * {f}))"
    return (
        f"(CASE WHEN {f} IS NULL THEN NULL WHEN isinf({f}) THEN 0 WHEN {f} <= 0 THEN 1"
        f" WHEN {x} < 0.5 THEN 1 - {_series(a, b, x)} ELSE {_series(b, a, y)} END)"
    )


INVESTED = [RETURNS, "facts AS (SELECT * FROM returns WHERE investment_made = 'Yes')"]
DAILY_FACTS = [*LONG_DAILY, "facts AS (SELECT * FROM daily WHERE investment_made = 'Yes')"]
WIDE_FACTS = [*WIDE_DAILY, "facts AS (SELECT * FROM daily WHERE investment_made = 'Yes')"]
COMBOS = """combos AS (SELECT symbol, strategy, symbol || ' - ' || strategy AS label, count(return_pct) AS n,
  avg(return_pct) AS mean, var_samp(return_pct) AS variance, stddev_samp(return_pct) AS sd
  FROM facts GROUP BY symbol, strategy)"""


def _ttest(expected: float) -> list[str]:
    mu = f"({expected}::DOUBLE / 100)"
    return [
        COMBOS,
        f"""t_values AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN (mean - {mu}) / (sd / sqrt(n))
          WHEN n > 1 AND mean > {mu} THEN 'inf'::DOUBLE WHEN n > 1 AND mean < {mu} THEN '-inf'::DOUBLE END AS t
          FROM combos)""",
        f"both_sides AS (SELECT *, {_t_two_sided('t', '(n - 1)')} AS p2 FROM t_values)",
        "tested AS (SELECT *, CASE WHEN t < 0 THEN p2 / 2 ELSE 1 - p2 / 2 END AS p FROM both_sides)",
        f"""verdicts AS (SELECT *, {expected}::DOUBLE AS expected, mean * 100 AS achieved,
          coalesce(t < 0 AND p < 0.05, false) AS rejected FROM tested)""",
        f"""ttest AS (SELECT *, CASE WHEN rejected THEN '{inference.REJECT}' ELSE '{inference.KEEP}' END
          AS conclusion FROM verdicts)""",
    ]


TTEST_SELECT = f"""SELECT symbol, strategy, {r('expected', 6, 'expected_mean_pct')},
  {r('achieved', 6, 'achieved_mean_pct')}, n, {r('t', 6, 't_stat')}, {r('p', 6, 'p_value')},
  rejected, conclusion FROM ttest"""
ORACLES["ttest_one_sample"] = with_([*INVESTED, *_ttest(RETURNS_EXPECTED)], TTEST_SELECT)
ORACLES["ttest_backtest"] = with_([*WIDE_FACTS, *_ttest(1.5)], TTEST_SELECT)
ORACLES["export_ttest_report"] = with_(
    [*INVESTED, *_ttest(RETURNS_EXPECTED)],
    f"""SELECT symbol AS "Cryptocurrency", strategy AS "Strategy", {fixed('expected', 4)} AS "Expected Mean (%)",
      {fixed('achieved', 4)} AS "Achieved Mean (%)", {fixed('t', 4)} AS "t-statistic",
      {fixed('p', 4)} AS "p-value", conclusion AS "Conclusion" FROM ttest""",
)
ORACLES["invested_counts"] = with_(
    [RETURNS],
    """SELECT count(*) AS total_rows, count(*) FILTER (investment_made = 'Yes') AS invested_rows
      FROM returns""",
)
ORACLES["combo_metrics"] = with_(
    [*INVESTED, COMBOS],
    f"""SELECT symbol, strategy, {r('mean', 6, 'mean_return')}, {r('sd', 6, 'volatility')},
      n AS investment_frequency FROM combos WHERE n > 1""",
)


def _split(criterion: str) -> list[str]:
    metric, high, low = inference.SPLITS[criterion]
    value = {"volatility": "sd", "mean_return": "mean", "investment_frequency": "n::DOUBLE"}[metric]
    n = f"split_{criterion}"
    return [
        f"{n}_middle AS (SELECT median({value}) AS middle FROM combos WHERE n > 1)",
        f"""{n} AS (SELECT symbol, strategy, label, '{criterion}' AS criterion, {value} AS metric,
          middle AS median, CASE WHEN {value} > middle THEN '{high}' ELSE '{low}' END AS group_name
          FROM combos, {n}_middle WHERE n > 1)""",
    ]


ORACLES["combo_median_split"] = with_(
    [*INVESTED, COMBOS, *[s for c in inference.SPLITS for s in _split(c)]],
    " UNION ALL ".join(
        f"SELECT criterion, symbol, strategy, {r('metric', 6, 'metric')}, {r('median', 6, 'median')},"
        f" group_name FROM split_{c}"
        for c in inference.SPLITS
    ),
)
ORACLES["group_members"] = with_(
    [*INVESTED, COMBOS, *_split("mean_return")],
    """SELECT group_name, string_agg(label, ', ' ORDER BY symbol, strategy) AS members
      FROM split_mean_return GROUP BY group_name""",
)
ORACLES["anova_groups_rows"] = with_(
    [*INVESTED, COMBOS, *_split("volatility")],
    f"""SELECT symbol, strategy, {r('return_pct', 6, 'return_pct')}, group_name
      FROM facts JOIN split_volatility USING (symbol, strategy) WHERE return_pct IS NOT NULL""",
)


def _groups(criterion: str | None) -> list[str]:
    """Rows (group_name, first, n, mean, variance) straight from the returns."""
    if criterion is None:
        return [
            COMBOS,
            """grouped AS (SELECT label AS group_name, (symbol, strategy) AS first, n, mean, variance
              FROM combos WHERE n > 1)""",
        ]
    return [
        COMBOS,
        *_split(criterion),
        f"""grouped AS (SELECT group_name, min((symbol, strategy)) AS first, count(return_pct) AS n,
          avg(return_pct) AS mean, var_samp(return_pct) AS variance
          FROM facts JOIN split_{criterion} USING (symbol, strategy)
          GROUP BY group_name HAVING count(return_pct) > 1)""",
    ]


def _anova(criterion: str | None, alpha: float = 0.05) -> list[str]:
    if criterion is None:
        different, same, error = inference.DIFFERENT, inference.SAME, inference.TOO_FEW_GROUPS
    else:
        different = f"Há diferença significativa entre os grupos ({criterion})"
        same = f"Não há diferença significativa entre os grupos ({criterion})"
        error = inference.TOO_FEW_GROUPS
    return [
        *_groups(criterion),
        "overall AS (SELECT sum(n * mean) / sum(n) AS grand FROM grouped)",
        """sums AS (SELECT count(*) AS k, sum(n)::BIGINT AS total,
          sum(n * (mean - grand) * (mean - grand)) AS ssb, sum((n - 1) * variance) AS ssw
          FROM grouped, overall)""",
        "f_values AS (SELECT *, CASE WHEN k >= 2 THEN (ssb / (k - 1)) / (ssw / (total - k)) END AS f FROM sums)",
        f"f_tested AS (SELECT *, {_f_upper('f', '(k - 1)', '(total - k)')} AS p FROM f_values)",
        f"""anova AS (SELECT *, coalesce(p < {alpha}, false) AS sig,
          CASE WHEN k < 2 THEN '{error}' END AS error,
          CASE WHEN k < 2 THEN NULL WHEN p < {alpha} THEN '{different}' ELSE '{same}' END AS conclusion
          FROM f_tested)""",
    ]


ANOVA_COLUMNS = f"""k AS groups, total AS observations, {r('f', 6, 'f_statistic')}, {r('p', 6, 'p_value')},
  sig AS is_significant, error, conclusion"""
ORACLES["anova_individual"] = with_([*INVESTED, *_anova(None)], f"SELECT {ANOVA_COLUMNS} FROM anova")
for _key, _criterion in (
    ("anova_by_volatility", "volatility"),
    ("anova_by_mean_return", "mean_return"),
    ("anova_by_frequency", "investment_frequency"),
):
    ORACLES[_key] = with_(
        [*INVESTED, *_anova(_criterion)],
        f"SELECT '{_criterion}' AS criterion, {ANOVA_COLUMNS} FROM anova",
    )



def _pairs(alpha: float = 0.05) -> list[str]:
    return [
        "numbered AS (SELECT *, row_number() OVER (ORDER BY first) AS ord FROM grouped)",
        """pairs AS (SELECT a.ord AS ord1, b.ord AS ord2, a.group_name AS group1, b.group_name AS group2,
      a.mean - b.mean AS mean_diff, a.n + b.n - 2 AS df,
      (a.mean - b.mean) / nullif(sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance)
        / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 0) AS t
      FROM numbered a JOIN numbered b ON a.ord < b.ord)""",
        f"paired AS (SELECT *, {_t_two_sided('t', 'df')} AS p FROM pairs)",
        f"posthoc AS (SELECT *, coalesce(p < {alpha}, false) AS hit FROM paired)",
    ]


ORACLES["pairwise_ttest"] = with_(
    [*INVESTED, *_groups(None), *_pairs()],
    f"""SELECT group1, group2, {r('mean_diff', 6, 'mean_diff')}, {r('t', 6, 't_statistic')},
      {r('p', 6, 'p_value')}, hit AS significant FROM posthoc""",
)
GATED = "gated AS (SELECT posthoc.* FROM posthoc, anova WHERE anova.sig)"
ORACLES["posthoc_summary"] = with_(
    [*DAILY_FACTS, *_anova("mean_return"), *_pairs(), GATED],
    f"""SELECT 'mean_return' AS criterion, group1, group2, {r('mean_diff', 6, 'mean_diff')},
      {r('t', 6, 't_statistic')}, {r('p', 6, 'p_value')}, hit AS significant,
      CASE WHEN hit AND mean_diff > 0 THEN 'MAIOR' WHEN hit THEN 'MENOR' END AS direction FROM gated""",
)
ORACLES["export_posthoc_individual"] = with_(
    [*INVESTED, *_anova(None, WIDER), *_pairs(WIDER), GATED],
    f"""SELECT group1 AS "Cryptocurrency_1", group2 AS "Cryptocurrency_2",
      {fixed('mean_diff', 4)} AS "Mean_Difference", {fixed('t', 4)} AS "T_Statistic",
      {fixed('p', 4)} AS "P_Value", CASE WHEN hit THEN 'Yes' ELSE 'No' END AS "Significant",
      '{reports.POST_HOC_METHOD}' AS "Test_Method" FROM gated""",
)


def _text_lines(source: str, section: int, item: str, lines: Sequence[str]) -> str:
    """Rows (section, item, part, line); null lines are left out."""
    listed = "list_filter([" + ", ".join(lines) + "], lambda l: l IS NOT NULL)"
    return (
        f"SELECT {section} AS section, item, part - 1 AS part, lines[part] AS line FROM"
        f" (SELECT item, lines, unnest(range(1, len(lines) + 1)) AS part FROM"
        f" (SELECT ({item})::BIGINT AS item, {listed} AS lines FROM {source}))"
    )


def _q(text: str) -> str:
    return f"'{text}'"


PAIR_ITEM = "ord1 * 2147483648 + ord2"
PAIR_LINES = [
    "group1 || ' vs ' || group2 || ':'",
    f"'  Diferença de Média: ' || {fixed('mean_diff', 4)}",
    f"'  Estatística t: ' || {fixed('t', 4)}",
    f"'  Valor p: ' || {fixed('p', 4)}",
    "'  Significativo: ' || CASE WHEN hit THEN 'Sim' ELSE 'Não' END",
    "''",
]
TEST_LINES = [
    "'RESULTADOS DA ANOVA:'",
    _q(reports.SINGLE),
    f"'Estatística F: ' || {fixed('f', 4)}",
    f"'Valor p: ' || {fixed('p', 4)}",
    "'Significativo: ' || CASE WHEN sig THEN 'Sim' ELSE 'Não' END",
    "'Conclusão: ' || conclusion",
    "''",
]
FOOTER = [_q(reports.DOUBLE), _q(reports.DONE), _q(reports.DOUBLE)]


def _report(parts: Sequence[str]) -> str:
    body = " UNION ALL ".join(parts)
    return f"SELECT section::INTEGER AS section, item, part::INTEGER AS part, line FROM ({body})"


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN '{text}' END"


ORACLES["report_anova_individual"] = with_(
    [*INVESTED, *_anova(None, WIDER), *_pairs(WIDER), GATED],
    _report(
        [
            _text_lines(
                "anova",
                1,
                "0",
                [
                    _q(reports.DOUBLE),
                    "'ANÁLISE ANOVA - CRIPTOMOEDAS INDIVIDUAIS'",
                    _q(reports.DOUBLE),
                    "''",
                    "'Tipo de Análise: ANOVA'",
                    "'Descrição do Teste: Comparação de retornos médios diários entre "
                    "criptomoedas individuais'",
                    "''",
                    "'CRIPTOMOEDAS ANALISADAS:'",
                    _q(reports.SINGLE),
                ],
            ),
            _text_lines("numbered", 2, "ord", ["ord || '. ' || group_name"]),
            _text_lines(
                "anova",
                3,
                "0",
                [
                    "''",
                    *TEST_LINES,
                    "'INTERPRETAÇÃO:'",
                    _q(reports.SINGLE),
                    "'H0 (Hipótese Nula): Os retornos médios são iguais entre todas as criptomoedas'",
                    "'H1 (Hipótese Alternativa): Pelo menos uma criptomoeda tem retorno médio diferente'",
                    "CASE WHEN sig THEN 'Resultado: REJEITAR H0 - Há diferenças significativas entre as"
                    " criptomoedas' ELSE 'Resultado: NÃO REJEITAR H0 - Não há diferenças significativas"
                    " entre as criptomoedas' END",
                    _when("NOT sig", "Análise Post Hoc: Não aplicável (ANOVA não significativa)"),
                    "''",
                    _when("sig", "ANÁLISE POST HOC (Teste t pareado):"),
                    _when("sig", reports.SINGLE),
                    _when("sig", "Para identificar quais criptomoedas diferem entre si:"),
                    _when("sig", ""),
                ],
            ),
            _text_lines("gated", 4, PAIR_ITEM, PAIR_LINES),
            _text_lines("anova", 5, "0", FOOTER),
        ]
    ),
)


def _member_steps(criterion: str) -> list[str]:
    return [
        f"""members AS (SELECT group_name, string_agg(label, ', ' ORDER BY symbol, strategy) AS labels,
          row_number() OVER (ORDER BY min((symbol, strategy))) AS i
          FROM split_{criterion} GROUP BY group_name)"""
    ]


ORACLES["report_anova_grouped"] = with_(
    [*DAILY_FACTS, *_anova("mean_return"), *_pairs(), GATED, *_member_steps("mean_return")],
    _report(
        [
            _text_lines(
                "anova",
                1,
                "0",
                [
                    _q(reports.DOUBLE),
                    "'ANÁLISE ANOVA - GRUPOS DE CRIPTOMOEDAS'",
                    _q(reports.DOUBLE),
                    "''",
                    "'Tipo de Análise: ANOVA'",
                    "'Descrição do Teste: Comparação de retornos médios diários entre grupos de "
                    "criptomoedas'",
                    "'Critério de Agrupamento: mean_return'",
                    "''",
                    "'GRUPOS FORMADOS:'",
                    _q(reports.SINGLE),
                ],
            ),
            _text_lines("members", 2, "i", ["group_name || ': ' || labels"]),
            _text_lines(
                "anova",
                3,
                "0",
                [
                    "''",
                    *TEST_LINES,
                    "CASE WHEN sig THEN 'ANÁLISE POST HOC (Teste t pareado):'"
                    " ELSE 'ANÁLISE POST HOC: Não aplicável (ANOVA não significativa)' END",
                    f"CASE WHEN sig THEN '{reports.SINGLE}' ELSE '' END",
                ],
            ),
            _text_lines("gated", 4, PAIR_ITEM, PAIR_LINES),
            _text_lines("anova", 5, "0", FOOTER),
        ]
    ),
)


def _posthoc_report(criterion: str) -> str:
    direction = "CASE WHEN mean_diff > 0 THEN 'MAIOR' ELSE 'MENOR' END"
    sign = "CASE WHEN mean_diff > 0 THEN '>' ELSE '<' END"
    return with_(
        [
            *DAILY_FACTS,
            *_anova(criterion),
            *_pairs(),
            GATED,
            *_member_steps(criterion),
            "yes AS (SELECT * FROM anova WHERE sig)",
            "no AS (SELECT * FROM anova WHERE NOT sig)",
            "ranked AS (SELECT *, row_number() OVER (ORDER BY ord1, ord2) AS i FROM gated)",
            """counted AS (SELECT count(*) AS total, count(*) FILTER (hit) AS hits FROM gated
              HAVING count(*) > 0)""",
        ],
        _report(
            [
                _text_lines(
                    "anova",
                    1,
                    "0",
                    [
                        _q(reports.DOUBLE),
                        "'ANÁLISE POST HOC - GRUPOS DE CRIPTOMOEDAS'",
                        _q(reports.DOUBLE),
                        "''",
                        f"'Critério de Agrupamento: {criterion}'",
                        "'Método do Teste: Teste t pareado'",
                        "'Objetivo: Identificar quais grupos diferem significativamente entre si'",
                        "''",
                    ],
                ),
                _text_lines(
                    "no",
                    2,
                    "0",
                    [
                        "'RESULTADO:'",
                        _q(reports.SINGLE),
                        "'ANOVA não foi significativa - Teste post hoc não aplicável'",
                        f"'Razão: p-valor da ANOVA (' || {fixed('p', 4)} || ') > 0.05'",
                        "'Conclusão: Não há diferenças significativas entre os grupos para justificar "
                        "comparações pareadas'",
                        "''",
                    ],
                ),
                _text_lines("yes", 2, "0", ["'GRUPOS FORMADOS:'", _q(reports.SINGLE)]),
                _text_lines(
                    "(SELECT members.* FROM members, yes)", 3, "i", ["group_name || ': ' || labels"]
                ),
                _text_lines("yes", 4, "0", ["''", "'COMPARAÇÕES PAREADAS:'", _q(reports.SINGLE)]),
                _text_lines(
                    "ranked",
                    5,
                    PAIR_ITEM,
                    [
                        "'COMPARAÇÃO ' || i || ': ' || group1 || ' vs ' || group2",
                        _q(reports.DASHES),
                        f"'Diferença de Média: ' || {fixed('mean_diff', 4)}",
                        f"'Estatística t: ' || {fixed('t', 4)}",
                        f"'Valor p: ' || {fixed('p', 4)}",
                        "'Resultado: ' || CASE WHEN hit THEN 'SIGNIFICATIVO' ELSE 'NÃO SIGNIFICATIVO' END",
                        f"CASE WHEN hit THEN 'Interpretação: ' || group1 || ' tem retorno médio ' || {direction}"
                        " || ' que ' || group2 ELSE 'Interpretação: Não há diferença significativa entre '"
                        " || group1 || ' e ' || group2 END",
                        "''",
                    ],
                ),
                _text_lines(
                    "counted",
                    6,
                    "0",
                    [
                        _q(reports.DOUBLE),
                        "'RESUMO DA ANÁLISE POST HOC:'",
                        _q(reports.DOUBLE),
                        "'Total de comparações realizadas: ' || total",
                        "'Comparações significativas: ' || hits",
                        "'Comparações não significativas: ' || (total - hits)",
                        "''",
                        "CASE WHEN hits > 0 THEN 'DIFERENÇAS SIGNIFICATIVAS ENCONTRADAS:'"
                        " ELSE 'Nenhuma diferença significativa foi encontrada entre os grupos.' END",
                        _when("hits > 0", reports.HALF_DASHES),
                    ],
                ),
                _text_lines(
                    "(SELECT * FROM gated WHERE hit)",
                    7,
                    PAIR_ITEM,
                    [
                        f"'• ' || group1 || ' ' || {sign} || ' ' || group2 || ' (p = ' || {fixed('p', 4)} || ')'"
                    ],
                ),
                _text_lines("anova", 8, "0", ["''", *FOOTER]),
            ]
        ),
    )


ORACLES["report_posthoc_grouped"] = _posthoc_report("mean_return")
ORACLES["report_posthoc_volatility"] = _posthoc_report("volatility")


def _overview() -> str:
    """One subquery per analysis, each with its own WITH."""
    parts = [
        with_(
            [*INVESTED, *_ttest(RETURNS_EXPECTED)],
            """SELECT 't-test' AS analysis, count(*) AS groups, sum(n)::BIGINT AS observations,
              min(t) AS statistic, min(p) AS p_value, count(*) FILTER (rejected) AS significant_results
              FROM ttest""",
        )
    ]
    for name, criterion in (
        ("anova individual", None),
        *[(f"anova {c}", c) for c in inference.SPLITS],
    ):
        parts.append(
            with_(
                [*INVESTED, *_anova(criterion)],
                f"SELECT '{name}', k, total, f, p, sig::BIGINT FROM anova",
            )
        )
    body = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""SELECT analysis, groups, observations, {r('statistic', 6, 'statistic')},
      {r('p_value', 6, 'p_value')}, significant_results FROM ({body})"""


ORACLES["analysis_overview"] = _overview()


# -- charts ----------------------------------------------------------------------------
ORACLES["boxplot_stats"] = with_(
    [
        WIDE,
        *described(),
        "boxes AS (SELECT symbol, vals, q1, median, q3, 1.5 * (q3 - q1) AS reach FROM described)",
    ],
    f"""SELECT symbol,
      {r('least(list_min(list_filter(vals, lambda v: v >= q1 - reach)), q1)', 4, 'whisker_low')},
      {r('q1', 4, 'q1')}, {r('median', 4, 'median')}, {r('q3', 4, 'q3')},
      {r('greatest(list_max(list_filter(vals, lambda v: v <= q3 + reach)), q3)', 4, 'whisker_high')},
      len(list_filter(vals, lambda v: v < q1 - reach OR v > q3 + reach))::BIGINT AS outliers
      FROM boxes""",
)
ORACLES["histogram_20"] = with_(
    [
        PRICES,
        """ranges AS (SELECT symbol, CASE WHEN min(close) = max(close) THEN min(close) - 0.5 ELSE min(close) END AS lo,
          CASE WHEN min(close) = max(close) THEN max(close) + 0.5 ELSE max(close) END AS hi
          FROM prices WHERE close IS NOT NULL GROUP BY symbol)""",
        """placed AS (SELECT symbol, b::INTEGER AS bin, count(*) AS n FROM prices JOIN ranges USING (symbol)
          JOIN range(1, 21) t(b) ON close >= lo + (hi - lo) / 20 * (b - 1)
            AND (b = 20 OR close < lo + (hi - lo) / 20 * b)
          WHERE close IS NOT NULL GROUP BY 1, 2)""",
        "bins AS (SELECT symbol, lo, hi, b::INTEGER AS bin FROM ranges, range(1, 21) t(b))",
    ],
    f"""SELECT symbol, bin, {r('lo + (hi - lo) / 20 * (bin - 1)', 6, 'bin_lo')},
      {r('lo + (hi - lo) / 20 * bin', 6, 'bin_hi')}, coalesce(n, 0) AS n
      FROM bins LEFT JOIN placed USING (symbol, bin)""",
)
ORACLES["variability_normalized"] = with_(
    [WIDE, VARIABILITY],
    f"""SELECT symbol, {r('variability', 6, 'variability')},
      {r('variability / max(variability) OVER ()', 6, 'share_of_max')},
      {r('variability / max(variability) OVER () * 100', 6, 'normalized_variability')} FROM spread""",
)
ORACLES["radar_metrics"] = with_(
    [WIDE, *described(), COMPARISON],
    "SELECT symbol, "
    + ", ".join(
        r(f"CASE WHEN max({m}) OVER () > 0 THEN {m} / max({m}) OVER () ELSE {m} END", 6, m)
        for m in (
            "desvio_padrao",
            "variancia",
            "coef_variacao",
            "amplitude_interquartil",
            "desvio_medio_absoluto",
        )
    )
    + " FROM comparison ORDER BY comparison.coef_variacao DESC NULLS LAST, symbol LIMIT 6",
)
