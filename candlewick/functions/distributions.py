"""Student-t and F tail probabilities as SQL functions.

Spark has no incomplete beta function.  It is built here from SQL expressions, so
the tests run inside the JVM and the functions can be called from SQL as well:
``register(spark)`` adds ``log_gamma(x)``, ``regularized_beta(a, b, x, rest)``,
``student_t_two_sided(t, df)`` and ``f_survival(f, d1, d2)`` to a session.

Arguments are doubles.  A null argument gives null, and so does one outside the
distribution (no degrees of freedom, NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Stirling's series for log(gamma(z)) beyond its leading terms; z is 8 or more.
_SERIES = """
    (1/12D - (1/360D - (1/1260D - (1/1680D - (1/1188D - 691/360360D
        / (z*z)) / (z*z)) / (z*z)) / (z*z)) / (z*z)) / z
"""
_LOG_GAMMA = """
    (x + 7.5D) * ln(x + 8D) - (x + 8D) + 0.5D * ln(2 * pi()) + stirling_rest(x + 8D)
        - aggregate(sequence(0, 7), 0D, (s, i) -> s + ln(x + i))
"""
# log(gamma(p + q) / gamma(p)) with the large terms of both cancelled by hand.
_LOG_GAMMA_RATIO = """
    (p + q + 7.5D) * log1p(q / (p + 8D)) + q * ln(p + 8D) - q
        + stirling_rest(p + q + 8D) - stirling_rest(p + 8D)
        - aggregate(sequence(0, 7), 0D, (s, i) -> s + log1p(q / (p + i)))
"""
# The continued fraction of the incomplete beta, by its convergents.  The state is
# the last two numerators and the last but one denominator, divided by the last
# denominator.  Two steps that change nothing end it; the number of steps that can be
# needed grows with the square root of the larger parameter.
_BETA_TERM = """
    CASE WHEN j % 2 = 0 THEN (j / 2) * (q - j / 2) * z / ((p + j - 1) * (p + j))
         ELSE -(p + (j - 1) / 2) * (p + q + (j - 1) / 2) * z / ((p + j - 1) * (p + j)) END
"""
_BETA_FRACTION = f"""
    aggregate(
        sequence(1, 120 + cast(24 * sqrt(greatest(p, q)) AS int)),
        named_struct('before', 0D, 'last', 1D, 'under', 1D, 'calm', 0),
        (s, j) -> CASE WHEN s.calm >= 2 THEN s ELSE element_at(transform(
            transform(array({_BETA_TERM}), term -> named_struct(
                'top', s.last + term * s.before,
                'bottom', coalesce(nullif(1D + term * s.under, 0D), 1e-300D))),
            f -> named_struct(
                'before', s.last / f.bottom,
                'last', f.top / f.bottom,
                'under', 1D / f.bottom,
                'calm', CASE WHEN abs(f.top / f.bottom - s.last) <= 1e-15D * abs(s.last)
                             THEN s.calm + 1 ELSE 0 END)), 1) END,
        s -> s.last)
"""
# z is the smaller side.  The logarithm of a number near 1 comes from its distance to 1.
_BETA_PART = """
    exp(p * CASE WHEN z > 0.5D THEN log1p(-other) ELSE ln(z) END
        + q * CASE WHEN z > 0.5D THEN ln(other) ELSE log1p(-z) END
        - log_gamma(least(p, q)) + log_gamma_ratio(greatest(p, q), least(p, q)))
        * beta_fraction(p, q, z) / p
"""
_REGULARIZED_BETA = """
    CASE WHEN a IS NULL OR b IS NULL OR NOT (a > 0 AND b > 0) OR greatest(a, b) >= double('infinity')
              OR x IS NULL OR isnan(x) THEN NULL
         WHEN x <= 0 THEN 0D
         WHEN x >= 1 THEN 1D
         WHEN x < (a + 1) / (a + b + 2) THEN least(beta_part(a, b, x, rest), 1D)
         ELSE greatest(1D - beta_part(b, a, rest, x), 0D) END
"""
# erfc(x) for x >= 0: the series of positive terms below 3, the continued fraction above.
_ERFC = """
    CASE WHEN x < 3 THEN 1D - 2 / sqrt(pi()) * exp(-x*x) * aggregate(
             sequence(1, 80), named_struct('term', x, 'sum', x),
             (s, k) -> named_struct(
                 'term', s.term * 2 * x * x / (2 * k + 1),
                 'sum', s.sum + s.term * 2 * x * x / (2 * k + 1)),
             s -> s.sum)
         ELSE exp(-x*x) / sqrt(pi()) / aggregate(
             sequence(80, 1, -1), x, (s, k) -> x + k / 2 / s) END
"""
# Beyond 1e8 degrees of freedom the normal limit is right to more digits than the series.
_STUDENT_T = """
    CASE WHEN t IS NULL OR isnan(t) OR df IS NULL OR NOT df > 0 THEN NULL
         WHEN abs(t) >= 1e150D THEN 0D
         WHEN df > 1e8D THEN normal_tails(abs(t) / sqrt(2D))
         ELSE regularized_beta(df / 2, 0.5D, df / (df + t*t), t*t / (df + t*t)) END
"""
_F_SURVIVAL = """
    CASE WHEN f IS NULL OR isnan(f) OR d1 IS NULL OR d2 IS NULL OR NOT (d1 > 0 AND d2 > 0) THEN NULL
         WHEN f >= 1e300D THEN 0D
         ELSE regularized_beta(d2 / 2, d1 / 2, d2 / (d2 + d1*f), d1*f / (d2 + d1*f)) END
"""
# In the order of their calls.
_FUNCTIONS = {
    "stirling_rest(z DOUBLE)": _SERIES,
    "log_gamma(x DOUBLE)": _LOG_GAMMA,
    "log_gamma_ratio(p DOUBLE, q DOUBLE)": _LOG_GAMMA_RATIO,
    "beta_fraction(p DOUBLE, q DOUBLE, z DOUBLE)": _BETA_FRACTION,
    "beta_part(p DOUBLE, q DOUBLE, z DOUBLE, other DOUBLE)": _BETA_PART,
    "regularized_beta(a DOUBLE, b DOUBLE, x DOUBLE, rest DOUBLE)": _REGULARIZED_BETA,
    "normal_tails(x DOUBLE)": _ERFC,
    "student_t_two_sided(t DOUBLE, df DOUBLE)": _STUDENT_T,
    "f_survival(f DOUBLE, d1 DOUBLE, d2 DOUBLE)": _F_SURVIVAL,
}


def register(spark: SparkSession) -> None:
    """Add the functions to the session, for SQL and for the Columns below."""
    if spark.catalog.functionExists("f_survival"):
        return
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")


def student_t_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|); 0 for infinite t.  The session must know the functions."""
    return F.call_function("student_t_two_sided", t, df)


def f_survival(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(F >= f); 0 for infinite f.  The session must know the functions."""
    return F.call_function("f_survival", f, d1, d2)
