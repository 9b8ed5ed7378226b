"""One-sided t-tests, one-way ANOVA and pairwise t-tests on strategy returns.

Every test needs only (n, mean, variance) per (symbol, strategy).
``combo_statistics`` is the one pass over the facts, with map-side combine; the
tests take its small result, which a caller of several tests can store first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.config import EXPECTED_RETURN, SIGNIFICANCE
from candlewick.functions.distributions import f_survival, register, student_t_two_sided
from candlewick.operators.ordering import median_of, numbered

COMBO = ("symbol", "strategy")

# Texts of the reports.
REJECT = "Rejeitar H0 - O retorno médio é significativamente menor que o esperado"
KEEP = "Não rejeitar H0 - O retorno médio é maior ou igual ao esperado"
DIFFERENT = "Há diferença significativa entre as combinações de criptomoedas e estratégias"
SAME = "Não há diferença significativa entre as combinações de criptomoedas e estratégias"
TOO_FEW_GROUPS = "Necessário pelo menos 2 grupos com dados suficientes para ANOVA"
TOO_FEW_COMBOS = (
    "Necessário pelo menos 2 combinações criptomoeda-estratégia com dados suficientes"
)
# Criterion -> (metric, name above the median, name otherwise).
SPLITS = {
    "volatility": ("volatility", "Alta Volatilidade", "Baixa Volatilidade"),
    "mean_return": ("mean_return", "Alto Retorno", "Baixo Retorno"),
    "investment_frequency": (
        "investment_frequency",
        "Alta Frequência de Investimento",
        "Baixa Frequência de Investimento",
    ),
}

_INFINITY = float("inf")
# Pairwise tests: groups per block, and pairs of blocks per task.
_BLOCK, _BLOCKS_PER_TASK = 256, 4


def invested(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("investment_made") == "Yes")


def invested_counts(daily: DataFrame) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("investment_made") == "Yes").alias("invested_rows"),
    )


def combo_label() -> Column:
    return F.concat_ws(" - ", *COMBO)


def combo_statistics(returns: DataFrame) -> DataFrame:
    """(symbol, strategy, n, mean, variance); the only pass over the facts."""
    keyed = returns.where(F.col("symbol").isNotNull() & F.col("strategy").isNotNull())
    r = F.col("return_pct")
    return keyed.groupBy(*COMBO).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.var_samp(r).alias("variance")
    )


def combo_metrics(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("n") > 1).select(
        *COMBO,
        F.col("mean").alias("mean_return"),
        F.sqrt("variance").alias("volatility"),
        F.col("n").alias("investment_frequency"),
    )


def _t_value(gap: Column, error: Column) -> Column:
    """gap / error with the limits a zero error leads to."""
    return (
        F.when(error > 0, F.try_divide(gap, error))
        .when((error == 0) & (gap > 0), F.lit(_INFINITY))
        .when((error == 0) & (gap < 0), F.lit(-_INFINITY))
    )


def ttest_one_sample(
    stats: DataFrame,
    expected_return: float = EXPECTED_RETURN,
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    """Left-tailed test of the mean return against ``expected_return`` percent."""
    register(stats.sparkSession)
    gap = F.col("mean") - F.lit(expected_return / 100)
    error = F.sqrt(F.try_divide(F.col("variance"), F.col("n")))
    tested = stats.withColumn("t_stat", _t_value(gap, error))
    both = student_t_two_sided("t_stat", (F.col("n") - 1).cast("double"))
    tested = tested.withColumn("__both", both)
    low = F.col("t_stat") < 0
    tested = tested.withColumn(
        "p_value", F.when(low, F.col("__both") / 2).otherwise(1 - F.col("__both") / 2)
    )
    rejected = low & (F.col("p_value") < significance)
    return tested.select(
        *COMBO,
        F.lit(float(expected_return)).alias("expected_mean_pct"),
        (F.col("mean") * 100).alias("achieved_mean_pct"),
        "n",
        "t_stat",
        "p_value",
        F.coalesce(rejected, F.lit(False)).alias("rejected"),
        F.when(rejected, REJECT).otherwise(KEEP).alias("conclusion"),
    )


# -- ANOVA -----------------------------------------------------------------------
def _f_test(groups: DataFrame, significance: float) -> DataFrame:
    """One row from groups (n, mean, variance, combos) with n > 1."""
    register(groups.sparkSession)
    n, mean = F.col("n"), F.col("mean")
    sums = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("total"),
        F.sum(n * mean).alias("__s1"),
        F.sum(n * mean * mean).alias("__s2"),
        F.sum((n - 1) * F.col("variance")).alias("__within"),
        # Whether all group means are the same number: then nothing is between.
        (F.max("mean") == F.min("mean")).alias("__flat"),
        F.coalesce(F.sum("combos"), F.lit(0)).alias("combos"),
    )
    between = F.greatest(
        F.col("__s2") - F.col("__s1") * F.col("__s1") / F.col("total"), F.lit(0.0)
    )
    sums = sums.withColumn("__between", F.when(F.col("__flat"), 0.0).otherwise(between))
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    ms_between, ms_within = F.try_divide("__between", d1), F.try_divide("__within", d2)
    f = F.when(ms_within > 0, F.try_divide(ms_between, ms_within)).when(
        (ms_within == 0) & (ms_between > 0), F.lit(_INFINITY)
    )
    enough = F.col("k") >= 2
    out = sums.withColumn("f_statistic", F.when(enough, f)).withColumns(
        {"d1": d1.cast("double"), "d2": d2.cast("double")}
    )
    out = out.withColumn("p_value", f_survival("f_statistic", "d1", "d2"))
    return out.select(
        F.col("k").alias("groups"),
        F.col("total").alias("observations"),
        "f_statistic",
        "p_value",
        F.coalesce(F.col("p_value") < significance, F.lit(False)).alias("is_significant"),
        F.when(~enough, F.lit(TOO_FEW_GROUPS)).alias("error"),
        "combos",
    )


def _concluded(anova: DataFrame, different: Column, same: Column) -> DataFrame:
    verdict = F.when(F.col("is_significant"), different).otherwise(same)
    return anova.withColumn("conclusion", F.when(F.col("error").isNull(), verdict))


def anova_individual(stats: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """One-way ANOVA over all (symbol, strategy) groups with at least two
    returns.  With fewer than two groups the row carries ``error`` instead."""
    groups = stats.where(F.col("n") > 1).withColumn("combos", F.lit(1))
    tested = _f_test(groups, significance).drop("combos")
    return _concluded(tested, F.lit(DIFFERENT), F.lit(SAME))


def median_split(stats: DataFrame, criterion: str = "volatility") -> DataFrame:
    """Each combination's statistics and group: strictly above the median of the
    metric is the high group, ties go low."""
    metric, high, low = SPLITS.get(criterion, SPLITS["investment_frequency"])
    value = {
        "volatility": F.sqrt("variance"),
        "mean_return": F.col("mean"),
        "investment_frequency": F.col("n").cast("double"),
    }[metric]
    kept = stats.where(F.col("n") > 1).withColumn("metric", value)
    return kept.withColumn("median", median_of(kept, "metric")).withColumn(
        "group_name", F.when(F.col("metric") > F.col("median"), high).otherwise(low)
    )


def group_statistics(split: DataFrame) -> DataFrame:
    """Merge member statistics into (group_name, n, mean, variance, first)."""
    # Distances to one central value keep the squares small.
    centre = split.agg(F.avg("mean")).scalar()
    split = split.withColumn("__d", F.col("mean") - centre).withColumn("__centre", centre)
    n, mean = F.col("n"), F.col("__d")
    merged = split.groupBy("group_name").agg(
        F.first("__centre").alias("__centre"),
        F.sum("n").alias("n"),
        F.sum(n * mean).alias("__s1"),
        F.sum(n * mean * mean).alias("__s2"),
        F.sum((n - 1) * F.col("variance")).alias("__within"),
        # Groups are listed in the order of their first member.
        F.min(F.struct(*COMBO)).alias("first"),
        F.count(F.lit(1)).alias("combos"),
    )
    average = F.col("__s1") / F.col("n")
    squares = F.col("__within") + F.greatest(
        F.col("__s2") - F.col("__s1") * average, F.lit(0.0)
    )
    return merged.select(
        "group_name",
        "n",
        (F.col("__centre") + average).alias("mean"),
        F.try_divide(squares, F.col("n") - 1).alias("variance"),
        "first",
        "combos",
    )


def anova_grouped(
    stats: DataFrame, criterion: str = "volatility", significance: float = SIGNIFICANCE
) -> DataFrame:
    groups = group_statistics(median_split(stats, criterion)).where(F.col("n") > 1)
    tested = _f_test(groups, significance)
    few = F.col("combos") < 2
    tested = tested.withColumn(
        "error", F.when(few, F.lit(TOO_FEW_COMBOS)).otherwise(F.col("error"))
    ).drop("combos")
    return _concluded(
        tested,
        F.lit(f"Há diferença significativa entre os grupos ({criterion})"),
        F.lit(f"Não há diferença significativa entre os grupos ({criterion})"),
    ).select(F.lit(criterion).alias("criterion"), "*")


def group_members(stats: DataFrame, criterion: str = "volatility") -> DataFrame:
    """Group -> sorted member labels."""
    members = F.transform(
        F.array_sort(F.collect_list(F.struct(*COMBO))),
        lambda m: F.concat_ws(" - ", m["symbol"], m["strategy"]),
    )
    split = median_split(stats, criterion)
    return split.groupBy("group_name").agg(members.alias("members"))


def grouped_rows(returns: DataFrame, stats: DataFrame, criterion: str = "volatility") -> DataFrame:
    """The individual returns with their group.  A combination may hold most of
    the rows: the join is left to adaptive execution, which broadcasts the
    combination table if it is small and otherwise splits skewed partitions."""
    labels = median_split(stats, criterion).select(*COMBO, "group_name")
    facts = returns.select(*COMBO, "return_pct").where(F.col("return_pct").isNotNull())
    return facts.join(labels, list(COMBO))


# -- post hoc ----------------------------------------------------------------------
def pairwise_ttest(
    groups: DataFrame,
    label: Column,
    order: list[str],
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    """Independent two-sample t-test (pooled variance, two-sided) for every
    unordered pair of groups, earlier group first.

    The pairs are the result, so their number is what was asked for.  Groups lie
    in blocks by their number, and each block meets itself and every later one
    under a key of their own: a group is sent once per block, not once per pair,
    and no task holds more than a few blocks' pairs.
    """
    register(groups.sparkSession)
    placed = numbered(groups.withColumn("label", label), order, "ord").select(
        F.col("ord").cast("int").alias("ord"), "label", "n", "mean", "variance"
    )
    last = (placed.count() - 1) // _BLOCK
    tasks = max(1, (last + 1) * (last + 2) // 2 // _BLOCKS_PER_TASK)
    block = F.expr(f"(ord - 1) div {_BLOCK}").cast("int")

    def side(i: int, own: str, others: str, start: Column, end: Column) -> DataFrame:
        columns = [F.col(c).alias(f"{c}{i}") for c in ("ord", "label", "n", "mean", "variance")]
        dealt = placed.select(block.alias(own), F.explode(F.sequence(start, end)).alias(others), *columns)
        return dealt.repartition(tasks, "block1", "block2")

    left = side(1, "block1", "block2", block, F.lit(int(last)))
    right = side(2, "block2", "block1", F.lit(0), block)
    pairs = left.join(right, ["block1", "block2"]).where(F.col("ord1") < F.col("ord2"))
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("variance1") + (F.col("n2") - 1) * F.col("variance2")) / df
    error = F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    gap = F.col("mean1") - F.col("mean2")
    tested = pairs.select(
        "ord1",
        "ord2",
        F.col("label1").alias("group1"),
        F.col("label2").alias("group2"),
        gap.alias("mean_diff"),
        _t_value(gap, error).alias("t_statistic"),
        df.cast("double").alias("df"),
    )
    return tested.withColumn("p_value", student_t_two_sided("t_statistic", "df")).withColumn(
        "significant", F.coalesce(F.col("p_value") < significance, F.lit(False))
    )


def posthoc_individual(stats: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    groups = stats.where(F.col("n") > 1)
    return pairwise_ttest(groups, combo_label(), list(COMBO), significance)


def posthoc_grouped(
    stats: DataFrame, criterion: str = "volatility", significance: float = SIGNIFICANCE
) -> DataFrame:
    groups = group_statistics(median_split(stats, criterion)).where(F.col("n") > 1)
    return pairwise_ttest(groups, F.col("group_name"), ["first"], significance)
