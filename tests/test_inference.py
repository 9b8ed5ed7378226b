import itertools
import math

import numpy as np
import pytest

from candlewick.functions.distributions import f_survival, register, student_t_two_sided
from candlewick.operators import inference, reports
from candlewick.operators.ordering import median_of, numbered
from candlewick.plans.workflows import analyse_returns
from tails import f_upper, regularized_beta, t_two_sided

SCHEMA = "symbol string, strategy string, return_pct double, investment_made string"


def table(spark, groups):
    rows = [(s, t, None if v is None else float(v), "Yes") for (s, t), vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, SCHEMA)


def stats_of(spark, groups):
    return inference.combo_statistics(table(spark, groups))


def random_groups(k=6, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    return {
        (f"S{i // 2}", "A" if i % 2 else "B"): rng.normal(shift * i, 1 + i / 10, 8 + i)
        for i in range(k)
    }


@pytest.mark.parametrize(
    "t, df, left",
    [(0.1158, 8, 0.5447), (-1.4899, 8, 0.0873), (8.8827, 2, 0.9938), (-4.0257, 6, 0.0035)],
)
def test_known_left_tails(t, df, left):
    p = float(t_two_sided(np.array([t]), np.array([df]))[0])
    assert round(p / 2 if t < 0 else 1 - p / 2, 4) == left


def test_tail_identities():
    # F with one numerator degree is t squared; df 1 and 2 have closed forms.
    t, df = np.array([0.3, 1.7, 6.0]), np.array([5.0, 40.0, 1e6])
    assert f_upper(t * t, np.ones(3), df) == pytest.approx(t_two_sided(t, df), rel=1e-10)
    assert t_two_sided([2.0], [1.0])[0] == pytest.approx(1 - 2 / math.pi * math.atan(2.0))
    assert t_two_sided([2.0], [2.0])[0] == pytest.approx(1 - 2 / math.sqrt(6.0))
    assert regularized_beta([2.0], [3.0], [0.4])[0] == pytest.approx(0.5248)
    assert t_two_sided([np.inf, np.nan], [3.0, 3.0])[0] == 0.0


def test_one_sample_edges(spark):
    groups = {
        ("A", "one"): [0.1],
        ("A", "null"): [None],
        ("A", "low"): [0.0, 0.0],
        ("A", "high"): [1.0, 1.0],
        ("A", "equal"): [0.015, 0.015],
        ("A", "spread"): [-0.5, -0.4, -0.6],
    }
    got = {r["strategy"]: r for r in inference.ttest_one_sample(stats_of(spark, groups), 1.5).collect()}
    assert got["one"]["t_stat"] is None and not got["one"]["rejected"]
    assert got["null"]["conclusion"] == inference.KEEP
    assert got["low"]["t_stat"] == -math.inf and got["low"]["p_value"] == 0.0 and got["low"]["rejected"]
    assert got["high"]["t_stat"] == math.inf and got["high"]["p_value"] == 1.0
    assert got["equal"]["t_stat"] is None
    assert got["spread"]["rejected"] and got["spread"]["conclusion"] == inference.REJECT


def test_anova_from_moments_equals_sums_of_squares(spark):
    groups = random_groups()
    values = list(groups.values())
    pooled = np.concatenate(values)
    between = sum(len(v) * (v.mean() - pooled.mean()) ** 2 for v in values)
    within = sum(((v - v.mean()) ** 2).sum() for v in values)
    f = (between / (len(values) - 1)) / (within / (len(pooled) - len(values)))
    row = inference.anova_individual(stats_of(spark, groups)).first()
    assert row["f_statistic"] == pytest.approx(f)
    assert row["p_value"] == pytest.approx(
        float(f_upper([f], [len(values) - 1], [len(pooled) - len(values)])[0])
    )


def test_too_few_groups_give_an_error_row(spark):
    row = inference.anova_individual(stats_of(spark, {("A", "x"): [1, 2], ("B", "x"): [1]})).first()
    assert row["error"] == inference.TOO_FEW_GROUPS and row["f_statistic"] is None
    one = stats_of(spark, {("A", "x"): [1, 2]})
    assert inference.anova_grouped(one).first()["error"] == inference.TOO_FEW_COMBOS
    # Equal metrics put all combinations in the low group.
    flat = stats_of(spark, {("A", "x"): [1, 2], ("B", "x"): [3, 4]})
    assert inference.anova_grouped(flat).first()["error"] == inference.TOO_FEW_GROUPS


@pytest.mark.parametrize("criterion", inference.SPLITS)
def test_grouped_anova_is_squared_t(spark, criterion):
    stats = stats_of(spark, random_groups(7))
    split = inference.median_split(stats, criterion).collect()
    high = inference.SPLITS[criterion][1]
    assert sum(r["group_name"] == high for r in split) == 3  # the median itself goes low
    anova = inference.anova_grouped(stats, criterion).first()
    pair = inference.posthoc_grouped(stats, criterion).first()
    assert anova["f_statistic"] == pytest.approx(pair["t_statistic"] ** 2)
    assert anova["p_value"] == pytest.approx(pair["p_value"])


def test_merged_groups_equal_pooled_returns(spark):
    groups = random_groups(5)
    stats = stats_of(spark, groups)
    members = {r["group_name"]: r["members"] for r in inference.group_members(stats).collect()}
    by_label = {f"{s} - {t}": v for (s, t), v in groups.items()}
    for g in inference.group_statistics(inference.median_split(stats)).collect():
        pooled = np.concatenate([by_label[m] for m in members[g["group_name"]]])
        assert (g["n"], g["mean"]) == (len(pooled), pytest.approx(pooled.mean()))
        assert g["variance"] == pytest.approx(pooled.var(ddof=1))


def test_pairs_are_complete_and_ordered(spark):
    groups = random_groups(5)
    got = inference.posthoc_individual(stats_of(spark, groups)).collect()
    labels = sorted(groups)
    want = [(f"{a[0]} - {a[1]}", f"{b[0]} - {b[1]}") for a, b in itertools.combinations(labels, 2)]
    assert [(r["group1"], r["group2"]) for r in sorted(got, key=lambda r: (r["ord1"], r["ord2"]))] == want
    a, b = groups[labels[0]], groups[labels[1]]
    sp = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(sp * (1 / len(a) + 1 / len(b)))
    first = next(r for r in got if (r["ord1"], r["ord2"]) == (1, 2))
    assert first["t_statistic"] == pytest.approx(t)


def test_reports_follow_significance(spark):
    quiet = analyse_returns(table(spark, random_groups(4)), criteria=["volatility"])
    assert quiet["posthoc"].count() == 0
    text = "\n".join(r["line"] for r in quiet["anova_report"].orderBy("section", "item", "part").collect())
    assert "NÃO REJEITAR H0" in text and "vs" not in text
    loud = analyse_returns(table(spark, random_groups(4, shift=5.0)), criteria=["mean_return"])
    assert loud["posthoc"].count() == 6
    lines = loud["posthoc_report_mean_return"].orderBy("section", "item", "part").collect()
    text = "\n".join(r["line"] for r in lines)
    assert "Total de comparações realizadas: 1" in text
    assert "tem retorno médio MENOR que" in text
    assert lines[-2]["line"] == reports.DONE


def test_sql_tails_equal_the_numerical_ones(spark):
    register(spark)
    rng = np.random.default_rng(4)
    t = rng.normal(0, 1, 800) * 10 ** rng.uniform(-3, 1.2, 800)
    df = np.floor(10 ** rng.uniform(0, 9.5, 800))
    d1, d2 = np.floor(10 ** rng.uniform(0, 5, 800)), np.floor(10 ** rng.uniform(0, 7, 800))
    f = np.exp(rng.normal(0, 1, 800) * rng.choice([0.01, 0.3, 2], 800))
    rows = [tuple(map(float, r)) for r in zip(t, df, f, d1, d2)]
    table = spark.createDataFrame(rows, "t double, df double, f double, d1 double, d2 double")
    got = table.select(student_t_two_sided("t", "df"), f_survival("f", "d1", "d2")).collect()
    assert [r[0] for r in got] == pytest.approx(t_two_sided(t, df), rel=1e-7, abs=1e-9)
    assert [r[1] for r in got] == pytest.approx(f_upper(f, d1, d2), rel=1e-7, abs=1e-9)


def test_sql_tails_at_their_ends(spark):
    register(spark)
    row = spark.sql("""
        SELECT student_t_two_sided(double('-infinity'), 3D) AS a, student_t_two_sided(0D, 3D) AS b,
            f_survival(double('infinity'), 2D, 3D) AS c, f_survival(0D, 2D, 3D) AS d,
            student_t_two_sided(double('nan'), 3D) AS e, student_t_two_sided(1D, 0D) AS f,
            student_t_two_sided(null, 3D) AS g, student_t_two_sided(1D, null) AS h,
            f_survival(null, 2D, 3D) AS i, f_survival(1D, 0D, 3D) AS j, f_survival(1D, 2D, null) AS k
    """).first()
    assert tuple(row)[:4] == (0.0, 1.0, 0.0, 1.0)
    assert tuple(row)[4:] == (None,) * 7


def test_no_python_in_the_plans(spark):
    stats = stats_of(spark, random_groups(5))
    for tested in (
        inference.ttest_one_sample(stats),
        inference.anova_individual(stats),
        inference.anova_grouped(stats),
        inference.posthoc_individual(stats),
    ):
        plan = tested._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(inference, "_BLOCK", 4)
    monkeypatch.setattr(inference, "_BLOCKS_PER_TASK", 2)
    groups = {(f"S{i:02}", "A"): [float(i), i + 1.0] for i in range(21)}
    got = inference.posthoc_individual(stats_of(spark, groups)).collect()
    assert sorted((r["ord1"], r["ord2"]) for r in got) == list(itertools.combinations(range(1, 22), 2))
    assert all(r["mean_diff"] == pytest.approx(r["ord1"] - r["ord2"]) for r in got)
    assert inference.posthoc_individual(stats_of(spark, {("A", "x"): [1]})).count() == 0


def test_numbers_and_medians_alike_in_many_partitions(spark):
    values = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5, 9, 2, 6)], "v double")
    small = numbered(values, ["v"], "at").collect()
    median = values.select(median_of(values, "v")).first()[0]
    spark.conf.set("spark.candlewick.sliceRows", "3")
    try:
        large = numbered(values, ["v"], "at").collect()
        assert values.select(median_of(values, "v")).first()[0] == median == 3.5
    finally:
        spark.conf.unset("spark.candlewick.sliceRows")
    assert sorted((r["at"], r["v"]) for r in small) == sorted((r["at"], r["v"]) for r in large)
