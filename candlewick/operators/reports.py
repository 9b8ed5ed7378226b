"""Report tables: fixed-decimal exports and numbered text lines.

A text report is a table (section, item, part, line) whose first three columns
sort it into reading order, so the pair blocks need no numbering window.
All reports take the small table of ``inference.combo_statistics``; test results
that several parts of a report print are stored once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.config import EXPECTED_RETURN, SIGNIFICANCE
from candlewick.functions.rounding import fixed
from candlewick.operators import inference
from candlewick.storage import settle

# Texts and rules of the printed reports.
DOUBLE, SINGLE, DASHES, HALF_DASHES = "=" * 80, "-" * 40, "-" * 60, "-" * 50
POST_HOC_METHOD = "Pairwise t-test"
DONE = "Análise concluída com sucesso"


def fixed_decimals(table: DataFrame, digits: int = 2) -> DataFrame:
    """Every double column as text with ``digits`` decimals."""
    doubles = {n for n, t in table.dtypes if t == "double"}
    return table.select(*[fixed(c, digits).alias(c) if c in doubles else c for c in table.columns])


def ttest_report(
    stats: DataFrame,
    expected_return: float = EXPECTED_RETURN,
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    t = inference.ttest_one_sample(stats, expected_return, significance)
    return t.select(
        F.col("symbol").alias("Cryptocurrency"),
        F.col("strategy").alias("Strategy"),
        fixed("expected_mean_pct", 4).alias("Expected Mean (%)"),
        fixed("achieved_mean_pct", 4).alias("Achieved Mean (%)"),
        fixed("t_stat", 4).alias("t-statistic"),
        fixed("p_value", 4).alias("p-value"),
        F.col("conclusion").alias("Conclusion"),
    )


def _gated(pairs: DataFrame, anova: DataFrame) -> DataFrame:
    """Pairs only if the ANOVA was significant (one-row scalar condition)."""
    return pairs.where(anova.select("is_significant").scalar())


def posthoc_report(stats: DataFrame, significance: float = SIGNIFICANCE) -> DataFrame:
    """The pair table; empty unless the ANOVA was significant."""
    pairs = _gated(
        inference.posthoc_individual(stats, significance),
        inference.anova_individual(stats, significance),
    )
    return pairs.select(
        F.col("group1").alias("Cryptocurrency_1"),
        F.col("group2").alias("Cryptocurrency_2"),
        fixed("mean_diff", 4).alias("Mean_Difference"),
        fixed("t_statistic", 4).alias("T_Statistic"),
        fixed("p_value", 4).alias("P_Value"),
        F.when(F.col("significant"), "Yes").otherwise("No").alias("Significant"),
        F.lit(POST_HOC_METHOD).alias("Test_Method"),
    )


# -- text lines ------------------------------------------------------------------
def _lines(table: DataFrame, section: int, item: Column, lines: Iterable[Column]) -> DataFrame:
    """Explode text columns of each row into report lines; null lines are left out."""
    listed = F.array_compact(F.array(*lines))
    return table.select(item.cast("long").alias("item"), F.posexplode(listed)).select(
        F.lit(section).alias("section"),
        "item",
        F.col("pos").alias("part"),
        F.col("col").alias("line"),
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "Sim").otherwise("Não")


def _assemble(parts: list[DataFrame]) -> DataFrame:
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def _test_lines(flag: Column) -> list[Column]:
    return [
        F.lit("RESULTADOS DA ANOVA:"),
        F.lit(SINGLE),
        _text("Estatística F: ", fixed("f_statistic", 4)),
        _text("Valor p: ", fixed("p_value", 4)),
        _text("Significativo: ", _yes_no(flag)),
        _text("Conclusão: ", F.col("conclusion")),
        F.lit(""),
    ]


# Sorts pairs by first, then second group: one number in each half of a long.
def _pair_item() -> Column:
    return F.col("ord1").cast("long") * (1 << 31) + F.col("ord2")


def _pair_lines(pairs: DataFrame, section: int) -> DataFrame:
    return _lines(
        pairs,
        section,
        _pair_item(),
        [
            _text(F.col("group1"), " vs ", F.col("group2"), ":"),
            _text("  Diferença de Média: ", fixed("mean_diff", 4)),
            _text("  Estatística t: ", fixed("t_statistic", 4)),
            _text("  Valor p: ", fixed("p_value", 4)),
            _text("  Significativo: ", _yes_no(F.col("significant"))),
            F.lit(""),
        ],
    )


def _footer(one: DataFrame, section: int, gap: bool = False) -> DataFrame:
    lines = [F.lit(DOUBLE), F.lit(DONE), F.lit(DOUBLE)]
    return _lines(one, section, F.lit(0), [F.lit(""), *lines] if gap else lines)


def anova_individual_report(
    stats: DataFrame, significance: float = SIGNIFICANCE
) -> DataFrame:
    anova = settle(inference.anova_individual(stats, significance))
    flag = F.col("is_significant")
    groups = stats.where(F.col("n") > 1)
    numbered = groups.select(
        F.row_number().over(W.orderBy(*inference.COMBO)).alias("i"),
        inference.combo_label().alias("label"),
    )
    pairs = _gated(inference.posthoc_individual(stats, significance), anova)

    def when(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    head = [
        DOUBLE,
        "ANÁLISE ANOVA - CRIPTOMOEDAS INDIVIDUAIS",
        DOUBLE,
        "",
        "Tipo de Análise: ANOVA",
        "Descrição do Teste: Comparação de retornos médios diários entre criptomoedas individuais",
        "",
        "CRIPTOMOEDAS ANALISADAS:",
        SINGLE,
    ]
    reading = [
        F.lit("INTERPRETAÇÃO:"),
        F.lit(SINGLE),
        F.lit("H0 (Hipótese Nula): Os retornos médios são iguais entre todas as criptomoedas"),
        F.lit(
            "H1 (Hipótese Alternativa): Pelo menos uma criptomoeda tem retorno médio diferente"
        ),
        when(
            flag, "Resultado: REJEITAR H0 - Há diferenças significativas entre as criptomoedas"
        ),
        when(
            ~flag,
            "Resultado: NÃO REJEITAR H0 - Não há diferenças significativas entre as criptomoedas",
        ),
        when(~flag, "Análise Post Hoc: Não aplicável (ANOVA não significativa)"),
        F.lit(""),
        when(flag, "ANÁLISE POST HOC (Teste t pareado):"),
        when(flag, SINGLE),
        when(flag, "Para identificar quais criptomoedas diferem entre si:"),
        when(flag, ""),
    ]
    return _assemble(
        [
            _lines(anova, 1, F.lit(0), map(F.lit, head)),
            _lines(numbered, 2, F.col("i"), [_text(F.col("i").cast("string"), ". ", F.col("label"))]),
            _lines(anova, 3, F.lit(0), [F.lit(""), *_test_lines(flag), *reading]),
            _pair_lines(pairs, 4),
            _footer(anova, 5),
        ]
    )


def _group_lines(stats: DataFrame, criterion: str, section: int) -> DataFrame:
    members = inference.group_members(stats, criterion)
    first = F.element_at("members", 1)
    # Two groups at most.
    numbered = members.withColumn("i", F.row_number().over(W.orderBy(first)))
    text = _text(F.col("group_name"), ": ", F.array_join("members", ", "))
    return _lines(numbered, section, F.col("i"), [text])


def anova_grouped_report(
    stats: DataFrame, criterion: str = "volatility", significance: float = SIGNIFICANCE
) -> DataFrame:
    anova = settle(inference.anova_grouped(stats, criterion, significance))
    flag = F.col("is_significant")
    pairs = _gated(inference.posthoc_grouped(stats, criterion, significance), anova)
    head = [
        DOUBLE,
        "ANÁLISE ANOVA - GRUPOS DE CRIPTOMOEDAS",
        DOUBLE,
        "",
        "Tipo de Análise: ANOVA",
        "Descrição do Teste: Comparação de retornos médios diários entre grupos de criptomoedas",
        f"Critério de Agrupamento: {criterion}",
        "",
        "GRUPOS FORMADOS:",
        SINGLE,
    ]
    closing = [
        F.when(flag, F.lit("ANÁLISE POST HOC (Teste t pareado):")).otherwise(
            F.lit("ANÁLISE POST HOC: Não aplicável (ANOVA não significativa)")
        ),
        F.when(flag, F.lit(SINGLE)).otherwise(F.lit("")),
    ]
    return _assemble(
        [
            _lines(anova, 1, F.lit(0), map(F.lit, head)),
            _group_lines(stats, criterion, 2),
            _lines(anova, 3, F.lit(0), [F.lit(""), *_test_lines(flag), *closing]),
            _pair_lines(pairs, 4),
            _footer(anova, 5),
        ]
    )


def _direction(greater: str, smaller: str) -> Column:
    return F.when(F.col("mean_diff") > 0, greater).otherwise(smaller)


def posthoc_summary(
    stats: DataFrame, criterion: str = "volatility", significance: float = SIGNIFICANCE
) -> DataFrame:
    """Pairs with verdict and direction; empty unless the ANOVA was significant."""
    pairs = _gated(
        inference.posthoc_grouped(stats, criterion, significance),
        inference.anova_grouped(stats, criterion, significance),
    )
    return pairs.select(
        F.lit(criterion).alias("criterion"),
        "group1",
        "group2",
        "mean_diff",
        "t_statistic",
        "p_value",
        "significant",
        F.when(F.col("significant"), _direction("MAIOR", "MENOR")).alias("direction"),
    )


def posthoc_grouped_report(
    stats: DataFrame, criterion: str = "volatility", significance: float = SIGNIFICANCE
) -> DataFrame:
    anova = settle(inference.anova_grouped(stats, criterion, significance))
    flag = F.col("is_significant")
    yes, no = anova.where(flag), anova.where(~flag)
    pairs = settle(_gated(inference.posthoc_grouped(stats, criterion, significance), anova))
    hit = F.col("significant")
    # Two groups give one pair, so its number is 1.
    number = F.row_number().over(W.orderBy("ord1", "ord2"))
    numbered = pairs.withColumn("i", number.cast("string"))
    g1, g2 = F.col("group1"), F.col("group2")
    counts = pairs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits")
    ).where(F.col("total") > 0)
    head = [
        DOUBLE,
        "ANÁLISE POST HOC - GRUPOS DE CRIPTOMOEDAS",
        DOUBLE,
        "",
        f"Critério de Agrupamento: {criterion}",
        "Método do Teste: Teste t pareado",
        "Objetivo: Identificar quais grupos diferem significativamente entre si",
        "",
    ]
    refused = [
        F.lit("RESULTADO:"),
        F.lit(SINGLE),
        F.lit("ANOVA não foi significativa - Teste post hoc não aplicável"),
        _text("Razão: p-valor da ANOVA (", fixed("p_value", 4), ") > 0.05"),
        F.lit(
            "Conclusão: Não há diferenças significativas entre os grupos para justificar "
            "comparações pareadas"
        ),
        F.lit(""),
    ]
    compared = [
        _text("COMPARAÇÃO ", F.col("i"), ": ", g1, " vs ", g2),
        F.lit(DASHES),
        _text("Diferença de Média: ", fixed("mean_diff", 4)),
        _text("Estatística t: ", fixed("t_statistic", 4)),
        _text("Valor p: ", fixed("p_value", 4)),
        _text("Resultado: ", F.when(hit, "SIGNIFICATIVO").otherwise("NÃO SIGNIFICATIVO")),
        F.when(
            hit,
            _text(
                "Interpretação: ", g1, " tem retorno médio ", _direction("MAIOR", "MENOR"), " que ", g2
            ),
        ).otherwise(
            _text("Interpretação: Não há diferença significativa entre ", g1, " e ", g2)
        ),
        F.lit(""),
    ]
    total, hits = F.col("total"), F.col("hits")
    summary = [
        F.lit(DOUBLE),
        F.lit("RESUMO DA ANÁLISE POST HOC:"),
        F.lit(DOUBLE),
        _text("Total de comparações realizadas: ", total.cast("string")),
        _text("Comparações significativas: ", hits.cast("string")),
        _text("Comparações não significativas: ", (total - hits).cast("string")),
        F.lit(""),
        F.when(hits > 0, F.lit("DIFERENÇAS SIGNIFICATIVAS ENCONTRADAS:")).otherwise(
            F.lit("Nenhuma diferença significativa foi encontrada entre os grupos.")
        ),
        F.when(hits > 0, F.lit(HALF_DASHES)),
    ]
    found = _text(
        "• ", g1, " ", _direction(">", "<"), " ", g2, " (p = ", fixed("p_value", 4), ")"
    )
    formed = _group_lines(stats, criterion, 3)
    return _assemble(
        [
            _lines(anova, 1, F.lit(0), map(F.lit, head)),
            _lines(no, 2, F.lit(0), refused),
            _lines(yes, 2, F.lit(0), [F.lit("GRUPOS FORMADOS:"), F.lit(SINGLE)]),
            formed.where(anova.select("is_significant").scalar()),
            _lines(yes, 4, F.lit(0), map(F.lit, ["", "COMPARAÇÕES PAREADAS:", SINGLE])),
            _lines(numbered, 5, _pair_item(), compared),
            _lines(counts, 6, F.lit(0), summary),
            _lines(pairs.where(hit), 7, _pair_item(), [found]),
            _footer(anova, 8, gap=True),
        ]
    )
