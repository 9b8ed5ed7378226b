"""Result sinks.  Every write is one distributed job over all symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from candlewick.operators.reports import fixed_decimals


def write_combined(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The combined price table; replaces what is there."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_fixed_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    """CSV with every double printed with ``digits`` decimals."""
    fixed_decimals(df, digits).write.mode("overwrite").csv(path, header=True)


def write_results(
    df: DataFrame, path: str, partition: Sequence[str] = ("symbol",), append: bool = False
) -> None:
    """Backtest results by symbol.  A rerun replaces the symbols it computed and
    leaves the others alone; ``append`` adds to them instead, at every call
    (``append_run`` is the append that can be repeated)."""
    # Bring each symbol's rows together so that a symbol gives few files; a
    # large symbol is still written by several tasks.
    writer = df.hint("rebalance", *partition).write.partitionBy(*partition)
    if append:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


RUN = "run"


def append_run(
    df: DataFrame, path: str, run: str, partition: Sequence[str] = ("symbol",)
) -> None:
    """Add the results of one run, named by ``run``, to those of earlier runs.

    Each run has a folder of its own.  A job that is killed and repeated under the
    same name replaces what it wrote before, so that each row is there once; other
    runs, and symbols only an earlier try of the run computed, stay.  An empty
    ``run`` raises, since a partition can't hold it; null keys are kept as nulls.
    """
    if not run:
        raise ValueError("a run needs a name")
    named = df.withColumn(RUN, F.lit(run))
    named.hint("rebalance", *partition).write.partitionBy(RUN, *partition).mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str, partition: Sequence[str] = ("symbol",)) -> DataFrame:
    """All runs that ``append_run`` wrote; run and partition columns are text as
    written (a symbol 007 is not a number)."""
    written = spark.read.parquet(path).schema
    text = {RUN, *partition}
    schema = StructType(
        [StructField(f.name, StringType()) if f.name in text else f for f in written]
    )
    return spark.read.schema(schema).parquet(path)


def latest_runs(
    spark: SparkSession, path: str, partition: Sequence[str] = ("symbol",)
) -> DataFrame:
    """For each symbol the rows of its last run, the one whose name sorts last
    (names that start with a timestamp sort by time).

    Which run that is comes from the partition columns alone, and only its files
    are read: the join prunes partitions.
    """
    rows = read_runs(spark, path, partition)
    last = rows.groupBy(*partition).agg(F.max(RUN).alias("__last"))
    last = last.select(*[F.col(c).alias(f"__{c}") for c in partition], F.col("__last"))
    same = F.col(RUN) == F.col("__last")
    for c in partition:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(last, same, "left_semi")


def write_report(lines: DataFrame, path: str) -> None:
    """Text report in reading order; the files sort by name into that order."""
    ordered = lines.orderBy("section", "item", "part")
    ordered.select("line").write.mode("overwrite").text(path)
