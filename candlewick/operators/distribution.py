"""Exact per-group distributions from counts of distinct values.

``percentile`` and ``mode`` keep every distinct value of a group in one
aggregation buffer.  Two other ways are taken here, with equal results:

* Tables that fit one slice, and those of very many groups: values are counted per
  (group, value), which combines map-side and spreads a hot group over all reducers;
  ranks then come from running counts over a ``Layout``.
* Larger tables: ``select_ranks`` narrows each quantile down by histograms of fixed
  size and ``modes`` rules out most values by hashed counts, so that what is shuffled
  depends on the number of groups and not on that of distinct values.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.config import slice_rows
from candlewick.operators.layout import Layout
from candlewick.storage import settle


#: Groups up to which per-group rows, at most some dozen each, go to every task.
BROADCAST_GROUPS = 10_000
#: Buckets of a histogram, and histograms drawn before what is left is counted.
BUCKETS, ROUNDS = 512, 4
#: Hashed counts of all groups together, and those of one group that are recounted
#: apart; a group with more of them is counted as a whole.
HASHED, RECOUNTED = 1 << 22, 16


def _present(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    for k in (*keys, value):
        df = df.where(F.col(k).isNotNull())
    return df.select(*keys, value)


def value_counts(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    present = _present(df, keys, value)
    return present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def _bucket_of(v: Column, low: Column, high: Column) -> Column:
    """A number that never decreases with ``v``; infinities and NaN have their own."""
    greatest = F.lit(sys.float_info.max)
    v = v.cast("double")
    # Halves, because the whole range may be too wide for a double.
    start = F.greatest(low.cast("double"), -greatest) / 2
    width = F.least(high.cast("double"), greatest) / 2 - start
    inside = F.floor(F.try_divide(v / 2 - start, width) * BUCKETS).cast("int")
    return (
        F.when(F.isnan(v), BUCKETS + 2)
        .when(v > greatest, BUCKETS + 1)
        .when(v < -greatest, -1)
        .otherwise(F.coalesce(inside, F.lit(0)))
    )


def select_ranks(
    rows: DataFrame, keys: tuple[str, ...], value: str, ranks: DataFrame, enough: int
) -> DataFrame:
    """The value at each 0-based rank: keys, rank, value.

    ``ranks`` has keys, rank and the group's ``low`` and ``high``; it is broadcast, as
    ``rows`` are never shuffled.  Each round draws a histogram inside the brackets that
    are left, and the bucket with the rank, cut to the values it holds, is the next
    bracket.  Brackets of ``enough`` rows or fewer, and those left after ``ROUNDS``
    (values of very different magnitude), are counted value by value.
    """
    v = F.col(value)
    within = (v >= F.col("low")) & (v <= F.col("high"))
    bracket = [*keys, "low", "high"]
    state = ranks.select(*bracket, "rank", F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("size"))
    state = settle(state)
    is_open = F.col("low") < F.col("high")

    def of_open(state: DataFrame, pending: Column) -> DataFrame:
        brackets = state.where(pending).select(*bracket).distinct()
        return rows.join(F.broadcast(brackets), list(keys)).where(within)

    pending = is_open & (F.col("size").isNull() | (F.col("size") > enough))
    for _ in range(ROUNDS):
        if state.where(pending).isEmpty():
            break
        drawn = (
            of_open(state, pending)
            .groupBy(*bracket, _bucket_of(v, F.col("low"), F.col("high")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("held"), F.min(v).alias("from"), F.max(v).alias("to"))
        )
        so_far = W.partitionBy(*bracket).orderBy("bucket")  # at most BUCKETS + 4 rows
        drawn = drawn.withColumn("upto", F.sum("held").over(so_far))
        inside = (F.col("rank") >= F.col("below") + F.col("upto") - F.col("held")) & (
            F.col("rank") < F.col("below") + F.col("upto")
        )
        closer = state.where(pending).join(drawn, bracket).where(inside)
        closer = closer.select(
            *keys,
            F.col("from").alias("low"),
            F.col("to").alias("high"),
            "rank",
            (F.col("below") + F.col("upto") - F.col("held")).alias("below"),
            F.col("held").alias("size"),
        )
        state = settle(state.where(~pending).unionByName(closer))
    done = state.where(~is_open).select(*keys, "rank", F.col("low").alias(value))
    if (left := state.where(is_open)).isEmpty():
        return done
    counts = settle(
        of_open(state, is_open).groupBy(*bracket, value).agg(F.count(F.lit(1)).alias("cnt"))
    )
    layout = Layout.plan(counts, tuple(bracket), (value,))
    counted = layout.running(counts, {"upto": F.col("cnt")})
    found = left.join(counted.select(*bracket, value, "upto"), bracket)
    found = found.where(F.col("below") + F.col("upto") > F.col("rank"))
    return done.unionByName(found.groupBy(*keys, "rank").agg(F.min(v).alias(value)))


def modes(rows: DataFrame, keys: tuple[str, ...], value: str, groups: int) -> DataFrame:
    """The most frequent value of each group, the smallest of a tie: keys, mode.

    Values are hashed into a fixed number of counts.  The best value of a group's
    largest count sets a bound; a value whose hashed count is below that bound cannot
    be the mode.  The values of the other counts are counted exactly; where those are
    many, as when every value is different, the group is counted as a whole.
    """
    v = F.col(value)
    # Adding zero turns -0.0 into 0.0, which is the same value.
    number = F.pmod(F.xxhash64(v + F.lit(0)), F.lit(max(256, HASHED // max(groups, 1))))
    hashed = rows.withColumn("hashed", number)
    counts = settle(hashed.groupBy(*keys, "hashed").agg(F.count(F.lit(1)).alias("held")))
    largest = counts.groupBy(*keys).agg(
        F.max_by("hashed", F.struct("held", "hashed")).alias("hashed")
    )
    one = hashed.join(F.broadcast(settle(largest)), [*keys, "hashed"], "left_semi")
    bound = value_counts(one, keys, value).groupBy(*keys).agg(F.max("cnt").alias("bound"))
    able = counts.join(settle(bound), list(keys)).where("held >= bound").drop("held", "bound")
    number_of = able.groupBy(*keys).agg(F.count(F.lit(1)).alias("many"))
    narrow = settle(number_of.withColumn("narrow", F.col("many") <= RECOUNTED)).drop("many")
    few = able.join(narrow.where("narrow"), list(keys), "left_semi")
    wide = narrow.where(~F.col("narrow")).select(*keys)
    counted = value_counts(
        hashed.join(F.broadcast(few), [*keys, "hashed"], "left_semi"), keys, value
    )
    if not wide.isEmpty():
        whole = rows.join(F.broadcast(wide), list(keys), "left_semi")
        counted = counted.unionByName(value_counts(whole, keys, value))
    return counted.groupBy(*keys).agg(F.max_by(v, F.struct("cnt", -v)).alias("mode"))


def _interpolated(low: Column, high: Column, part: Column, p: float) -> Column:
    if p == 0.5:
        return (low + high) / 2.0
    # numpy's interpolation, which starts from the nearer neighbour.
    return F.when(part < 0.5, low + (high - low) * part).otherwise(
        high - (high - low) * (1.0 - part)
    )


def _narrowed(
    df: DataFrame, keys: tuple[str, ...], value: str, marks: dict[str, float]
) -> tuple[DataFrame, DataFrame, int] | None:
    """(rows, one row per group with n, total, low, high and ``marks``, number of groups)
    of a table of more than one slice; None for smaller ones and for too many groups."""
    enough = slice_rows(df.sparkSession)
    if df.count() <= enough:
        return None
    rows, v = _present(df, keys, value), F.col(value)
    of_group = settle(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(v).alias("total"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
        )
    )
    if (groups := of_group.count()) > BROADCAST_GROUPS:
        return None
    if marks:
        at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in marks.items()}
        wanted = [f(a) for a in at.values() for f in (F.floor, F.ceil)]
        ranks = of_group.select(
            *keys, "low", "high", F.explode(F.array_distinct(F.array(*wanted))).alias("rank")
        )
        found = select_ranks(rows, keys, value, ranks, enough)
        at_rank = F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("__at")
        of_group = of_group.join(found.groupBy(*keys).agg(at_rank), list(keys))
        low, high = (lambda a: F.element_at("__at", F.floor(a))), (lambda a: F.element_at("__at", F.ceil(a)))
        of_group = settle(
            of_group.withColumns(
                {m: _interpolated(low(a), high(a), a - F.floor(a), marks[m]) for m, a in at.items()}
            ).drop("__at")
        )
    return rows, of_group, groups


def with_quantiles(
    df: DataFrame, keys: tuple[str, ...], value: str, marks: dict[str, float]
) -> DataFrame:
    """Rows of a value and how often it stands there (``cnt``) with, per group, ``n``,
    ``total``, ``low``, ``high`` and the linearly interpolated quantiles in ``marks``.

    A value may have several rows: large tables keep theirs, with ``cnt`` 1.
    """
    if (large := _narrowed(df, keys, value, marks)) is not None:
        rows, of_group, _ = large
        return rows.withColumn("cnt", F.lit(1).cast("long")).join(F.broadcast(of_group), list(keys))
    return _counted(df, keys, value, marks)


def _counted(
    df: DataFrame, keys: tuple[str, ...], value: str, marks: dict[str, float]
) -> DataFrame:
    """One row per distinct value."""
    counts = value_counts(df, keys, value)
    if (rows := df.count()) > slice_rows(df.sparkSession):
        # Planning and the sliced ranks below read the counts several times.
        counts = settle(counts)
    layout = Layout.plan(counts, keys, (value,), upper_bound=lambda: rows)
    v, cnt = F.col(value), F.col("cnt")
    ranked = layout.running(
        counts,
        {"__upto": cnt},
        {
            "n": ("sum", cnt),
            "total": ("sum", v * cnt),
            "low": ("min", v),
            "high": ("max", v),
        },
    )
    if not marks:
        return ranked.drop("__upto")
    picks, finish = {}, {}
    for name, p in marks.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # The value at 0-based rank r is the least one with more than r rows up to it.
            picks[f"__{name}_{side}"] = ("min", F.when(F.col("__upto") > rank, v))
        finish[name] = _interpolated(
            F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), at - F.floor(at), p
        )
    ranked = layout.totals(ranked, picks).withColumns(finish)
    return ranked.drop("__upto", *picks)


def describe_values(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """One unrounded row per group: n, mean, median, mode, low, high, variance,
    std_dev, q1, q3 and mad (mean absolute deviation about the mean)."""
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    if (large := _narrowed(df, keys, value, marks)) is not None:
        present, of_group, groups = large
        rows = present.withColumn("cnt", F.lit(1).cast("long")).join(F.broadcast(of_group), list(keys))
    else:
        rows = _counted(df, keys, value, marks)
    v, cnt, mean = F.col(value), F.col("cnt"), F.col("total") / F.col("n")
    grouped = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(mean).alias("mean"),
        F.max("median").alias("median"),
        # Most frequent value; the smallest one wins a tie.
        F.max_by(v, F.struct(cnt, -v)).alias("mode"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
        F.sum(cnt * (v - mean) * (v - mean)).alias("__squares"),
        F.max("q1").alias("q1"),
        F.max("q3").alias("q3"),
        F.max("total").alias("total"),
        (F.sum(cnt * F.abs(v - mean)) / F.max("n")).alias("mad"),
    )
    variance = F.try_divide(F.col("__squares"), F.col("n") - 1)
    if large is not None:
        grouped = grouped.drop("mode").join(modes(present, keys, value, groups), list(keys))
    return grouped.withColumns({"variance": variance, "std_dev": F.sqrt(variance)}).select(
        *keys, "n", "mean", "median", "mode", "low", "high", "q1", "q3", "mad", "variance", "std_dev"
    )
