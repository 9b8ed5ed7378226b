"""Ordered computation over series of any length.

A window partitioned by symbol puts a whole series into one task, which fails
once one symbol holds a large share of the data.  A ``Layout`` says how the
series of a table are laid out over tasks:

* every key with at most ``slice_rows`` rows stays in one piece (slice 0);
* a larger ("hot") key is cut into consecutive slices at quantiles of its order
  column, so no slice is much larger than ``slice_rows``, however the rows are
  spread over time.  A single order value that is itself too frequent is cut
  again by the tie-break column.

Cut points are plain numbers held in the plan, so a retried task or a second
branch of the same query always sees the same slices.  On top of that layout:

* ``lookaround`` evaluates windows with a bounded frame; each slice is given
  the few neighbouring rows that its edge rows look at;
* ``totals`` and ``running`` combine one small row per (key, slice) and join
  it back on (key, slice), the partitioning the rows already have.

Tables that fit one slice get none of this: plain windows by key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.config import MAX_SLICES, slice_rows

SLICE = "__slice"
_OWN = "__own"
_FIRST, _SECOND = "__cut_first", "__cut_second"

_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def order_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the column's order."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # Wall-clock parts: independent of the session time zone.
        day = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date"))
        second = F.hour(c) * 3600 + F.minute(c) * 60
        fraction = F.expr(f"extract(SECOND FROM `{name}`)").cast("double")
        return (day.cast("double") * 86400.0 + second + fraction) * 1e6
    if isinstance(kind, T.DateType):
        return F.date_diff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return c.cast("double")


def _edges(cuts: list[float]) -> tuple[list[float], list[float]]:
    """Bucket edges, and the values frequent enough to fill whole buckets."""
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    inner = sorted(set(cuts) | set(heavy) | {math.nextafter(v, math.inf) for v in heavy})
    return [-math.inf, *inner, math.inf], heavy


def _bucket(df: DataFrame, edges: list[float], source: str, target: str) -> DataFrame:
    if len(edges) < 3:
        return df.withColumn(target, F.lit(0.0))
    return Bucketizer(
        splits=edges, inputCol=source, outputCol=target, handleInvalid="keep"
    ).transform(df)


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: DataFrame | None = field(default=None, compare=False)
    edges: tuple[float, ...] = ()
    heavy: tuple[float, ...] = ()
    tie_edges: tuple[float, ...] = ()

    # -- planning ---------------------------------------------------------
    @staticmethod
    def plan(
        df: DataFrame,
        keys: tuple[str, ...],
        order: tuple[str, ...],
        limit: int | None = None,
        upper_bound: Callable[[], int] | None = None,
    ) -> Layout:
        """Choose slices for ``df``.

        ``upper_bound`` gives a cheap bound on the row count (by default
        ``df.count()``, which reads only footers for a plain parquet scan).
        Only a table above ``limit`` pays for finding hot keys and quantiles.
        """
        spark = df.sparkSession
        limit = limit or slice_rows(spark)
        total = upper_bound() if upper_bound else df.count()
        if total <= limit:
            return Layout(keys, order)
        # At most total / limit keys can exceed the limit, so this list is small.
        heavy_keys = (
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
        )
        rows = heavy_keys.collect()
        if not rows:
            return Layout(keys, order)
        schema = T.StructType([df.schema[k] for k in keys])
        hot = spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], schema)
        hot_rows = df.join(F.broadcast(hot), list(keys), "left_semi")
        pieces = math.ceil(sum(r["__n"] for r in rows) / limit)
        edges, heavy = _edges(_quantiles(hot_rows, order[0], pieces))
        tie_edges: list[float] = []
        if heavy and len(order) > 1 and _countable(df, order[1]):
            tied = hot_rows.where(order_number(hot_rows, order[0]).isin(heavy))
            tie_pieces = math.ceil(tied.count() / limit)
            tie_edges = _edges(_quantiles(tied, order[1], tie_pieces))[0]
        return Layout(keys, order, hot, tuple(edges), tuple(heavy), tuple(tie_edges))

    @property
    def split(self) -> bool:
        return self.hot is not None

    def tag(self, df: DataFrame) -> DataFrame:
        """Add the slice number; increasing along the order inside a key."""
        if not self.split or SLICE in df.columns:
            return df
        tagged = df.join(
            F.broadcast(self.hot.withColumn("__hot", F.lit(True))), list(self.keys), "left"
        )
        tagged = tagged.withColumn(_FIRST, order_number(df, self.order[0]))
        tagged = _bucket(tagged, list(self.edges), _FIRST, "__bucket")
        number = F.col("__bucket").cast("long") * max(1, len(self.tie_edges))
        if self.tie_edges:
            tagged = tagged.withColumn(_SECOND, order_number(df, self.order[1]))
            tagged = _bucket(tagged, list(self.tie_edges), _SECOND, "__tie_bucket")
            inside = F.when(F.col(_FIRST).isin(*self.heavy), F.col("__tie_bucket"))
            number = number + F.coalesce(inside.cast("long"), F.lit(0))
        return tagged.withColumn(
            SLICE,
            F.when(F.col("__hot"), F.coalesce(number, F.lit(-1))).otherwise(F.lit(0).cast("long")),
        ).drop("__hot", _FIRST, _SECOND, "__bucket", "__tie_bucket")

    def group_keys(self) -> list[str]:
        return [*self.keys, SLICE] if self.split else list(self.keys)

    def window(self, *order: Column | str) -> WindowSpec:
        return W.partitionBy(*self.group_keys()).orderBy(*(order or self.order))

    # -- bounded frames ---------------------------------------------------
    def lookaround(
        self,
        df: DataFrame,
        build: Callable[[DataFrame, WindowSpec], DataFrame],
        back: int = 0,
        ahead: int = 0,
    ) -> DataFrame:
        """Apply ``build(df, window)``, whose frames reach at most ``back``
        rows before and ``ahead`` rows after a row."""
        if not self.split:
            return build(df, self.window())
        tagged = self.tag(df)
        names = tagged.columns
        parts = [tagged.withColumn(_OWN, F.lit(True))]
        if back:
            parts.append(self._neighbours(tagged, names, back, before=True))
        if ahead:
            parts.append(self._neighbours(tagged, names, ahead, before=False))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return build(rows, self.window()).where(F.col(_OWN)).drop(_OWN)

    def _neighbours(
        self, tagged: DataFrame, names: list[str], reach: int, before: bool
    ) -> DataFrame:
        """Per slice of a hot key: the ``reach`` rows next to it, re-labelled
        with that slice.  A slice shorter than ``reach`` passes on what it got
        from its own neighbours, hence the window over whole slices."""
        keys = list(self.keys)
        hot = tagged.join(F.broadcast(self.hot), keys, "left_semi")
        inward = [F.col(c).desc() if before else F.col(c).asc() for c in self.order]
        edge = hot.withColumn(
            "__rank", F.row_number().over(W.partitionBy(*keys, SLICE).orderBy(*inward))
        ).where(F.col("__rank") <= reach)
        body = [n for n in names if n not in (*keys, SLICE)]
        # The struct leads with the order columns so that sorting is by order.
        lead = list(self.order) + [n for n in body if n not in self.order]
        packed = edge.groupBy(*keys, SLICE).agg(
            F.array_sort(F.collect_list(F.struct(*lead))).alias("__rows")
        )
        near = W.partitionBy(*keys).orderBy(SLICE)
        near = near.rowsBetween(-reach, -1) if before else near.rowsBetween(1, reach)
        gathered = F.flatten(F.collect_list("__rows").over(near))
        packed = packed.withColumn("__rows", gathered)
        size = F.size("__rows")
        first = F.greatest(size - reach, F.lit(0)) + 1 if before else F.lit(1)
        packed = packed.where(size > 0).withColumn(
            "__rows", F.slice("__rows", first, F.least(size, F.lit(reach)))
        )
        rows = packed.select(*keys, SLICE, F.explode("__rows").alias("__row"))
        return rows.select(*keys, SLICE, *[F.col(f"__row.{n}").alias(n) for n in body]).select(
            *names, F.lit(False).alias(_OWN)
        )

    # -- whole-series values ----------------------------------------------
    def totals(self, df: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
        """Add per-key totals.  ``values``: name -> (sum | min | max, column)."""
        if not self.split:
            whole = W.partitionBy(*self.keys)
            return df.withColumns({n: _COMBINE[f](c).over(whole) for n, (f, c) in values.items()})
        tagged = self.tag(df)
        whole = W.partitionBy(*self.keys)
        per_slice = tagged.groupBy(*self.keys, SLICE).agg(
            *[_COMBINE[f](c).alias(n) for n, (f, c) in values.items()]
        )
        spread = per_slice.withColumns(
            {n: _COMBINE[f](F.col(n)).over(whole) for n, (f, _) in values.items()}
        )
        return _attach(tagged, spread, [*self.keys, SLICE])

    def running(
        self,
        df: DataFrame,
        sums: dict[str, Column],
        totals: dict[str, tuple[str, Column]] | None = None,
    ) -> DataFrame:
        """Add running sums (current row included) and, optionally, totals."""
        totals = totals or {}
        so_far = self.window().rowsBetween(W.unboundedPreceding, 0)
        if not self.split:
            out = df.withColumns({n: F.sum(c).over(so_far) for n, c in sums.items()})
            return self.totals(out, totals) if totals else out
        tagged = self.tag(df)
        keys = [*self.keys, SLICE]
        whole = W.partitionBy(*self.keys)
        earlier = whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        per_slice = tagged.groupBy(*keys).agg(
            *[F.sum(c).alias(f"__{n}") for n, c in sums.items()],
            *[_COMBINE[f](c).alias(n) for n, (f, c) in totals.items()],
        )
        spread = per_slice.withColumns(
            {f"__{n}": F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) for n in sums}
            | {n: _COMBINE[f](F.col(n)).over(whole) for n, (f, _) in totals.items()}
        )
        out = _attach(tagged, spread, keys)
        return out.withColumns(
            {n: F.col(f"__{n}") + F.sum(c).over(so_far) for n, c in sums.items()}
        ).drop(*[f"__{n}" for n in sums])

    def fill_forward(self, df: DataFrame, source: str, target: str) -> DataFrame:
        """Last non-null value so far."""
        so_far = self.window().rowsBetween(W.unboundedPreceding, 0)
        local = F.last(source, ignorenulls=True).over(so_far)
        if not self.split:
            return df.withColumn(target, local)
        tagged = self.tag(df)
        keys = [*self.keys, SLICE]
        position = F.when(F.col(source).isNotNull(), F.struct(*self.order))
        per_slice = tagged.groupBy(*keys).agg(F.max_by(source, position).alias("__carry"))
        earlier = W.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        carry = per_slice.withColumn("__carry", F.last("__carry", ignorenulls=True).over(earlier))
        out = _attach(tagged, carry, keys)
        return out.withColumn(target, F.coalesce(local, "__carry")).drop("__carry")


def _attach(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(per_slice, keys, "left")


def _countable(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _quantiles(df: DataFrame, name: str, pieces: int) -> list[float]:
    pieces = min(pieces, MAX_SLICES)
    if pieces < 2:
        return []
    marks = [i / pieces for i in range(1, pieces)]
    numbers = df.select(order_number(df, name).alias("__v"))
    return [float(v) for v in numbers.stat.approxQuantile("__v", marks, 1 / (4 * pieces))]
