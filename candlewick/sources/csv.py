"""Delimited text: bannered price folders, headered tables, typed columns."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from candlewick.storage import settle

# Ship these functions inside the plan, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The eighth column holds the volume, whatever a file calls it.
VOLUME_POSITION, VOLUME = 8, "Volume"
PRICE_TYPES = {
    "date": "timestamp",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "Volume": "double",
}
#: Files up to which the table of their layouts, some hundred bytes each, is broadcast.
BROADCAST_FILES = 100_000


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First line after the banner that is not blank, of each file.

    Lines are those of the files' first blocks, which a scan hands on in order;
    a task may hold several files, one after the other.
    """
    path, found = None, False
    for batch in batches:
        heads = []
        codes = batch.column("path").dictionary_encode()
        number = codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            at = start
            if (name := codes.dictionary[int(number[start])].as_py()) != path:
                path, found, at = name, False, start + 1  # the banner is passed over
            while not found and at < end:
                line = batch.column("value")[at].as_py()
                if line.strip():
                    found = True
                    heads.append((path, line))
                at += 1
        columns = list(zip(*heads, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string()) for c in columns], names=["path", "header"]
        )


def _cells(header: str) -> list[str]:
    return next(csv.reader(io.StringIO(header)))


def column_names(header: str) -> list[str]:
    """Names of a header's columns; a repeated name gets a number behind a dot."""
    names = _cells(header)
    if len(names) >= VOLUME_POSITION:
        names[VOLUME_POSITION - 1] = VOLUME
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        times = seen[name] = seen.get(name, -1) + 1
        names[i] = f"{name}.{times}" if times else name
    return names


def scan_banner_csv(
    spark: SparkSession, folder: str, types: Mapping[str, str] | None = None
) -> DataFrame:
    """Union by name of all ``*.csv`` files directly in ``folder``.

    Each file starts with a banner line, then a header.  A first pass over the
    lines stores each file's header; the result is one CSV scan of all files,
    however many layouts they have: cells are read by position, and a file's
    layout says which column a position holds.  Both passes open files through
    Spark's readers only.  Columns named in ``types`` are parsed, values that do
    not parse and NaN become null, all others stay text; columns a file lacks
    are null.  Blank lines and repeated header lines count nowhere; a file without
    a header line has no rows.  No file: FileNotFoundError; no header: ValueError.
    """
    types = PRICE_TYPES if types is None else types
    lines = spark.read.text(folder, pathGlobFilter="*.csv")
    if not (files := len(lines.inputFiles())):
        raise FileNotFoundError(f"no CSV file in {folder}")
    first = lines.where("_metadata.file_block_start = 0")
    heads = settle(
        first.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(
            _headers, "path string, header string"
        )
    )
    # One row per distinct header: each adds to the result's columns.
    rows = heads.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()
    layouts = [r["header"] for r in rows]
    if not layouts:
        raise ValueError(f"no CSV file in {folder} has a header line")
    numbered = spark.createDataFrame(list(enumerate(layouts)), "layout int, header string")
    of_file = heads.join(numbered, "header").select("path", "layout")
    if files <= BROADCAST_FILES:
        of_file = F.broadcast(of_file)
    width = max(len(_cells(h)) for h in layouts)
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(width)])
    # header=True drops each file's first line that is not blank, which is the banner
    # unless that is blank; the header then comes as a row and is filtered out.
    cells = spark.read.schema(schema).csv(
        folder,
        header=True,
        enforceSchema=True,
        ignoreTrailingWhiteSpace=True,
        pathGlobFilter="*.csv",
    )
    cells = cells.withColumn("path", F.col("_metadata.file_path")).join(of_file, "path")
    return cells.where(~_is_header(layouts)).select(*_columns(layouts, types))


def _is_header(layouts: list[str]) -> Column:
    """Whether a row repeats the header of its file's layout."""
    out = F.lit(False)
    for number, header in enumerate(layouts):
        same = F.col("layout") == number
        for i, text in enumerate(_cells(header)):
            same &= F.col(f"_c{i}").eqNullSafe(F.lit(text.rstrip() or None))
        out |= same
    return out


def _columns(layouts: list[str], types: Mapping[str, str]) -> list[Column]:
    """The columns of all layouts by name, each read at its layout's position."""
    places: dict[str, dict[int, list[int]]] = {}
    for number, header in enumerate(layouts):
        for i, name in enumerate(column_names(header)):
            places.setdefault(name, {}).setdefault(i, []).append(number)
    out = []
    for name, at in places.items():
        text = F.coalesce(
            *(F.when(F.col("layout").isin(numbers), F.col(f"_c{i}")) for i, numbers in at.items())
        )
        if (kind := types.get(name)) is not None:
            value = text.try_cast(kind)
            text = F.when(~F.isnan(value), value) if kind in ("double", "float") else value
        out.append(text.alias(name))
    return out


def scan_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with one header line and a declared schema.  A missing path raises."""
    return spark.read.schema(schema).csv(path, header=True)
