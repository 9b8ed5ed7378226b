"""Exactly repeated byte strings, by an enhanced suffix array over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import (
    U,
    blocks,
    hash_sums,
    ranges,
    sliding_minimum,
    sorted_groups,
    sums_hash,
)
from candlewick.storage import settle

_PLACE = U((1 << 28) - 1)


@dataclass(frozen=True)
class RepeatSpec:
    """length: bytes of a repeat; anchor: bytes of the string whose least hash
    marks a place in every window; group: contexts that one task compares;
    chunk: starts that share a core where a group is larger."""

    length: int = 400
    anchor: int = 32
    group: int = 2048
    chunk: int = 46


_KEY = ["doc_id", "mark"]
_ANCHOR = "doc_id long, mark long, pos long, key long, context long, before int, after int"


def _anchors(spec: RepeatSpec):
    """Each window's anchor, and the bytes before and after it that its windows cover."""
    width = spec.length - spec.anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                size = block.ends - block.starts
                long = np.flatnonzero(size >= spec.length)
                if not len(long):
                    continue
                sums = hash_sums(block.data)
                at = np.arange(len(block.data) - spec.anchor + 1)
                hashes = sums_hash(sums, at, at + spec.anchor)
                low = sliding_minimum((hashes & ~_PLACE) | at.astype(U), width)
                # All windows, in order; those with one anchor follow each other.
                starts = ranges(block.starts[long], size[long] - spec.length + 1)
                owner = np.repeat(long, size[long] - spec.length + 1)
                place = (low[starts] & _PLACE).astype(np.int64)
                new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
                last = np.r_[new[1:], len(starts)] - 1
                place, owner = place[new], owner[new]
                begin, end = starts[new], starts[last] + spec.length
                rows = pa.array(block.first + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("mark").take(rows),
                        pa.array(place - block.starts[owner]),
                        pa.array(hashes[place].astype(np.int64)),
                        pa.array(sums_hash(sums, begin, end).astype(np.int64)),
                        pa.array((place - begin).astype(np.int32)),
                        pa.array((end - place).astype(np.int32)),
                    ],
                    names=["doc_id", "mark", "pos", "key", "context", "before", "after"],
                )

    return run


_CONTEXT = "key long, context long, n long, m long, left binary, right binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted place; those on the left are turned round."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        wanted = batch.column("wanted")
        for block in blocks(batch.column("text")):
            for i in range(len(block.starts)):
                text = block.text(i)
                for w in wanted[block.first + i].as_py():
                    pos, begin = w["pos"], w["pos"] - w["before"]
                    row = (w["key"], w["context"], w["n"], w["m"])
                    row += (text[begin:pos][::-1], text[pos : pos + w["after"]])
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "context", "n", "m", "left", "right"])


def common_prefixes(strings: list[bytes]) -> list[int]:
    """Length of the common prefix of each string with the one before it."""
    out = [0]
    for a, b in zip(strings, strings[1:], strict=False):
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out.append(n)
        else:
            x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
            out.append(int((x != y).argmax()))
    return out


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The inner nodes of the common-prefix interval tree, children first:
    (depth, bounds of the children) of each, found by one scan with a stack."""
    stack: list[tuple[int, int, list[tuple[int, int]]]] = []  # depth, start, children
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else -1
        child = (i - 1, i)
        while stack and stack[-1][0] > depth:
            d, start, children = stack.pop()
            yield d, [*children, child]
            child = (start, i)
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(child)
        else:
            stack.append((depth, child[0], [child]))


def repeated_spans(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context the stretches around its anchor, as (bytes before, bytes
    after), of ``length`` or more that another context repeats.

    ``rights`` are sorted: they are the suffix array.  At each node of its
    interval tree the members agree in exactly ``depth`` bytes with those of
    other children.  Their left extensions are tested for the longest agreement
    across children: where all extend alike to the left no node is a maximal
    repeat of its own, where they differ each member gets its own longest one.
    """
    n = len(rights)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    shared = common_prefixes([lefts[i] for i in order])
    for depth, children in prefix_intervals(common_prefixes(rights)):
        if depth <= 0:
            continue
        members = sorted(
            (rank[i], i, c) for c, (a, b) in enumerate(children) for i in range(a, b)
        )
        best = [0] * len(members)
        for direction in (1, -1):
            # The last member seen, the last of another child, and the agreement with each.
            one: tuple[int, int] | None = None  # child, agreement
            two: tuple[int, int] | None = None
            previous = None
            steps = range(len(members)) if direction > 0 else range(len(members) - 1, -1, -1)
            for k in steps:
                r, _, child = members[k]
                if previous is not None:
                    low, high = (previous, r) if direction > 0 else (r, previous)
                    gap = min(shared[low + 1 : high + 1])
                    one = (one[0], min(one[1], gap))
                    two = two and (two[0], min(two[1], gap))
                    if one[0] != child:
                        best[k] = max(best[k], one[1])
                    elif two:
                        best[k] = max(best[k], two[1])
                if one is not None and one[0] != child:
                    two = one
                one = (child, 1 << 30)
                previous = r
        for (_, i, _), extent in zip(members, best, strict=True):
            if extent + depth >= length:
                found[i].append((extent, depth))
    return found


_COVER = "key long, context long, low int, high int"


def _scan(spec: RepeatSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []
        for group in sorted_groups(batches, ["key"]):
            lefts, rights = group.column("left").to_pylist(), group.column("right").to_pylist()
            found = repeated_spans(lefts, rights, spec.length)
            if any(found):
                keys, contexts = group.column("key").to_pylist(), group.column("context").to_pylist()
                for i, spans in enumerate(found):
                    rows += [(keys[i], contexts[i], -before, after) for before, after in spans]
            if len(rows) > 10_000:
                yield _batch(rows, _COVER)
                rows = []
        yield _batch(rows, _COVER)

    return run


_PART = "key long, context long, n long, part int, core long, whole long"
_START = "key long, context long, n long, part int, core long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    kinds = {"long": pa.int64(), "int": pa.int32()}
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])


def _starts_of(row: dict, spec: RepeatSpec) -> tuple[np.ndarray, int, range]:
    """Hash sums of a context, where its anchor stands, and the bytes before the
    anchor at which its strings of ``length`` may start."""
    before, after = len(row["left"]), len(row["right"])
    data = np.frombuffer(row["left"][::-1] + row["right"], np.uint8)
    return hash_sums(data), before, range(max(0, spec.length - after), before + 1)


def _parts(spec: RepeatSpec):
    """For each chunk of starts of a context the core that all its strings share,
    and the whole that they span; null where the context cuts the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums, before, starts = _starts_of(row, spec)
                for part in range(starts[0] // spec.chunk, starts[-1] // spec.chunk + 1):
                    first, last = part * spec.chunk, (part + 1) * spec.chunk - 1
                    low, high = before - first, before - last + spec.length
                    (core,) = sums_hash(sums, np.array([low]), np.array([high])).astype(np.int64)
                    whole = None
                    if first in starts and last in starts:
                        low, high = before - last, before - first + spec.length
                        (whole,) = sums_hash(sums, np.array([low]), np.array([high])).astype(np.int64)
                    out.append((row["key"], row["context"], row["n"], part, core, whole))
            yield _batch(out, _PART)

    return run


def _singles(spec: RepeatSpec):
    """Each string of ``length`` that starts in the wanted chunks of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums, before, starts = _starts_of(row, spec)
                for wanted in row["parts"]:
                    first = wanted["part"] * spec.chunk
                    own = np.arange(max(first, starts[0]), min(first + spec.chunk - 1, starts[-1]) + 1)
                    cores = sums_hash(sums, before - own, before - own + spec.length).astype(np.int64)
                    for p, c in zip(own.tolist(), cores.tolist(), strict=True):
                        out.append((row["key"], row["context"], wanted["n"], p, c))
            yield _batch(out, _START)

    return run


def _large_groups(contexts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """The same stretches for groups of any size, by counting strings.

    Starts are taken in chunks.  Where the whole of a chunk repeats, so do all its
    strings; where its core does not, none does.  Only in between, and for one
    context of each distinct whole, single strings are counted.
    """
    same = ["key", "part", "core"]
    parts = contexts.mapInArrow(_parts(spec), _PART)
    # A chunk that is cut has a whole of its own.
    parts = parts.withColumn("cut", F.col("whole").isNull()).withColumn(
        "whole", F.coalesce("whole", F.xxhash64("key", "context", "part"))
    )
    parts = settle(parts)
    wholes = parts.groupBy(*same, "whole", "cut").agg(
        F.sum("n").alias("n"), F.min("context").alias("context")
    )
    again = wholes.where("n > 1 and not cut").select(*same, "whole")
    full = parts.join(again, [*same, "whole"], "left_semi").select(
        "key",
        "context",
        (-(F.col("part") + 1) * spec.chunk + 1).cast("int").alias("low"),
        (F.lit(spec.length) - F.col("part") * spec.chunk).cast("int").alias("high"),
    )
    several = wholes.groupBy(*same).agg(F.count("*").alias("w")).where("w > 1").select(*same)
    open_parts = (
        wholes.join(several, same, "left_semi")
        .groupBy("key", "context")
        .agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    )
    starts = contexts.drop("n", "m").join(open_parts, ["key", "context"]).mapInArrow(_singles(spec), _START)
    total = starts.groupBy(*same).agg(F.sum("n").alias("total")).where("total > 1").select(*same)
    single = starts.join(total, same, "left_semi").select(
        "key",
        "context",
        (-F.col("part")).cast("int").alias("low"),
        (F.lit(spec.length) - F.col("part")).cast("int").alias("high"),
    )
    return full.unionByName(single)


def repeated_stretches(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(doc_id, mark, first, end): stretches of bytes of a document all of whose
    ``length``-byte strings start somewhere else too; overlapping ones occur.
    ``docs`` has doc_id, mark (a hash of the text) and text.

    Every window of ``length`` bytes has an anchor, its ``anchor``-byte string of
    least hash, so equal windows have equal anchors at equal places.  Windows
    with one anchor make its context.  Equal contexts are counted, not compared.
    Different contexts of one anchor are sorted by the bytes that follow it and
    scanned as a suffix array with common prefixes; groups too large for a task
    are resolved by counting hashes of their strings.
    """
    anchors = docs.mapInArrow(_anchors(spec), _ANCHOR)
    place = F.struct("doc_id", "mark", "pos", "before", "after")
    contexts = settle(
        anchors.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    )
    groups = contexts.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    mixed = contexts.join(groups.where("m > 1 and least = 1").select("key", "m"), "key")
    wanted = (
        mixed.select("key", "context", "n", "m", "at.*")
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("key", "context", "n", "m", "pos", "before", "after")).alias("wanted"))
    )
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["mark"] == wanted["mark"])
    around = settle(
        docs.join(wanted, same).select("text", "wanted").mapInArrow(_fetch, _CONTEXT)
    )
    small = around.where(F.col("m") <= spec.group)
    scanned = (
        small.repartition("key")
        .sortWithinPartitions("key", "right", "left")
        .select("key", "context", "left", "right")
        .mapInArrow(_scan(spec), _COVER)
    )
    counted = _large_groups(around.where(F.col("m") > spec.group), spec)
    whole = contexts.where("n > 1").select(
        "key", "context", (-F.col("at.before")).alias("low"), F.col("at.after").alias("high")
    )
    cover = scanned.unionByName(counted).unionByName(whole)
    return anchors.join(cover, ["key", "context"]).select(
        "doc_id", "mark", (F.col("pos") + F.col("low")).alias("first"), (F.col("pos") + F.col("high")).alias("end")
    )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remover(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            spans = batch.column("spans")
            for block in blocks(batch.column("text")):
                for i in range(len(block.starts)):
                    text = block.text(i)
                    found = spans[block.first + i].as_py() or []
                    rest, at, gone, count = [], 0, 0, 0
                    end = -1
                    for s in sorted((s["first"], s["end"]) for s in found):
                        if s[0] > end:
                            rest.append(text[max(at, 0) : s[0]])
                            count += 1
                            gone += s[1] - s[0]
                        elif s[1] > end:
                            gone += s[1] - end
                        end = max(end, s[1])
                        at = end
                    rest.append(text[at:])
                    left = b"".join(rest)
                    sizes.append(len(text))
                    removed.append(gone)
                    runs.append(count)
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if keep else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in (sizes, removed, runs)],
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def without_repeated_bytes(docs: DataFrame, spec: RepeatSpec = RepeatSpec(), keep: bool = True) -> DataFrame:
    """Row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    Every byte of ``text`` (UTF-8) goes that lies in a ``length``-byte string
    which also starts anywhere else, in this document or another, judged on the
    texts as given.  n_spans counts the runs removed; kept is what is left (null
    unless ``keep``; its edges may split characters).

    Null or empty text: nothing to remove.  A repeated row is a document of its
    own, so its strings repeat.  A null doc_id is kept.  Extra columns are
    ignored.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = repeated_stretches(docs, spec)
    spans = found.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    same = docs["doc_id"].eqNullSafe(spans["doc_id"]) & (docs["mark"] == spans["mark"])
    out = docs.join(spans, same, "left").select(docs["doc_id"], "text", "spans")
    return out.mapInArrow(_remover(keep), _RESULT)
