"""Benchmark passages in training documents, by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import ALPHANUMERIC, U, blocks, mix, seeds, words
from candlewick.storage import settle

#: Which of eight, or five, consecutive words each seed looks at.
#: Together they hit every stretch that meets LeakSpec's defaults: a search over all
#: patterns of replaced words leaves none out (the tests hold the short ones).
MASKS = ("11010011", "10110101", "11101001", "10011011", "11111")
SPAN = 8

#: Bits of the filter of benchmark hashes that goes to every task, whatever the
#: benchmark's size.  A larger benchmark lets more training hashes through to the join.
FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class LeakSpec:
    """matches: words that must agree in place; share: least share of agreeing
    places in the overlap; items of fewer words need ``share`` of theirs instead,
    and those of fewer than SPAN words all."""

    matches: int = 13
    share: float = 0.8


def seed_hashes(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash at each word; words too near their text's end are
    marked by the caller.  ``hashes`` holds the words of all texts in a row."""
    out = []
    n = len(hashes)
    for m, mask in enumerate(MASKS):
        factor = seeds(SPAN + 1, 100 + m) | U(1)
        h = np.full(max(n - len(mask) + 1, 0), factor[SPAN], U)
        for k, care in enumerate(mask):
            if care == "1":
                h += hashes[k : k + len(h)] * factor[k]
        out.append(mix(h))
    return out


def whole_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of ``length`` words from each word on, for items compared as a whole."""
    factor = seeds(SPAN + 1, 200 + length) | U(1)
    h = np.full(max(len(hashes) - length + 1, 0), factor[SPAN], U)
    for k in range(length):
        h += hashes[k : k + len(h)] * factor[k]
    return mix(h)


def _inside(first: np.ndarray, span: int) -> np.ndarray:
    """Words at which a whole span fits into their text."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int64)
    counts = np.diff(first)
    long = counts >= span
    ok[first[:-1][long]] += 1
    ok[(first[1:] - span + 1)[long]] -= 1
    return np.cumsum(ok)[: max(n - span + 1, 0)] > 0


def _spread(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of each key."""
    return keys >> U(40), (keys >> U(8)) & U(FILTER_BITS - 1)


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of all keys, gathered as at most FILTER_BITS / 64 words."""
    key = F.col("key")
    bits = keys.select(
        F.explode(
            F.array(
                F.shiftrightunsigned(key, 40),
                F.shiftrightunsigned(key, 8).bitwiseAND(F.lit(FILTER_BITS - 1)),
            )
        ).alias("bit")
    )
    word = F.shiftright("bit", 6).alias("word")
    got = bits.groupBy(word).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for row in got.collect():
        table[row["word"]] = row["set"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _item_scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of items: item_id, words (hashes), and the keys and places of their seeds, or
    for an item of fewer than SPAN words the key of the whole."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            found = words(block, ALPHANUMERIC)
            size = np.diff(found.first)
            keys, places = [], []
            for mask, h in zip(MASKS, seed_hashes(found.hashes, found.first), strict=True):
                at = np.flatnonzero(_inside(found.first, len(mask)))
                at = at[size[np.searchsorted(found.first, at, side="right") - 1] >= SPAN]
                keys.append(h[at])
                places.append(at)
            for length in range(1, SPAN):
                at = found.first[:-1][size == length]
                keys.append(whole_hashes(found.hashes, length)[at])
                places.append(at)
            key, place = np.concatenate(keys), np.concatenate(places)
            owner = np.searchsorted(found.first, place, side="right") - 1
            order = np.argsort(owner, kind="stable")
            key, place, owner = key[order], place[order], owner[order]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").slice(block.first, len(size)),
                    _lists(found.first - found.first[0], found.hashes.astype(np.int64)),
                    _lists(bounds, key.astype(np.int64)),
                    _lists(bounds, place - found.first[owner]),
                ],
                names=["item_id", "words", "keys", "places"],
            )


def _scanner(passes, lengths: list[int]):
    """Rows of the documents with keys that pass the filter: doc_id, mark, words
    (hashes), seeds (keys, places), and once for each key of a whole item of one of
    ``lengths`` words the key, its first place and how often it stands there.
    ``words`` is empty where no seed passed, as nothing is compared then."""

    def passing(h: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
        one, two = _spread(h)
        at = np.flatnonzero(_inside(first, span) & passes.value[one])
        return at[passes.value[two[at]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = words(block, ALPHANUMERIC)
                first, rows = found.first, len(block.starts)

                def owners(place: np.ndarray) -> np.ndarray:
                    return np.searchsorted(first, place, side="right") - 1

                keys, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
                for mask, h in zip(MASKS, seed_hashes(found.hashes, first), strict=True):
                    at = passing(h, first, len(mask))
                    keys.append(h[at])
                    places.append(at)
                key, place = np.concatenate(keys), np.concatenate(places)
                owner = owners(place)
                order = np.argsort(owner, kind="stable")
                key, place, owner = key[order], place[order], owner[order]
                per = np.bincount(owner, minlength=rows)

                short = [(np.zeros(0, U), np.zeros(0, np.int64))]
                for length in lengths:
                    h = whole_hashes(found.hashes, length)
                    at = passing(h, first, length)
                    short.append((h[at], at))
                whole, where = (np.concatenate(c) for c in zip(*short, strict=True))
                holder = owners(where)
                order = np.lexsort((where, whole, holder))
                whole, where, holder = whole[order], where[order], holder[order]
                new = np.ones(len(whole), bool)
                new[1:] = (whole[1:] != whole[:-1]) | (holder[1:] != holder[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(whole)))
                whole, where, holder = whole[starts], where[starts], holder[starts]
                per_whole = np.bincount(holder, minlength=rows)

                chosen = np.flatnonzero(per + per_whole > 0)
                lengths_of = np.where(per > 0, np.diff(first), 0)[chosen]
                take = [found.hashes[first[i] : first[i + 1]] for i in chosen if per[i]]
                take = np.concatenate([np.zeros(0, U), *take]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(per[chosen])])
                bounds_whole = np.concatenate([[0], np.cumsum(per_whole[chosen])])
                picked = pa.array(block.first + chosen)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(picked),
                        batch.column("mark").take(picked),
                        _lists(np.concatenate([[0], np.cumsum(lengths_of)]), take),
                        _lists(bounds, key.astype(np.int64)),
                        _lists(bounds, place - first[owner]),
                        _lists(bounds_whole, whole.astype(np.int64)),
                        _lists(bounds_whole, where - first[holder]),
                        _lists(bounds_whole, times),
                    ],
                    names=_SUSPECT,
                )

    return run


_SUSPECT = ["doc_id", "mark", "words", "keys", "places", "wholes", "firsts", "times"]


def _best_run(agree: np.ndarray, share: Fraction) -> tuple[int, int]:
    """The stretch with the most agreeing places of all that reach ``share``.

    Only the least sums so far can start it, and each goes with the last place
    whose sum is not below its own.
    """
    n, d = share.numerator, share.denominator
    sums = np.concatenate([[0], np.cumsum(np.where(agree, d - n, -n))])
    count = np.concatenate([[0], np.cumsum(agree)])
    low = np.minimum.accumulate(sums)
    starts = np.flatnonzero(np.diff(low, prepend=low[0] + 1))
    highest = np.maximum.accumulate(sums[::-1])  # of all places from the end on
    ends = len(sums) - 1 - np.searchsorted(highest, sums[starts])
    best = int(np.argmax(count[ends] - count[starts]))
    inside = np.flatnonzero(agree[starts[best] : ends[best]]) + starts[best]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


def _verifier(spec: LeakSpec):
    share = Fraction(str(spec.share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, starts, ends, matched, size = [], [], [], [], [], []
            mine, theirs = batch.column("mine"), batch.column("theirs")
            for i in range(batch.num_rows):
                a = mine[i].values.to_numpy()
                b = theirs[i].values.to_numpy()
                shift = batch.column("diagonal")[i].as_py()
                b_from = max(0, -shift)
                width = min(len(a), len(b) - b_from)
                agree = a[:width] == b[b_from : b_from + width]
                start, end = _best_run(agree, share)
                count = int(agree[start:end].sum())
                if end > start and count >= min(spec.matches, math.ceil(len(b) * share)):
                    rows.append(batch.column("row")[i].as_py())
                    items.append(batch.column("item_id")[i].as_py())
                    starts.append(max(0, shift) + start)
                    ends.append(max(0, shift) + end)
                    matched.append(count)
                    size.append(len(b))
            arrays = [pa.array(c, pa.int64()) for c in (rows, items, starts, ends, matched, size)]
            yield pa.RecordBatch.from_arrays(
                arrays,
                names=["row", "item_id", "first_word", "end_word", "matched_words", "item_words"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """Row per (document, benchmark item) that share a passage: doc_id, item_id,
    n_places, of the longest one first_word, end_word, matched_words, item_words,
    and text_hash (xxhash64 of the document's text).

    Words are runs of letters and digits, A-Z lower-cased.  A shared passage is
    a stretch of words in the same order and distance in both, in which at least
    ``share`` of the places agree and ``matches`` words in all (``share`` of the
    item's words, if that is less).  So single words may be replaced.  Items of
    fewer than SPAN (eight) words must stand there whole, without a replaced word.

    Each mask hashes five of eight consecutive words, the last one five in a row;
    shorter items have one hash of all their words.  Training hashes first pass
    a bit filter of fixed size, are then joined to the benchmark's hashes by
    shuffle, and every (document, item, distance) that they hit is compared word
    by word over the item's length.

    Null texts and texts and items without words share nothing; items without an id are
    ignored.  Documents without an id have rows with null doc_id.  Repeated rows count
    once; different texts with one doc_id, null or not, have rows of their own.  Extra
    columns are ignored.  Either table empty: an empty result.  Items, their filter and the
    documents that pass it are stored while the result is being built.
    """
    items = settle(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .where("item_id is not null")
        .mapInArrow(
            _item_scanner, "item_id long, words array<long>, keys array<long>, places array<long>"
        )
        .where(F.size("words") > 0)
        .dropDuplicates(["item_id"])
    )
    n_words = F.size("words")
    targets = items.select(
        "item_id", n_words.alias("n"), F.explode(F.arrays_zip("keys", "places")).alias("h")
    ).select("item_id", "n", F.col("h.keys").alias("key"), F.col("h.places").alias("item_place"))
    passes = docs.sparkSession.sparkContext.broadcast(_filter(targets.select("key")))
    # At most SPAN - 1 numbers.
    lengths = [r["n"] for r in items.where(n_words < SPAN).select(n_words.alias("n")).distinct().collect()]
    suspects = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
        .where("text is not null")
        .mapInArrow(
            _scanner(passes, sorted(lengths)),
            ", ".join([f"{c} long" for c in _SUSPECT[:2]] + [f"{c} array<long>" for c in _SUSPECT[2:]]),
        )
    ).withColumn("row", F.monotonically_increasing_id())  # of stored rows: the same at every reading
    hits = suspects.select("row", F.explode(F.arrays_zip("keys", "places")).alias("h")).select(
        "row", F.col("h.keys").alias("key"), F.col("h.places").alias("place")
    )
    lines = (
        hits.join(targets.where(F.col("n") >= SPAN), "key")
        .select("row", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"))
        .distinct()
    )
    theirs = items.select("item_id", F.col("words").alias("theirs"))
    from_word = F.greatest("diagonal", F.lit(0)).cast("int")
    compared = (
        lines.join(items.select("item_id", F.size("words").alias("n")), "item_id")
        .join(suspects.select("row", "words"), "row")
        .select("row", "item_id", "diagonal", F.slice("words", from_word + 1, F.col("n")).alias("mine"))
        .join(theirs, "item_id")
        .select("row", "item_id", "diagonal", "mine", "theirs")
        .mapInArrow(
            _verifier(spec),
            "row long, item_id long, first_word long, end_word long, matched_words long, item_words long",
        )
    )
    short = (
        suspects.select("doc_id", "mark", F.explode(F.arrays_zip("wholes", "firsts", "times")).alias("h"))
        .select("doc_id", "mark", F.col("h.wholes").alias("key"), F.col("h.firsts").alias("first_word"), F.col("h.times").alias("places"))
        .join(targets.where(F.col("n") < SPAN), "key")
        .select(
            "doc_id",
            "mark",
            "item_id",
            "first_word",
            (F.col("first_word") + F.col("n")).alias("end_word"),
            F.col("n").cast("long").alias("matched_words"),
            F.col("n").cast("long").alias("item_words"),
            "places",
        )
        .distinct()
    )
    compared = compared.join(suspects.select("row", "doc_id", "mark"), "row").drop("row").distinct()
    found = compared.withColumn("places", F.lit(1).cast("long")).unionByName(short)
    best = F.struct("matched_words", (-F.col("first_word")).alias("before"), "end_word", "item_words")
    return (
        found.groupBy("doc_id", "mark", "item_id")
        .agg(F.sum("places").alias("n_places"), F.max(best).alias("b"))
        .select(
            "doc_id",
            "item_id",
            "n_places",
            (-F.col("b.before")).alias("first_word"),
            "b.end_word",
            "b.matched_words",
            "b.item_words",
            F.col("mark").alias("text_hash"),
        )
    )
