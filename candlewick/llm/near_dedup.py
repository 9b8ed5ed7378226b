"""Near-duplicate documents by fast similarity sketching (MinHash with filled bins)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.components import components
from candlewick.llm.textscan import U, blocks, mix, seeds, shingles, sorted_groups, words
from candlewick.storage import settle

BINS = 128
BLOCK_NODES = 512
_SHIFT = U(57)  # the top seven bits of a hash choose one of 128 bins
_REST = U((1 << 57) - 1)
_EDGES = np.arange(BINS, dtype=U) << _SHIFT


@dataclass(frozen=True)
class NearSpec:
    """width: words of a shingle; percent: least 100 * intersection / union;
    rows: coordinates of a band, of 128 in all."""

    width: int = 5
    percent: int = 80
    rows: int = 4


def _least(hashes: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bins get an element, and the least (round, hash) in each."""
    key = (hashes & ~_REST) | (rounds << U(49)) | ((hashes & _REST) >> U(8))
    key.sort()
    at = np.searchsorted(key, _EDGES)
    at[at == len(key)] = len(key) - 1
    low = key[at]
    return (low >> _SHIFT) == np.arange(BINS, dtype=U), low & _REST


def sketch(elements: np.ndarray) -> np.ndarray:
    """128 coordinates of a non-empty set of mixed hashes.

    In round i every element is thrown into one bin by the round's own hash, and
    a bin keeps the least (round, hash) it saw; rounds go on until no bin is
    empty.  Should bins be empty after 128 rounds, round 128 + j throws all
    elements into bin j, so every coordinate is filled after 256.
    """
    filled, out = _least(elements, np.zeros(len(elements), U))
    done, step = 1, max(1, 1024 // len(elements))
    while not filled.all() and done < BINS:
        these = np.arange(done, min(BINS, done + step), dtype=U)
        salts = _SALTS[these.astype(int)]
        hashes = mix((elements[None, :] ^ salts[:, None]).ravel())
        got, low = _least(hashes, np.repeat(these, len(elements)))
        new = got & ~filled
        out[new] = low[new]
        filled |= new
        done += step
    for j in np.flatnonzero(~filled):
        low = mix(elements ^ _SALTS[BINS + j]).min() >> U(15)
        out[j] = (U(BINS + j) << U(49)) | low
    return out


_SALTS = seeds(2 * BINS, 11)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates of each sketch."""
    parts = sketches.reshape(len(sketches), BINS // rows, rows)
    h = np.broadcast_to(seeds(BINS // rows, 13), parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ parts[:, :, k])
    return h.astype(np.int64)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for block in blocks(column):
        hashes, bounds = shingles(words(block), width)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(hashes[a:b])


def _sketcher(spec: NearSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(BINS, U)
        for batch in batches:
            sizes, classes, rows, full = [], [], [], []
            for s in _sets(batch.column("text"), spec.width):
                sizes.append(len(s))
                full.append(len(s) > 0)
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows.append(sketch(s) if len(s) else nothing)
            if not sizes:
                continue
            sketches = np.stack(rows)
            keys = bands(sketches, spec.rows)[np.array(full)]
            packed = [k.tobytes() for k in bands(sketches, spec.rows).astype(np.int32)]
            marks = [m.tobytes() for m in mix(sketches).astype(np.uint8)]
            per = np.where(full, keys.shape[1], 0)
            offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                    pa.array(marks, pa.binary()),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "class", "bands", "marks", "keys"],
            )

    return run


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [s.tobytes() for s in _sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(packed, pa.binary())], names=["node", "elements"]
            )

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = map(_common, batch.column("left"), batch.column("right"))
            keep = [100 * common >= percent * union for common, union in sizes]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        .mapInArrow(_verifier(percent), "a long, b long")
    )


def _hub_pairs(rows: DataFrame, second: bool) -> DataFrame:
    """Each node with the best of the hubs of its buckets that is in another component.

    A bucket's hub is the node with the most bucket partners in all its bands: among
    varied copies of one text, that text.  The second time it is the best node
    outside the first hub's component.
    """
    rank = F.max(F.struct("score", (-F.col("node")).alias("minus"), "root"))
    hubs = rows.groupBy("band").agg(rank.alias("hub"))
    if second:
        others = rows.join(hubs, "band").where(F.col("root") != F.col("hub.root"))
        hubs = others.groupBy("band").agg(rank.alias("hub"))
    best = F.max(F.struct("hub.score", "hub.minus")).alias("best")
    hub = -F.col("best.minus")
    return (
        rows.join(hubs, "band")
        .where(F.col("root") != F.col("hub.root"))
        .groupBy("node")
        .agg(best)
        .select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b"))
        .distinct()
    )


def _split_buckets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that span several components, with their component."""
    labelled = rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = labelled.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"))
    return labelled.join(spread.where("r < s").select("band"), "band")


def _common(one: pa.Scalar, two: pa.Scalar) -> tuple[int, int]:
    """Sizes of the intersection and the union of two packed sets."""
    a, b = np.frombuffer(one.as_buffer(), U), np.frombuffer(two.as_buffer(), U)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common, len(both) - common


def _compare(percent: int, exact: bool):
    """The likely pairs of each block of a bucket: of different components and
    fitting sizes, with this band as their first common one and sketches that
    agree within 4.75 deviations of ``percent``.  Gives the nodes of such pairs,
    or with ``exact`` the pairs whose full sets are similar enough."""
    p = percent / 100
    least = BINS * (p - 4.75 * np.sqrt(p * (1 - p) / BINS))

    def matrix(part: pa.Table, name: str, kind) -> np.ndarray:
        packed = b"".join(part.column(name).to_pylist())
        return np.frombuffer(packed, kind).reshape(part.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["band", "low", "high"]):
            part = part.combine_chunks()
            node, n, root, side = (part.column(c).to_numpy() for c in ("node", "n", "root", "side"))
            marks = matrix(part, "marks", np.uint8)
            keys = matrix(part, "keys", np.int32)
            band = np.array([part.column("band")[0].as_py()]).astype(np.int32)
            position = int(np.flatnonzero(keys[0] == band[0])[0])
            # A bucket's block with itself, or one block with another.
            crossed = part.column("low")[0].as_py() != part.column("high")[0].as_py()
            used = np.zeros(len(node), bool)
            links = []
            for i in np.flatnonzero(side == 0) if crossed else range(len(node) - 1):
                j = np.flatnonzero(side == 1) if crossed else np.arange(i + 1, len(node))
                j = j[
                    (root[j] != root[i])
                    & (100 * n[j] >= percent * n[i])
                    & (100 * n[i] >= percent * n[j])
                ]
                j = j[(marks[j] == marks[i]).sum(axis=1) >= least]
                j = j[~(keys[j, :position] == keys[i, :position]).any(axis=1)]
                if exact:
                    mine = part.column("elements")[i]
                    for k in j:
                        common, union = _common(mine, part.column("elements")[int(k)])
                        if 100 * common >= percent * union:
                            links.append((node[i], node[k]))
                elif len(j):
                    used[i] = used[j] = True
            if exact:
                made = np.array(links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"]
                )
            elif used.any():
                kept = part.filter(pa.array(used)).select(_MET)
                yield from kept.combine_chunks().to_batches()

    return run


_MET = ["band", "low", "high", "node", "n", "root", "side"]


def _across(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of bucket partners in different components.

    Buckets are cut into blocks of about 512 nodes, apart for the bucket's largest
    component and for all others; every two blocks of which one holds others meet in
    one place, so no task holds more than two, and only linked pairs are written.
    Hubs have left most nodes in the largest component, whose blocks do not meet each
    other.  A first pass on sketches leaves the nodes whose sets are needed.
    """
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("held"))

    def blocks_of(nodes: Column) -> Column:
        return F.ceil(nodes / BLOCK_NODES).cast("int")

    cut = sizes.groupBy("band").agg(
        F.max_by("root", F.struct("held", "root")).alias("largest"),
        blocks_of(F.sum("held") - F.max("held")).alias("others"),
        blocks_of(F.max("held")).alias("rest"),
    )
    is_other = F.col("root") != F.col("largest")
    number = F.xxhash64("node")
    own = F.when(is_other, F.pmod(number, "others")).otherwise(
        F.col("others") + F.pmod(number, "rest")
    )
    last = F.when(is_other, F.col("others") + F.col("rest")).otherwise(F.col("others")) - 1
    met = (
        rows.join(cut, "band")
        .select("band", "node", "n", "root", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0))
        .select(*_MET)
    )
    order = ["band", "low", "high"]

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition(*order).sortWithinPartitions(*order, "node")

    sketches = nodes.select("node", "marks", "keys")
    likely = settle(
        dealt(met.join(sketches, "node")).mapInArrow(
            _compare(percent, False),
            "band long, low int, high int, node long, n long, root long, side int",
        )
    )
    full = likely.join(sketches, "node").join(sets, "node")
    return dealt(full).mapInArrow(_compare(percent, True), "a long, b long")


def near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """Row per document: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of lower-cased words; texts with
    fewer words are one shingle.  Documents whose sets reach ``percent`` are
    linked; component_id is the smallest doc_id reachable and kept marks it.

    * Equal sets are one node, whatever their number.
    * Each bucket of equal bands has a hub, and every node is checked against the
      best hub of its buckets, twice.  Where a bucket then still spans several components, nodes of
      different ones whose sketches agree well enough are checked too.  Pairs
      within a component are never built.
    * A link at the threshold misses all 32 bands of four with probability below
      1e-10 at 85 and 5e-8 at 80 percent, the sketches' test with about 1e-6.

    Null, empty or blank text: n_shingles 0, linked with nothing.  Null doc_id:
    component_id null, kept.  Repeated rows come back once each, and different texts
    with one doc_id are told apart: each has a row and a component of its own, unless
    they are linked.  Other columns are ignored.  An empty table gives an empty one.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")
    )
    rows = settle(
        docs.mapInArrow(
            _sketcher(spec),
            "doc_id long, mark long, n_shingles long, class binary, bands array<long>, marks binary, keys binary",
        )
    ).withColumn("row", F.monotonically_increasing_id())  # of stored rows: the same at every reading
    known = rows.where("doc_id is not null and n_shingles > 0")
    # A node is a class, named by the first of its rows.
    one = F.min(F.struct(F.col("row").alias("node"), "doc_id", "mark")).alias("one")
    nodes = known.groupBy("class").agg(
        one, F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.first("keys").alias("keys")
    ).withColumn("node", F.col("one.node"))
    placed = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    placed = settle(placed.join(shared, "band"))
    partners = placed.select("node").distinct().join(nodes.select("one.*"), "node")
    sets = settle(
        docs.join(partners, ["doc_id", "mark"])
        .select("node", "text")
        .dropDuplicates(["node"])
        .mapInArrow(_set_maker(spec.width), "node long, elements binary")
    )
    scores = placed.groupBy("node").agg(F.sum("members").alias("score"))
    rows_of = settle(placed.join(scores, "node").select("band", "node", "n", "score"))

    pairs = _hub_pairs(rows_of.withColumn("root", F.col("node")), second=False)
    links = settle(_verified(pairs, sets, spec.percent))
    left_over = _split_buckets(rows_of, components(links))
    more = settle(_verified(_hub_pairs(left_over, second=True), sets, spec.percent))
    links = links.unionByName(more)
    left_over = settle(_split_buckets(rows_of, components(links)))
    last = _across(left_over, nodes, sets, spec.percent)
    roots = components(links.unionByName(last))

    of_class = nodes.select("class", "first_id", "node").join(roots, "node", "left")
    of_class = of_class.select("class", "first_id", F.coalesce("root", "node").alias("root"))
    least = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = of_class.join(least, "root").select("class", "component_id")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = rows.select("doc_id", "n_shingles", F.when(~empty, F.col("class")).alias("class"))
    out = out.join(of_class, "class", "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
