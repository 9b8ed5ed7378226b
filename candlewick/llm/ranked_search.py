"""Ranked lexical search without random access (NRA) over impact-sorted postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.llm.bitfilter import key_filter, may_hold
from candlewick.llm.textscan import ALPHANUMERIC, blocks, ranges, words
from candlewick.storage import settle


@dataclass(frozen=True)
class SearchSpec:
    """top: documents an item; block_terms: item terms that go to every task at once
    (more items make more rounds over the index); shard: documents ranked at once;
    step: postings of a list read in the first round, doubled in each further one."""

    top: int = 10
    block_terms: int = 1 << 18
    shard: int = 1 << 15
    shard_postings: int = 1 << 22
    step: int = 256


_INDEX = "doc_id long, n long, terms array<long>, tfs array<int>"


def _lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _counted(column: pa.Array, table: np.ndarray | None):
    """Per block: first row, words of each text, and its distinct terms (of those
    that may pass ``table``) with their counts, as bounds, terms, counts."""
    for block in blocks(column):
        found = words(block, ALPHANUMERIC)
        owner, hashes = found.text_of(), found.hashes
        if table is not None:
            on = may_hold(table, hashes)
            owner, hashes = owner[on], hashes[on]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(owner)))
        bounds = np.searchsorted(owner[at], np.arange(len(block.starts) + 1))
        yield block.first, np.diff(found.first), bounds, hashes[at].astype(np.int64), tf


def _indexer(wanted: Broadcast):
    """Documents with a term: their length and the item terms in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n, bounds, terms, tf in _counted(batch.column("text"), wanted.value):
                rows = np.flatnonzero(n > 0)
                sizes = np.diff(bounds)
                take = ranges(bounds[:-1][rows], sizes[rows])
                cuts = np.concatenate([[0], np.cumsum(sizes[rows])])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(first + rows)),
                        pa.array(n[rows].astype(np.int64)),
                        _lists(cuts, terms[take], pa.int64()),
                        _lists(cuts, tf[take], pa.int32()),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for first, n, bounds, terms, tf in _counted(batch.column("text"), None):
            owner = np.repeat(np.arange(len(n)), np.diff(bounds)) + first
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner)), pa.array(terms), pa.array(tf.astype(np.int64))],
                names=["item_id", "term", "times"],
            )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, summed up per batch."""
    for batch in batches:
        terms, files = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(files.astype(np.int64))], names=["term", "df"])


@dataclass
class _Queries:
    """Items with their terms: number among ``terms`` (sorted) and weight times occurrences."""

    terms: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]


class Shard:
    """Postings of a bounded number of documents, each term's sorted by falling
    impact; impact: what a unit of weight scores in the document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 queries: _Queries, documents: int, total: int):
        norm = 25 + (75 * lengths * documents) // total
        owner = np.repeat(np.arange(len(ids)), sizes)
        number = np.searchsorted(queries.terms, terms)
        number[number == len(queries.terms)] = 0
        on = queries.terms[number] == terms if len(queries.terms) else np.zeros(len(terms), bool)
        owner, number, tf = owner[on], number[on], tfs[on].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[owner])
        order = np.lexsort((-impact, number))
        self.ids, self.documents, self.impacts = ids, owner[order], impact[order]
        self.bounds = np.searchsorted(number[order], np.arange(len(queries.terms) + 1))


def _order(ids: np.ndarray) -> np.ndarray:
    """Document ids as sort keys; those without an id come last."""
    return np.where(ids == _NO_ID, np.iinfo(np.int64).max, ids)


_NO_ID = np.iinfo(np.int64).min


def best_of(shard: Shard, numbers: np.ndarray, weights: np.ndarray, top: int, least: int, step: int):
    """(document, score) of the ``top`` documents of a shard for one item, those
    scoring less than ``least`` left out; equal scores by document id.

    Round by round the next postings of every list are read in order of impact.
    A document's score is at least what was read of it, and at most that plus the
    present impact of each list it was not yet seen in.  First the reading narrows
    down who can be among the first (ties included); then it goes on until the
    scores of those are known, that is no list they were not seen in has impact left.
    """
    lists = [(int(shard.bounds[t]), int(shard.bounds[t + 1]), int(w)) for t, w in zip(numbers, weights, strict=True)]
    lists = [x for x in lists if x[0] < x[1] and x[2] > 0]
    if not lists:
        return []
    lower = np.zeros(len(shard.ids), np.int64)
    seen = np.zeros((len(lists), len(shard.ids)), bool)
    at = [a for a, _, _ in lists]
    front = np.array([int(shard.impacts[a]) * w for a, _, w in lists], np.int64)
    active: np.ndarray | None = None  # documents that may be among the first; none: all, unseen ones too
    while True:
        if active is None:
            touched = np.flatnonzero(lower)
            unseen = int(front.sum())
        else:
            touched, unseen = active, 0
        low = lower[touched]
        bound = max(least, 1)
        if len(low) >= top:
            bound = max(bound, int(np.partition(low, len(low) - top)[len(low) - top]))
        if active is not None or unseen < bound:
            # A document no list has shown yet cannot be among the first any more.
            if len(touched) > 64:
                upper = low + front.sum() - _seen_fronts(seen, front, touched)
                touched = touched[upper >= bound]
            active = touched
            if not len(active):
                return []
            open_lists = np.flatnonzero(front)
            if not len(open_lists) or seen[np.ix_(open_lists, active)].all():
                break
        elif not front.any():
            active = touched
            break
        for k, (_, end, w) in enumerate(lists):
            if front[k] == 0:
                continue
            to = min(at[k] + step, end)
            docs = shard.documents[at[k] : to]
            lower[docs] += shard.impacts[at[k] : to] * w
            seen[k, docs] = True
            at[k] = to
            front[k] = int(shard.impacts[to]) * w if to < end else 0
        step *= 2
    score = lower[active]
    keep = score >= max(least, 1)
    active, score = active[keep], score[keep]
    order = np.lexsort((_order(shard.ids[active]), -score))[:top]
    return list(zip(shard.ids[active[order]].tolist(), score[order].tolist(), strict=True))


def _seen_fronts(seen: np.ndarray, front: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For each document the present impacts of the lists that have shown it, summed."""
    total = np.zeros(len(documents), np.int64)
    for k in np.flatnonzero(front):
        total += np.where(seen[k, documents], front[k], 0)
    return total


def _ranker(queries: Broadcast, documents: int, total: int, spec: SearchSpec):
    """Each task's best documents of every item, shard by shard; what earlier shards
    gave is the least that a later one's documents need."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, spec.shard):
                part = batch.slice(start, spec.shard)
                size = len(part.column("terms").flatten())
                if held and (rows + part.num_rows > spec.shard or postings + size > spec.shard_postings):
                    yield pa.Table.from_batches(held)
                    held, rows, postings = [], 0, 0
                held.append(part)
                rows, postings = rows + part.num_rows, postings + size
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[int, int]]] = [[] for _ in queries.value.items]
        for table in shards(batches):
            table = table.combine_chunks()
            shard = Shard(
                table["doc_id"].fill_null(int(_NO_ID)).to_numpy(), table["n"].to_numpy(),
                np.concatenate([c.value_lengths().to_numpy() for c in table["terms"].chunks]),
                np.concatenate([c.flatten().to_numpy() for c in table["terms"].chunks]),
                np.concatenate([c.flatten().to_numpy() for c in table["tfs"].chunks]),
                queries.value, documents, total,
            )
            for i, (_, numbers, weights) in enumerate(queries.value.items):
                known = found[i]
                least = known[spec.top - 1][1] if len(known) >= spec.top else 1
                more = best_of(shard, numbers, weights, spec.top, least, spec.step)
                if more:
                    known = sorted(known + more, key=lambda x: (-x[1], x[0] == _NO_ID, x[0]))
                    found[i] = known[: spec.top]
        rows = [(queries.value.items[i][0], d, s) for i, best in enumerate(found) for d, s in best]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        columns[1] = pa.array([None if r[1] == _NO_ID else r[1] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return run


def _query_blocks(weighted: DataFrame, spec: SearchSpec) -> Iterator[_Queries]:
    """Items in blocks of about ``block_terms`` terms, never more than one block at a time."""
    def packed(items: list[tuple[int, list, list]]) -> _Queries:
        terms = np.unique(np.concatenate([np.array(t, np.int64) for _, t, _ in items]))
        return _Queries(
            terms,
            [(i, np.searchsorted(terms, np.array(t, np.int64)), np.array(w, np.int64)) for i, t, w in items],
        )

    held: list[tuple[int, list, list]] = []
    size = 0
    per_item = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    for row in per_item.toLocalIterator():
        if held and size + len(row["terms"]) > spec.block_terms:
            yield packed(held)
            held, size = [], 0
        held.append((row["item_id"], [t["term"] for t in row["terms"]], [t["weight"] for t in row["terms"]]))
        size += len(row["terms"])
    if held:
        yield packed(held)


def search(docs: DataFrame, items: DataFrame, spec: SearchSpec = SearchSpec()) -> DataFrame:
    """Each item's ``top`` best documents: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters and digits (bytes beyond ASCII included), A-Z
    lower-cased.  A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a
    document's norm m = 25 + (75 n N) div L; a document scores for each term of the
    item, repeats included, weight * ((10^9 tf) div (1000 tf + 8 m)).  Only scores
    above 0 count; equal ones come by rising doc_id.

    The index holds the item terms of every document.  Each task takes its documents
    in shards of bounded size, sorts every term's postings by impact and ranks the
    shard for every item without random access (``best_of``); the tasks' best are
    ranked again by Spark.  Terms are filtered by a filter of fixed size and items go
    to the tasks in blocks of bounded size, so neither grows with the tables.

    Null or empty texts have no terms and count nowhere; a document without id counts
    and is ranked, behind those of equal score; repeated documents are ranked each;
    an item repeated with one id is one item of all its terms; items without an id or
    terms give no rows; extra columns are ignored; empty tables give no rows.
    The index, N, L and df are computed while the result is built.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = settle(
        items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .where("item_id is not null")
        .mapInArrow(_item_terms, "item_id long, term long, times long")
        .groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    )
    context = docs.sparkSession.sparkContext
    passes = context.broadcast(key_filter(wanted.select(F.col("term").alias("key"))))
    index = settle(docs.mapInArrow(_indexer(passes), _INDEX).hint("rebalance"))
    whole = index.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    empty = "item_id long, doc_id long, score long"
    result = docs.sparkSession.createDataFrame([], empty)
    if whole["documents"]:
        n = whole["documents"]
        df = index.mapInArrow(_document_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
        weighted = wanted.join(df, "term").select("item_id", "term", weight.alias("weight"))
        parts = []
        for queries in _query_blocks(weighted, spec):
            parts.append(index.mapInArrow(_ranker(context.broadcast(queries), n, whole["words"], spec), empty))
            if len(parts) == 16:  # keep the plan of many blocks short
                result, parts = settle(_united([result, *parts])), []
        result = _united([result, *parts])
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = result.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= spec.top).select("item_id", "rank", "doc_id", "score")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
