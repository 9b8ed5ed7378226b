"""Frequent phrases of each language and how strongly their words hold together,
from a weighted de Bruijn graph of word grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.llm.bitfilter import key_filter, may_hold
from candlewick.llm.textscan import Block, U, Words, blocks, byte_class, mix, seeds, words
from candlewick.storage import settle

UNKNOWN = "und"
_BREAK = byte_class(lambda b: chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = byte_class(lambda b: not _BREAK[b] and b not in (0x20, 0x09))


@dataclass(frozen=True)
class PhraseSpec:
    """least: occurrences of a phrase; words: of the longest one; top: rows a language."""

    least: int = 100
    words: int = 5
    top: int = 2000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Words, np.ndarray, np.ndarray, list[str]]]:
    """Blocks with their words, each word's id (of language and word), which words
    the next one of the same piece follows, and the rows' languages."""
    for batch in batches:
        langs = [v if v is not None else UNKNOWN for v in batch.column("lang").to_pylist()]
        names = sorted(set(langs))
        data = np.frombuffer("".join(names).encode() or b" ", np.uint8)
        ends = np.cumsum([len(v.encode()) for v in names], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        whole = byte_class(lambda b: True)
        salts = np.array(
            [words(Block(0, data[a:b], np.array([0]), np.array([b - a])), whole, False).hashes[:1].sum(dtype=U)
             for a, b in zip(starts, ends, strict=True)],
            dtype=U,
        )
        of_row = mix(salts[np.searchsorted(names, langs)] if names else salts)
        for block in blocks(batch.column("text")):
            found = words(block, _WORD)
            owner = found.text_of()
            ids = np.maximum(mix(found.hashes ^ of_row[block.first + owner]), U(1))
            breaks = np.concatenate([[0], np.cumsum(_BREAK[block.data])])
            follows = np.zeros(len(ids), bool)
            follows[:-1] = (owner[1:] == owner[:-1]) & (breaks[found.starts[1:]] == breaks[found.ends[:-1]])
            yield block, found, ids, follows, langs


_WORDS = "lang string, id long, f long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, and a row (id 0) of all words of a language."""
    for block, found, ids, _, langs in _scan(batches):
        name, first, count = np.unique(ids, return_index=True, return_counts=True)
        owner = block.first + np.searchsorted(found.first, first, side="right") - 1
        of_lang: dict[str, int] = {}
        for i, n in enumerate(np.diff(found.first).tolist(), block.first):
            of_lang[langs[i]] = of_lang.get(langs[i], 0) + n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs[i] for i in owner.tolist()] + list(of_lang), pa.string()),
                pa.array(np.concatenate([name.astype(np.int64), np.zeros(len(of_lang), np.int64)])),
                pa.array(np.concatenate([count, np.array(list(of_lang.values()), np.int64)])),
            ],
            names=["lang", "id", "f"],
        )


def _spellings(wanted: Broadcast):
    """Letters of the words that pass the filter ``wanted``, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
        for batch in batches:
            known: dict[int, str] = {}
            for block, found, ids, _, _ in _scan(iter([batch])):
                at = np.flatnonzero(may_hold(wanted.value, ids))
                name, first = np.unique(ids[at], return_index=True)
                at = at[first]
                for key, a, b in zip(name.tolist(), found.starts[at].tolist(), found.ends[at].tolist(), strict=True):
                    if key not in known:
                        known[key] = block.data[a:b].tobytes().translate(fold).decode(errors="replace")
            keys = np.array(list(known), U).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(known.values()), pa.string())], names=["id", "word"])

    return run


def _gram_keys(ids: np.ndarray, width: int) -> np.ndarray:
    """Keys of 40 bits of the ``width`` words from each word on (0 where there are
    fewer): grams that share one are counted together, so at worst a rare one passes."""
    factor = seeds(width, 40 + width) | U(1)
    out = np.zeros(len(ids), U)
    n = len(ids) - width + 1
    if n > 0:
        out[:n] = mix(sum(ids[k : n + k] * factor[k] for k in range(width))) >> U(24)
    return out


def _allowed(ids: np.ndarray, follows: np.ndarray, filters: list[np.ndarray], width: int) -> np.ndarray:
    """Words from which on ``width`` words stand in one piece, all of whose words,
    pairs and so on, as far as there are filters, may be frequent."""
    ok = may_hold(filters[0], ids)
    for k in range(2, width + 1):
        # Both grams of one word less must do; the last link is the piece's.
        longer = ok & follows if k == 2 else ok.copy()
        longer[:-1] &= ok[1:]
        longer[-1:] = False
        if k <= len(filters):
            at = np.flatnonzero(longer)
            longer[at] = may_hold(filters[k - 1], _gram_keys(ids, k)[at])
        ok = longer
    return ok


def _gram_counts(filters: list[Broadcast], width: int):
    """Occurrences of the grams of ``width`` words whose parts may all be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        for _, _, ids, follows, _ in _scan(batches):
            keys = _gram_keys(ids, width)[_allowed(ids, follows, tables, width)]
            key, count = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int64)), pa.array(count.astype(np.int64))], names=["key", "f"]
            )

    return run


#: Distinct grams a task adds up before it hands them on.
_HELD = 1 << 19


def _edges(filters: list[Broadcast], spec: PhraseSpec):
    """Longest grams: at each word the ``spec.words`` words from it on, fewer (the
    rest zero) where the piece, cut at grams that are not frequent, ends before.
    Grams of one word are left out: words are counted already."""
    names = _columns(spec)
    factor = seeds(spec.words, 43) | U(1)

    def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        whole, count = np.concatenate(grams), np.concatenate(counts)
        _, first, at = np.unique(
            mix((whole * factor).sum(axis=1, dtype=U)), return_index=True, return_inverse=True
        )
        total = np.zeros(len(first), np.int64)
        np.add.at(total, at, count)
        return whole[first], total

    def rows(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(grams[:, k]).view(np.int64)) for k in range(spec.words)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*names, "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for _, _, ids, follows, _ in _scan(batches):
            at = np.flatnonzero(_allowed(ids, follows, tables, 2))
            grams = np.zeros((len(at), spec.words), U)
            if len(at):
                grams[:, 0], grams[:, 1] = ids[at], ids[at + 1]
            for k in range(3, spec.words + 1):
                on = np.flatnonzero(_allowed(ids, follows, tables, k)[at])
                grams[on, k - 1] = ids[at[on] + k - 1]
            held.append(grams)
            counts.append(np.ones(len(at), np.int64))
            if sum(map(len, counts)) > 2 * _HELD:
                grams, count = merged(held, counts)
                held, counts = [grams], [count]
                if len(count) > _HELD:
                    yield rows(grams, count)
                    held, counts = [], []
        if held:
            yield rows(*merged(held, counts))

    return run


def _columns(spec: PhraseSpec) -> list[str]:
    return [f"w{k}" for k in range(1, spec.words + 1)]


#: Lengths of grams that are counted ahead of the edges, to cut the pieces.
_AHEAD = 3


def phrase_counts(docs: DataFrame, spec: PhraseSpec) -> tuple[DataFrame, DataFrame]:
    """Frequent words (lang, id, f; id 0: all words of a language) and frequent
    phrases of two words or more (gram: array of ids, f), both stored.

    Only longest grams are counted in the texts: they are the edges of the graph,
    from the node of a gram's first words to that of its last.  The count of a
    shorter gram is what flows out of its node, plus the pieces that end with it.
    """
    context = docs.sparkSession.sparkContext
    counted = docs.mapInArrow(_word_counts, _WORDS).groupBy("id", "lang").agg(F.sum("f").alias("f"))
    frequent = settle(counted.where((F.col("f") >= spec.least) | (F.col("id") == 0)))
    filters = [context.broadcast(key_filter(frequent.where("id != 0").select(F.col("id").alias("key"))))]
    for width in range(2, min(_AHEAD, spec.words) + 1):
        grams = docs.mapInArrow(_gram_counts(filters, width), "key long, f long").groupBy("key")
        often = grams.agg(F.sum("f").alias("f")).where(F.col("f") >= spec.least)
        filters = [*filters, context.broadcast(key_filter(often.select("key")))]
    names = _columns(spec)
    schema = ", ".join(f"{c} long" for c in [*names, "f"])
    edges = docs.mapInArrow(_edges(filters, spec), schema)
    flow = settle(edges.groupBy(*names).agg(F.sum("f").alias("f")))
    levels = []
    for k in range(spec.words, 1, -1):
        if k < spec.words:  # rows that end at k words are the corrections for piece ends
            flow = flow.groupBy(*names[:k]).agg(F.sum("f").alias("f"))
        gram = F.array(*names[:k]).alias("gram")
        levels.append(flow.where((F.col(names[k - 1]) != 0) & (F.col("f") >= spec.least)).select(gram, "f"))
    return frequent, settle(reduce(DataFrame.unionByName, levels))


def _compacted(grams: DataFrame) -> DataFrame:
    """Grams without those whose whole flow passes through one longer gram: such a
    node has a single way on, or a single way in, and merges with it.

    A gram inside any longer one of equal count is also inside one that is a word
    longer, since counts never grow with length; so one step sees all.
    """
    n = F.size("gram")
    inner = F.array(F.slice("gram", 1, n - 1), F.slice("gram", 2, n - 1))
    ways = grams.where(n > 2).select(F.explode(inner).alias("gram"), F.col("f").alias("through"))
    most = ways.groupBy("gram").agg(F.max("through").alias("through"))
    joined = grams.join(most, "gram", "left")
    return joined.where(F.col("through").isNull() | (F.col("through") < F.col("f"))).select("gram", "f")


def collocations(docs: DataFrame, spec: PhraseSpec = PhraseSpec()) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts split into pieces at ``[.,;:!?]`` and line breaks,
    pieces into words at blanks and tabs.  A phrase of two to ``words`` words needs
    ``least`` occurrences (a) in its language; n is the language's number of words,
    l and r are the counts of the two parts of the cut with the lowest score,
    floor(1000 a n / (l r)), the first of equal ones.  Phrases of which every
    occurrence lies in one longer phrase are left out.  Order: score, a (both
    descending), phrase.

    A phrase is frequent only if its words, pairs and triples of words are, so the
    texts are cut at others before edges are counted: by filters of fixed size, which
    let some rare ones through and stop no frequent one.

    Null lang counts as ``und``; null or empty texts have no words; repeated rows
    count each; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    frequent, grams = phrase_counts(docs, spec)
    singles = frequent.where("id != 0")
    totals = frequent.where("id = 0").select("lang", F.col("f").alias("n"))
    chosen = _compacted(grams)
    n = F.size("gram")
    cuts = chosen.select(
        "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k")
    ).select(
        "gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("left"),
        F.slice("gram", F.col("k") + 1, n - F.col("k")).alias("right"),
    )
    counts = grams.unionByName(singles.select(F.array("id").alias("gram"), "f"))
    head = singles.select(F.col("id").alias("head"), "lang").join(totals, "lang")
    scored = (
        cuts.join(counts.select(F.col("gram").alias("left"), F.col("f").alias("l")), "left")
        .join(counts.select(F.col("gram").alias("right"), F.col("f").alias("r")), "right")
        .join(head, F.col("gram")[0] == F.col("head"))
        .withColumn("above", F.expr("cast(1000 * cast(a as decimal(19,0)) as decimal(38,0)) * cast(n as decimal(38,0))"))
        .withColumn("below", F.expr("cast(l as decimal(19,0)) * cast(r as decimal(19,0))"))
        .withColumn("score", F.expr("above div below"))
        .groupBy("gram", "lang", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("gram", "lang", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    # A language's phrases are first ranked in parts, so that no task sorts all of
    # them; equal ones all stay until they are spelled.
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        near = near.withColumn("at", F.rank().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= spec.top)
    near = settle(near.drop("part", "at"))
    used = docs.sparkSession.sparkContext.broadcast(key_filter(near.select(F.explode("gram").alias("key"))))
    named = docs.mapInArrow(_spellings(used), "id long, word string").groupBy("id", "word").count().drop("count")
    phrases = (
        near.select("gram", F.posexplode("gram").alias("at", "id"))
        .join(named, "id")
        .groupBy("gram")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
        .select("gram", F.array_join(F.col("parts.word"), " ").alias("phrase"))
    )
    ranked = near.join(phrases, "gram").withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, F.asc("phrase"))).cast("long")
    )
    return ranked.where(F.col("rank") <= spec.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
