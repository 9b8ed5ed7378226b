"""Language identification in two steps: a family first, then the language in it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import LOWER, blocks
from candlewick.storage import settle

#: Language codes by family.  A code that is not listed is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNDETERMINED = "und"
DIMENSIONS = 1 << 12
_ROWS = 256


@dataclass(frozen=True)
class LanguageSpec:
    """sample: documents per language to learn from, on average, at most;
    epochs and penalty: of the vector machines."""

    sample: int = 400
    epochs: int = 20
    penalty: float = 10.0
    family_of: dict[str, str] = field(
        default_factory=lambda: {c: f for f, codes in FAMILIES.items() for c in codes}
    )


@dataclass
class LanguageModel:
    """families: name -> log frequencies; pairs: (a, b) -> weights with a bias
    at the end, positive for a; languages: family -> its languages."""

    families: dict[str, np.ndarray]
    priors: dict[str, float]
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of hashed byte pairs and triples, letters lower-cased, all other
    ASCII characters taken as one blank; a row of counts for each text."""
    fold = np.array(
        [b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER.tolist()], dtype=np.uint32
    )
    for block in blocks(column, rows=_ROWS):
        letters = fold[block.data]
        rows = len(block.starts)
        owner = np.repeat(np.arange(rows, dtype=np.int64), block.ends - block.starts)
        counts = np.zeros(rows * DIMENSIONS, np.int64)
        if len(letters) > 1:
            for width, factor in ((2, 2654435761), (3, 2246822519)):
                n = len(letters) - width + 1
                if n < 1:
                    continue
                key = np.zeros(n, np.uint32)
                for k in range(width):
                    key = (key << np.uint32(8)) | letters[k : k + n]
                key *= np.uint32(factor)
                slot = (key >> np.uint32(20)).astype(np.int64)
                whole = owner[:n] == owner[width - 1 :]
                counts += np.bincount(
                    (slot + owner[:n] * DIMENSIONS)[whole], minlength=len(counts)
                )
        yield block.first, counts.reshape(rows, DIMENSIONS)


def _features(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative counts: rows of length one, or zero."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, counts in _grams(batch.column("text")):
            packed = [row.tobytes() for row in counts.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(counts)),
                    batch.column("lang").slice(first, len(counts)),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "lang", "counts"],
            )


def separating_weights(x: np.ndarray, y: np.ndarray, epochs: int, penalty: float) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; y is +1 or -1.

    The bias is the weight of a constant last feature.  Classes weigh alike.
    """
    x = np.hstack([x, np.full((len(x), 1), 0.5, np.float32)]).astype(np.float64)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    bound = penalty / (2 * share)
    norms = np.maximum((x * x).sum(axis=1), 1e-12)
    alpha = np.zeros(len(x))
    w = np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = (1.0 - y[i] * (w @ x[i])) / norms[i]
            new = min(max(alpha[i] + step, 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _trainer(spec: LanguageSpec):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        x = _features(np.stack([np.frombuffer(c, np.int32) for c in rows["counts"]]))
        y = np.where(rows["lang"] == key[0], 1.0, -1.0)
        w = separating_weights(x, y, spec.epochs, spec.penalty)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "weights": [w.tobytes()]})

    return run


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.float64) for c in rows["counts"])
    return pd.DataFrame({"lang": [key[0]], "n": [len(rows)], "counts": [total.tobytes()]})


def train(labelled: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang); null languages and texts are left out.

    A bounded sample (``spec.sample`` documents per language on average, chosen by
    hash) gives byte pair and triple counts.  Families get multinomial frequencies;
    each pair of languages in a family one vector machine, trained in its own task.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return LanguageModel({}, {}, {}, {})
    share = F.create_map(*[F.lit(v) for c, n in per.items() for v in (c, min(1.0, spec.sample / n))])
    dice = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    sample = settle(
        labelled.where(dice < share[F.col("lang")]).mapInArrow(
            _sampler, "doc_id long, lang string, counts binary"
        )
    )
    sums = {
        r["lang"]: (r["n"], np.frombuffer(bytes(r["counts"])))
        for r in sample.groupBy("lang").applyInPandas(_summed, "lang string, n long, counts binary").collect()
    }
    languages: dict[str, list[str]] = {}
    for code in sorted(sums):
        languages.setdefault(spec.family_of.get(code, code), []).append(code)
    families, priors = {}, {}
    for family, codes in languages.items():
        # Languages weigh alike inside a family, whatever their share of the text.
        shares = sum((sums[c][1] + 0.05) / (sums[c][1] + 0.05).sum() for c in codes)
        families[family] = np.log(shares / shares.sum())
        priors[family] = 0.0
    chosen = [p for codes in languages.values() for p in combinations(codes, 2)]
    pairs: dict[tuple[str, str], np.ndarray] = {}
    if chosen:
        listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in chosen])
        of_pairs = (
            sample.withColumn("p", F.explode(listed))
            .where((F.col("lang") == F.col("p.a")) | (F.col("lang") == F.col("p.b")))
            .select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "doc_id", "lang", "counts")
        )
        fitted = of_pairs.groupBy("a", "b").applyInPandas(
            _trainer(spec), "a string, b string, weights binary"
        )
        pairs = {(r["a"], r["b"]): np.frombuffer(bytes(r["weights"])) for r in fitted.collect()}
    return LanguageModel(families, priors, languages, pairs)


def predict(model: LanguageModel, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score (0 to 1) of each row of counts."""
    n = len(counts)
    names = list(model.families)
    tables = np.stack([model.families[f] for f in names], axis=1)
    x = _features(counts)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # The evidence grows with the text's length, but less than its grams do: they repeat.
    evidence = (counts.astype(np.float32) @ tables.astype(np.float32)) / np.sqrt(total)
    evidence -= evidence.max(axis=1, keepdims=True)
    chance = np.exp(evidence)
    chance /= chance.sum(axis=1, keepdims=True)
    winner = evidence.argmax(axis=1)
    label = np.full(n, UNDETERMINED, dtype=object)
    score = np.zeros(n)
    for k, family in enumerate(names):
        rows = np.flatnonzero(winner == k)
        codes = model.languages[family]
        if not len(rows):
            continue
        votes = np.zeros((len(rows), len(codes)))
        least = np.full((len(rows), len(codes)), np.inf)
        for (a, b), w in model.pairs.items():
            if a in codes and b in codes:
                margin = x[rows] @ w[:-1].astype(np.float32) + 0.5 * w[-1]
                i, j = codes.index(a), codes.index(b)
                votes[:, i] += (margin >= 0) + 1e-3 * np.tanh(margin)
                votes[:, j] += (margin < 0) - 1e-3 * np.tanh(margin)
                least[:, i] = np.minimum(least[:, i], margin)
                least[:, j] = np.minimum(least[:, j], -margin)
        best = votes.argmax(axis=1)
        label[rows] = np.array(codes, dtype=object)[best]
        with np.errstate(over="ignore"):
            sure = 1 / (1 + np.exp(-3 * np.minimum(least[np.arange(len(rows)), best], 50)))
        score[rows] = chance[rows, k] * sure
    return label, np.clip(score, 0.0, 1.0)


def _labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            label = np.full(batch.num_rows, UNDETERMINED, dtype=object)
            score = np.zeros(batch.num_rows)
            if model.families:
                for first, counts in _grams(batch.column("text")):
                    to = first + len(counts)
                    label[first:to], score[first:to] = predict(model, counts)
            wordless = ~batch.column("_letters").to_numpy(zero_copy_only=False)
            label[wordless], score[wordless] = UNDETERMINED, 0.0
            kept = batch.drop_columns(["_letters"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())],
                names=[*kept.schema.names, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from each whole ``text``.

    The family with the likeliest grams comes first; inside it every pair of
    languages votes, ties going to the larger margins.  A text that is null or
    has no letter gets ``und`` and 0, as all do where nothing was learned.  All
    columns and rows are kept; ones called lang_pred, score or _letters are replaced.
    """
    kept = docs.drop("lang_pred", "score", "_letters")
    ready = kept.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return ready.mapInArrow(_labeller(shared), schema + "lang_pred string, score double")


def held_out(doc_id) -> Column:
    """Documents never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
