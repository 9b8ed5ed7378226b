"""Licence texts in files, by a positional index of their rare words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import ALPHANUMERIC, U, Block, blocks, words

#: Phrases that alone prove a label.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


@dataclass(frozen=True)
class Template:
    """A licence notice, its label, and phrases one of which must stand in a match."""

    label: str
    text: str
    mandatory: tuple[str, ...]


#: Opening notices of public licences.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0",
        ("apache license",),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ("general public license",),
    ),
    Template(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("general public license version 3",),
    ),
    Template(
        "cc-by-nc-4.0",
        "licensed under cc by nc 4 0",
        ("cc by nc 4 0",),
    ),
    Template(
        "cc-by-4.0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use", "binary forms"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
)


@dataclass(frozen=True)
class LicenseSpec:
    """rare: words of highest weight that are looked up in a file for each template;
    share: least share of a template's words in place."""

    templates: tuple[Template, ...] = TEMPLATES
    rare: int = 8
    share: float = 0.7


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(Block(0, data, np.array([0]), np.array([len(data)])), ALPHANUMERIC).hashes


@dataclass
class _Index:
    """Sorted word hashes; postings (template, place) of each; the templates' words."""

    vocabulary: np.ndarray
    postings: list[list[tuple[int, int]]]
    templates: list[np.ndarray]
    mandatory: list[list[np.ndarray]]
    phrases: list[tuple[np.ndarray, str]]

    @classmethod
    def of(cls, spec: LicenseSpec) -> _Index:
        texts = [_word_hashes(t.text) for t in spec.templates]
        phrases = [(_word_hashes(p), label) for p, label in BASE_PHRASES]
        vocabulary = np.unique(np.concatenate(texts + [p for p, _ in phrases]))
        postings: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
        for t, hashes in enumerate(texts):
            for place, h in enumerate(hashes):
                postings[int(np.searchsorted(vocabulary, h))].append((t, place))
        mandatory = [[_word_hashes(m) for m in t.mandatory] for t in spec.templates]
        return cls(vocabulary, postings, texts, mandatory, phrases)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary; -1: not a licence word."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _counter(spec: LicenseSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index.of(spec)
        n = len(index.vocabulary)
        counts = np.zeros(n + 1, np.int64)  # the last one counts documents
        for batch in batches:
            for block in blocks(batch.column("text")):
                found = words(block, ALPHANUMERIC)
                number = index.numbers(found.hashes)
                hit = number >= 0
                pairs = np.unique(found.text_of()[hit] * n + number[hit])
                counts[:n] += np.bincount(pairs % n, minlength=n)
                counts[n] += len(block.starts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n + 1)), pa.array(counts)], names=["word", "files"]
        )

    return run


def word_weights(docs: DataFrame, spec: LicenseSpec) -> np.ndarray:
    """Inverse document frequency of each licence word over all documents.

    At most one row per licence word comes to the driver.
    """
    counted = docs.select("text").mapInArrow(_counter(spec), "word long, files long")
    rows = counted.groupBy("word").agg(F.sum("files").alias("files")).collect()
    size = len(_Index.of(spec).vocabulary)
    files = np.zeros(size + 1)
    for r in rows:
        files[r["word"]] = r["files"]
    return np.log((files[size] + 1) / (files[:size] + 1)) + 1


def _places(hashes: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where ``phrase`` stands in a row of words."""
    n = len(hashes) - len(phrase) + 1
    if n < 1:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for k, h in enumerate(phrase):
        ok &= hashes[k : k + n] == h
    return np.flatnonzero(ok)


def _notices(
    hashes: np.ndarray, place: np.ndarray, number: np.ndarray, index: _Index, weights: np.ndarray, spec: LicenseSpec
) -> dict[int, float]:
    """Share of words in place of each template found; ``place`` and ``number``
    list the file's licence words."""
    distinct = np.unique(number)
    ordered = distinct[np.argsort(-weights[distinct], kind="stable")]
    # Each template has rare words of its own, so no other notice takes its votes.
    left = [spec.rare] * len(index.templates)
    # Each posting of a rare word puts the template's first word at one place.
    votes: dict[tuple[int, int], int] = {}
    for w in ordered.tolist():
        chosen = {t for t, _ in index.postings[w] if left[t]}
        for t in chosen:
            left[t] -= 1
        postings = [(t, at) for t, at in index.postings[w] if t in chosen]
        if not postings:
            continue
        for p in place[number == w].tolist():
            for template, at in postings:
                votes[template, p - at] = votes.get((template, p - at), 0) + 1
    found: dict[int, float] = {}
    for (template, start), count in votes.items():
        text = index.templates[template]
        if count < min(2, len(text)):
            continue
        low, high = max(0, start), min(len(hashes), start + len(text))
        share = float((hashes[low:high] == text[low - start : high - start]).sum()) / len(text)
        if share < spec.share or share <= found.get(template, 0.0):
            continue
        window = hashes[low:high]
        if any(len(_places(window, m)) for m in index.mandatory[template]):
            found[template] = share
    return found


_RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double"
)
_NAMES = [part.split()[0] for part in _RESULT.split(", ")]


def _scanner(spec: LicenseSpec, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index.of(spec)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for block in blocks(batch.column("text")):
                found = words(block, ALPHANUMERIC)
                number = index.numbers(found.hashes)
                owner = found.text_of()
                base: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in index.phrases:
                    at = _places(found.hashes, phrase)
                    at = at[owner[at] == owner[at + len(phrase) - 1]]
                    for p in at.tolist():
                        i = int(owner[p])
                        base.setdefault(i, []).append((p - int(found.first[i]), label))
                hit = np.flatnonzero(number >= 0)
                bounds = np.searchsorted(hit, found.first)
                for i in range(len(block.starts)):
                    first, end = int(found.first[i]), int(found.first[i + 1])
                    mine = hit[bounds[i] : bounds[i + 1]]
                    notices: dict[int, float] = {}
                    if len(mine) > 1:
                        notices = _notices(
                            found.hashes[first:end], mine - first, number[mine], index, weights, spec
                        )
                    proven = base.get(i, [])
                    names = {label for _, label in proven}
                    places = [p for p, _ in proven]
                    more = {spec.templates[t].label for t in notices}
                    score = 1.0 if proven else max(notices.values(), default=0.0)
                    row = (end - first, len(places), min(places, default=None), max(places, default=None))
                    row += (",".join(sorted(names)), ",".join(sorted(names | more)), score)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=_NAMES)

    return run


def scan_licenses(docs: DataFrame, spec: LicenseSpec = LicenseSpec()) -> DataFrame:
    """Row per document: n_words, the base phrases' places and labels, all labels, score.

    Words are runs of letters and digits (bytes beyond ASCII included), A-Z
    lower-cased.  Base labels come from consecutive words.  The method looks up a
    file's ``rare`` words of highest inverse document frequency for each template,
    lets their postings vote for where a template would start, and accepts a start at
    which ``share`` of the template's words are in place and one of its mandatory
    phrases stands among them.  score: 1 with a base label, else the best share.

    Null or empty text: no words, no labels, score 0, first_word and last_word
    null.  Repeated rows and a null doc_id come back as they are; extra columns
    are ignored.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scanner(spec, word_weights(docs, spec)), _RESULT)
