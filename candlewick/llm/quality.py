"""Line-first cleaning of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.textscan import NO_SPACE, U, blocks, byte_class, mix, seeds, words

_SYMBOLS = byte_class(lambda b: chr(b) in "#*$%&|<>")

#: Phrases that mark a line as page furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "javascript is disabled",
    "enable javascript",
    "subscribe to our newsletter",
    "skip to content",
    "click here",
    "lorem ipsum",
)
#: Separators of the entries of a navigation line.
_NAVIGATION = re.compile(r"\s[|»›·>/]\s|\s[|»›·>/]$|\t")
_SIGNS = frozenset("#*$%&|<>!~^{}=\\")
_TERMINAL = (".", "!", "?", ":", ";", '"', "'", ")", "…", "”", "。")


@dataclass(frozen=True)
class QualitySpec:
    """least_words and repeat_percent: of the base rule; window: words of a
    repeated stretch; kept_percent: least share of a text's characters that must
    survive the line rules."""

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    kept_percent: int = 50
    separators: int = 2
    fragment_words: int = 2


def line_fault(line: str, spec: QualitySpec) -> str | None:
    """The rule that a line breaks, or none.

    navigation: several entries between separators; boilerplate: a known phrase;
    symbols: a tenth or more are signs; punctuation: a fragment of a
    word or two without an end mark.  Blank lines break none.
    """
    text = line.strip()
    if not text:
        return None
    marks = _NAVIGATION.findall(text)
    if len(marks) >= spec.separators and 2 * len(marks) >= len(text.split()) // 2:
        return "navigation"
    low = text.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    if len(text) >= 10 and sum(map(text.count, _SIGNS)) * 10 >= len(text):
        return "symbols"
    if not text.endswith(_TERMINAL) and len(text.split()) <= spec.fragment_words:
        return "punctuation"
    return None


def _repeat_words(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words in ``width``-word windows that stand twice or more in their text."""
    rows = len(first) - 1
    n = len(hashes)
    out = np.zeros(rows, np.int64)
    if n < width:
        return out
    factor = seeds(width, 31) | U(1)
    h = np.zeros(n - width + 1, U)
    for k in range(width):
        h += hashes[k : k + len(h)] * factor[k]
    owner = np.repeat(np.arange(rows), np.diff(first))
    inside = np.flatnonzero(owner[: len(h)] == owner[width - 1 :])
    h = mix(mix(h[inside]) ^ (owner[inside].astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + width, -1)
    covered = np.cumsum(depth[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[first[1:]] - sums[first[:-1]]


def _measure(spec: QualitySpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for block in blocks(batch.column("text")):
                data = block.data
                rows = len(block.starts)
                found = words(block, fold=False)
                repeats = _repeat_words(found.hashes, found.first, spec.window)
                # Characters start at bytes that continue no other.
                chars = np.r_[0, np.cumsum(NO_SPACE[data] & ((data & 0xC0) != 0x80))]
                signs = np.r_[0, np.cumsum(_SYMBOLS[data])]
                for i in range(rows):
                    a, b = int(block.starts[i]), int(block.ends[i])
                    n_words = int(found.first[i + 1] - found.first[i])
                    lines = block.text(i).split(b"\n")
                    seen: set[bytes] = set()
                    doubled = 0
                    for line in lines:
                        if line in seen:
                            doubled += 1
                        elif line.strip(b" \t\n\v\f\r"):
                            seen.add(line)
                    failed = n_words < spec.least_words or (
                        100 * int(repeats[i]) > spec.repeat_percent * n_words
                    )
                    written = [line.decode() for line in lines]
                    faults = [line_fault(line, spec) for line in written]
                    clean = [t for t, f in zip(written, faults, strict=True) if f is None]
                    total = sum(map(len, written))
                    enough = 100 * sum(map(len, clean)) >= spec.kept_percent * total
                    row = (n_words, int(chars[b] - chars[a]), int(signs[b] - signs[a]), doubled)
                    row += (int(repeats[i]), failed, not failed and enough)
                    row += (sum(f is not None for f in faults), "\n".join(clean))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=_NAMES)

    return run


_RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, clean_text string"
)
_NAMES = [part.split()[0] for part in _RESULT.split(", ")]


def clean_lines(docs: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """Row per document: its counts, base_failed, kept, n_lines_removed, clean_text.

    The base rule fails texts of fewer than ``least_words`` words and those of
    whose words more than ``repeat_percent`` stand in repeated windows.  Each line
    is then judged by itself (see ``line_fault``), failing lines are removed, and
    a document that keeps less than ``kept_percent`` of its characters is rejected.

    Null or empty text: all counts 0, base_failed, not kept.  Repeated rows and a
    null doc_id come back as they are; extra columns are ignored.  An empty table
    gives an empty one.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _measure(spec), _RESULT
    )
