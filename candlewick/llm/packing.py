"""Packing documents into training sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.storage import settle

#: Pieces that one task places at a time.
GROUP = 4096
_TEXTS = 256  # tokenized at a time

#: Texts that the word cache serves: white space, printable ASCII and precomposed Latin
#: letters, for which normalising is lower-casing.  All others go to the tokenizer whole.
_UNUSUAL = re.compile("[^\t-\r -~\xa1-\u012f\u0131-\u024f]|<\\|")
#: Words a process keeps: those met since it last met as many new ones, and as many from before.
_CACHED_WORDS = 1 << 17
#: Ends a piece of a word; such texts are unusual, so it stands nowhere else.
_END = "\0"


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins words, so a text's ids are
    its words' ids in a row and words met again and again are tokenized once.  New
    words are merged many at a time by the same merge list, with the end-of-word sign
    as bytes of its own; the tests hold this against the tokenizer itself.  Of the
    words about ``_CACHED_WORDS`` are kept twice over, however many there are.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.pieces = regex.compile(
            described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        ).findall
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        sign = _END.encode()

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte_of[c] for c in token.removesuffix("</w>")) + (sign if ends else b"")

        # Ranks: bytes, then each last byte with the end sign, then the merges.
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + sign: 256 + b for b in range(256)}
        for i, merge in enumerate(described["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks[raw(left + right)] = 512 + i
        top = 512 + len(described["model"]["merges"])
        self.ids = np.zeros(top, "<u4")
        self.last = np.zeros(top, bool)
        for token, number in described["model"]["vocab"].items():
            if not token.startswith("<|"):
                rank = ranks[raw(token)]
                self.ids[rank] = number
                self.last[rank] = token.endswith("</w>")
        self.merges = tiktoken.Encoding(
            "words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}
        )

    def _merge(self, new: list[str]) -> list[bytes]:
        """Ids of each word."""
        parts = [self.pieces(w) for w in new]
        joined = _END.join([_END.join(p) for p in parts if p]) + _END
        if len(joined) == 1:
            return [b""] * len(new)
        got = self.merges.encode_to_numpy(joined)
        ends = np.flatnonzero(self.last[got]) + 1  # of pieces
        count = np.cumsum([len(p) for p in parts])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], count])] * 4
        data = self.ids[got].tobytes()
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, loaded for the first unusual text."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHED_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        listed = [None if _UNUSUAL.search(t) else t.lower().split() for t in texts]
        new = []
        for word in set().union(*(words for words in listed if words is not None)).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        known.update(zip(new, self._merge(new), strict=True))
        out = []
        for text, words in zip(texts, listed, strict=True):
            if words is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The process's encoder of a vocabulary file; it outlives a task."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def public_vocabulary() -> str:
    """The tokenizer file's path, looked up where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: Callable[[], str], capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path()).encode
        last = np.array([end], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            docs, numbers, lengths, sums, kept = [], [], [], [], []
            for first in range(0, batch.num_rows, _TEXTS):
                some = encode(texts.slice(first, _TEXTS).to_pylist())
                for i, ids in enumerate(some, first):
                    ids += last
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        docs.append(i)
                        numbers.append(k // width)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(np.frombuffer(part, "<i4"))
            number = np.array(numbers, np.int32)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(docs, pa.int64())),
                "piece": pa.array(number),
                "start": pa.array(number.astype(np.int64) * capacity),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def token_pieces(
    docs: DataFrame,
    vocabulary: Callable[[], str],
    capacity: int = 2048,
    end: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each document, ``end`` appended.

    ``vocabulary`` gives the tokenizer file's path where the task runs.  Columns:
    doc_id, piece, start, length, ids_crc32 and, if asked for, ids.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cutter(vocabulary, capacity, end, keep_ids),
        _PIECE + (", ids array<int>" if keep_ids else ""),
    )


class OpenBins:
    """Open sequences by fill level, and how many there are of each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def by_squares(self, size: int) -> int:
        """The level to fill up (0: a new sequence) for which the squared counts
        of open sequences per level sum to the least; ties take the fullest."""
        full = self.capacity - size
        count = self.count
        best, level = 2 * int(count[size]) + 1, 0
        if full > 1:
            here = count[1:full]
            change = 2 * (count[1 + size : self.capacity] - here) + 2
            change[here == 0] = np.iinfo(np.int64).max
            k = len(change) - 1 - int(change[::-1].argmin())
            if change[k] <= best:
                best, level = int(change[k]), k + 1
        if full > 0 and count[full] and 1 - 2 * int(count[full]) <= best:
            level = full
        return level if size < self.capacity else 0

    def by_best_fit(self, size: int) -> int:
        """The fullest level with room (0: a new sequence)."""
        levels = np.flatnonzero(self.count[1 : self.capacity - size + 1])
        return int(levels[-1]) + 1 if len(levels) else 0

    def put(self, level: int, size: int) -> int:
        if level:
            number = self.at[level].pop()
            self.count[level] -= 1
        else:
            number = self.made
            self.made += 1
        if level + size < self.capacity:
            self.at[level + size].append(number)
            self.count[level + size] += 1
        return number


def _placer(capacity: int, squares: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]
        )
        open_bins = OpenBins(capacity)
        choose = open_bins.by_squares if squares else open_bins.by_best_fit
        number, offset = [], []
        for size in rows["length"].tolist():
            level = choose(size)
            number.append(open_bins.put(level, size))
            offset.append(level)
        rows["sequence_id"] = (int(key[0]) << 32) + np.array(number, np.int64)
        rows["offset"] = np.array(offset, np.int64)
        filled = rows.groupby("sequence_id")["length"].transform("sum")
        rows["full"] = (filled == capacity).to_numpy()
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "row", "sequence_id", "offset", "full"]]

    return run


def pack(
    docs: DataFrame, vocabulary: Callable[[], str], capacity: int = 2048, end: int = 0
) -> DataFrame:
    """Row per piece of a document: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (gapless from 0 in its sequence).

    Pieces are numbered, stored and dealt at random (by hash) into groups of about 4,096.  A group is
    placed longest first by the sum-of-squares rule, which keeps the counts of
    open sequences per fill level even so that most of them close exactly full.
    Those stay.  The documents of sequences left unfilled are dealt into new
    groups and placed once more, longest first into the fullest sequence with
    room.  So no task holds more than one group, at any size of input.

    Null or empty text: one piece of length 1, ``end`` alone.  Longer documents
    are cut only at multiples of ``capacity``.  Repeated rows are packed once
    each and, however many, spread over all groups; a null doc_id is kept; other columns are ignored.  An empty table gives
    an empty one.
    """
    pieces = token_pieces(docs, vocabulary, capacity, end)
    # Stored, so the numbers stay the same whatever is computed again.
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, full boolean"

    def place(rows: DataFrame, first: int, squares: bool) -> tuple[DataFrame, int]:
        groups = rows.count() // GROUP + 1
        salt = F.lit(0 if squares else 1)
        # By its number, so that equal rows are spread as well.
        bucket = F.pmod(F.xxhash64(salt, "row"), F.lit(groups)) + first
        dealt = rows.withColumn("bucket", bucket).groupBy("bucket")
        return dealt.applyInPandas(_placer(capacity, squares), placed), first + groups

    first, after = place(pieces, 0, squares=True)
    first = settle(first)
    rest, _ = place(first.where("not full").select(*pieces.columns), after, squares=False)
    return first.where("full").unionByName(rest).drop("row", "full")
