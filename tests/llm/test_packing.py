"""Packing against the tokenizer itself, and the placing rules."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from candlewick.llm import packing
from candlewick.llm.packing import GROUP, OpenBins, WordEncoder, pack, public_vocabulary, token_pieces


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_vocabulary())


def texts_of(words):
    made = random.Random(6)
    texts = [None, "", " \n\t ", "one", "Don't stop: it's 42½, naïve ŒUVRE… ok?!", "<|endoftext|> x <| y"]
    texts += ["ΑΣ Σ final", "İstanbul", "é combining", "\x1c\x1d odd \x85 blanks\xa0here", "日本語 テキスト"]
    texts += [" ".join(made.choices(words, k=made.randint(1, 400))) for _ in range(60)]
    texts += [" ".join(made.choices(words, k=9000)), "x" * 5000]
    return texts


def test_ids_and_cuts_equal_the_tokenizer(docs_of, words, tokenizer):
    texts = texts_of(words)
    docs = docs_of(texts)
    got = {}
    for r in token_pieces(docs, public_vocabulary, keep_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32, r.ids))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        want = [(n, n * 2048, len(p), zlib.crc32(p.tobytes()), p.tolist()) for n, p in enumerate(parts)]
        assert sorted(got[i]) == want


def test_random_words_equal_the_tokenizer(tokenizer):
    made = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzéüñßœ'st0123456789.,!?-_\"#&½"
    texts = ["".join(made.choices(letters, k=made.randint(1, 14))) for _ in range(4000)]
    got = WordEncoder(public_vocabulary()).encode(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_sequences_are_gapless_and_nearly_full(docs_of, words):
    docs = docs_of(texts_of(words) + texts_of(words)[11:60])
    rows = pack(docs, public_vocabulary, capacity=256).toPandas()
    assert len(rows) == token_pieces(docs, public_vocabulary, capacity=256).count()
    for _, part in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() <= 256
    assert rows["sequence_id"].nunique() <= 1.1 * -(-rows["length"].sum() // 256)


def test_repeated_rows_null_ids_and_empty_tables(docs_of):
    docs = docs_of([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])
    rows = pack(docs, public_vocabulary).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert pack(docs.limit(0), public_vocabulary).collect() == []


def test_equal_rows_are_spread(docs_of):
    docs = docs_of([(None, "a b")]).selectExpr("doc_id", "text", "explode(sequence(1, 20000)) AS n")
    rows = pack(docs, public_vocabulary, capacity=63).toPandas()
    assert len(rows) == 20000 and not rows[["sequence_id", "offset"]].duplicated().any()
    assert (rows["sequence_id"] // 2**32).value_counts().max() < 1.5 * GROUP
    assert rows["sequence_id"].nunique() <= 1.01 * -(-rows["length"].sum() // 63)


def test_the_rule_takes_the_least_sum_of_squares():
    made = random.Random(2)
    bins = OpenBins(20)
    for _ in range(300):
        size = made.randint(1, 20)

        def cost(level):
            counts = bins.count.copy()
            if level:
                counts[level] -= 1
            if level + size < 20:
                counts[level + size] += 1
            return int((counts[1:20] ** 2).sum())

        open_levels = [h for h in range(1, 20 - size + 1) if bins.count[h]]
        chosen = bins.by_squares(size)
        assert chosen in [0, *open_levels]
        assert cost(chosen) == min(cost(h) for h in [0, *open_levels])
        bins.put(chosen, size)


def test_the_words_kept_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_CACHED_WORDS", 50)
    made = random.Random(9)
    encoder = WordEncoder(public_vocabulary())
    for _ in range(40):
        texts = [" ".join(f"often{made.randint(1, 9)} w{made.randint(1, 400)}" for _ in range(8)) for _ in range(4)]
        got = encoder.encode(["", *texts, "naïve ŒUVRE…"])
        want = tokenizer.encode_batch(["", *texts, "naïve ŒUVRE…"], add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
        assert len(encoder.known) + len(encoder.older) <= 2 * (50 + 64)
