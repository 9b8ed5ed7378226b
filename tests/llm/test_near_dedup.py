"""Near duplicates against all pairs of full sets."""

import random
import re

from candlewick.llm.components import components
from candlewick.llm.near_dedup import NearSpec, near_duplicates, sketch
from candlewick.llm.textscan import U, mix

import numpy as np


def shingle_set(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute(rows, spec):
    sets = {i: shingle_set(t, spec.width) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= spec.percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def found(docs, spec):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, spec).collect()}


def varied(words, seed, copies, edits, length=120):
    made = random.Random(seed)
    base = made.choices(words, k=length)
    texts = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(made.randint(0, edits)):
            copy[made.randrange(length)] = made.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_components_and_sizes_equal_all_pairs(docs_of, words):
    texts = []
    for seed in range(6):
        texts += varied(words, seed, 14, 9)
    texts += [None, "", "  \n", "one", "ONE", "one two", "one two three", "one two three four"]
    texts += ["long " * 4000, "long " * 4001]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    for spec in (NearSpec(3, 85), NearSpec(5, 80)):
        assert found(docs_of(rows), spec) == brute(rows, spec)


def test_copies_without_their_original(docs_of, words):
    texts = varied(words, 11, 60, 12)[1:]
    rows = list(enumerate(texts))
    assert found(docs_of(rows), NearSpec(3, 85)) == brute(rows, NearSpec(3, 85))


def test_blocks_of_a_large_bucket(docs_of, words, monkeypatch):
    import candlewick.llm.near_dedup as module

    monkeypatch.setattr(module, "BLOCK_NODES", 8)
    rows = list(enumerate(varied(words, 12, 70, 14)[1:]))
    assert found(docs_of(rows), NearSpec(3, 85)) == brute(rows, NearSpec(3, 85))


def test_null_ids_repeated_rows_and_empty_tables(docs_of):
    docs = docs_of([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f")])
    got = sorted(near_duplicates(docs).collect(), key=str)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True),
        (7, 7, True),
        (7, 7, True),
        (9, 7, False),
    ]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_two_texts_with_one_id(docs_of, words):
    one, two = words[:60], words[100:160]
    texts = [(5, one), (5, two), (7, [*one, "x"]), (9, [*two, "x"]), (9, [*two, "x"]), (11, [*two[:20], *words[300:340]])]
    texts += [(20, words[400:460]), (20, words[500:560]), (20, words[500:560]), (21, [*words[400:460], "y"])]
    got = near_duplicates(docs_of([(i, " ".join(t)) for i, t in texts]), NearSpec(3, 85)).collect()
    assert len(got) == len(texts)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (7, 5), (9, 5), (11, 11), (20, 20), (21, 20)}


def test_every_coordinate_is_filled_and_agreement_estimates_similarity():
    made = np.random.default_rng(1)
    for size in (1, 2, 7, 100, 5000):
        assert len(sketch(np.unique(made.integers(0, 1 << 62, size).astype(U)))) == 128
    pool = np.unique(mix(np.arange(3000, dtype=U)))
    a, b = np.sort(pool[:2400]), np.sort(pool[600:])  # similarity 0.6
    assert abs((sketch(a) == sketch(b)).mean() - 0.6) < 0.2


def test_components_of_long_paths_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3), (9, 8), (8, 9), (2, 1), (1, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 8: 8, 9: 8, 1: 1, 2: 1, 3: 1}
