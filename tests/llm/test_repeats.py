"""Repeated strings against counting every string."""

import hashlib
import random

import numpy as np
import pytest

from candlewick.llm.repeats import RepeatSpec, prefix_intervals, repeated_spans, without_repeated_bytes


def brute(rows, length):
    counts = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for k in range(len(t) - length + 1):
            counts[t[k : k + length]] = counts.get(t[k : k + length], 0) + 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(docs, spec):
    rows = without_repeated_bytes(docs, spec)
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()), key=str
    )


@pytest.mark.parametrize("group", [512, 1])
@pytest.mark.parametrize("letters", ["abcdefghijklmnop é", "ab"])
def test_equals_counting_all_strings(docs_of, group, letters):
    made = random.Random(4)
    pool = ["".join(made.choices(letters, k=n)) for n in (30, 60, 90, 140, 300)]
    texts = []
    for _ in range(40):
        parts = [made.choice(pool)[made.randint(0, 8) :] for _ in range(made.randint(0, 4))]
        parts += ["".join(made.choices(letters, k=made.randint(0, 50)))]
        made.shuffle(parts)
        texts.append("".join(parts))
    texts += [None, "", "x" * 500, texts[3], texts[3]]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[5])]
    spec = RepeatSpec(length=40, anchor=8, group=group, chunk=7)
    assert found(docs_of(rows), spec) == brute(rows, 40)


def test_overlaps_inside_one_document_and_long_texts(docs_of):
    text = "".join(random.Random(1).choices("abcd", k=3000))
    rows = [(0, text + "|" + text), (1, "z" * 2000), (2, text[:399])]
    assert found(docs_of(rows), RepeatSpec()) == brute(rows, 400)


def test_empty_table_and_kept_bytes(docs_of):
    docs = docs_of(["abc" * 200, "abc" * 200 + "tail"])
    assert without_repeated_bytes(docs.limit(0)).collect() == []
    kept = {r.doc_id: bytes(r.kept) for r in without_repeated_bytes(docs).collect()}
    assert kept == {0: b"", 1: b"tail"}


def test_interval_tree():
    # banana's suffixes: a, ana, anana, banana, na, nana
    assert list(prefix_intervals([0, 1, 3, 0, 0, 2])) == [
        (3, [(1, 2), (2, 3)]),
        (1, [(0, 1), (1, 3)]),
        (2, [(4, 5), (5, 6)]),
        (0, [(0, 3), (3, 4), (4, 6)]),
    ]


def test_spans_equal_all_pairs():
    made = random.Random(8)
    for _ in range(60):
        pool = ["".join(made.choices("ab", k=6)).encode() for _ in range(3)]
        pairs = {
            (made.choice(pool) + made.choice(pool), made.choice(pool) + made.choice(pool))
            for _ in range(made.randint(2, 9))
        }
        pairs = sorted(pairs, key=lambda p: (p[1], p[0]))
        lefts, rights = [p[0] for p in pairs], [p[1] for p in pairs]
        got = repeated_spans(lefts, rights, 10)

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        for i in range(len(pairs)):
            want = set()
            for j in range(len(pairs)):
                if i != j:
                    left, right = common(lefts[i], lefts[j]), common(rights[i], rights[j])
                    want |= {(k, 10 - k) for k in range(left + 1) if 10 - k <= right}
            have = {(k, 10 - k) for a, b in got[i] for k in range(a + 1) if 10 - k <= b}
            assert {w for w in want if w[1] > 0} == {h for h in have if h[1] > 0}
