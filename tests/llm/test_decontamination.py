"""Benchmark passages: planted ones are found, clean documents are not."""

import itertools
import random

from candlewick.llm.decontamination import contamination

ITEMS = "item_id long, text string, extra string"


def test_planted_passages(spark, docs_of, words):
    made = random.Random(4)
    items = [made.choices(words, k=n) for n in (9, 14, 40, 60, 200)]
    docs, want = [], set()
    for i in range(60):
        text = made.choices(words, k=made.randint(0, 300))
        if i < 40:
            item = i % 5
            part = list(items[item])
            if i % 4 == 1 and item > 1:  # every ninth word replaced
                part[4::9] = ["changed"] * len(part[4::9])
            if i % 4 == 2 and item > 1:  # a part of it
                part = part[5:25]
            at = made.randint(0, len(text))
            text[at:at] = part
            want.add((i, item))
        docs.append(" ".join(text).replace("a", "A") + ".")
    bench = spark.createDataFrame([(n, " ".join(w), "x") for n, w in enumerate(items)], ITEMS)
    rows = contamination(docs_of(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    for r in rows:
        span = docs[r.doc_id].lower().replace(".", "").split()[r.first_word : r.end_word]
        assert 0.8 * len(span) <= r.matched_words
        assert len(set(span) & set(items[r.item_id])) >= 0.9 * r.matched_words


def test_overlap_cut_off_at_the_documents_edge(spark, docs_of, words):
    item = words[:40]
    bench = spark.createDataFrame([(1, " ".join(item), "")], ITEMS)
    docs = docs_of([" ".join(item[20:] + words[100:150]), " ".join(words[200:260] + item[:18]), " ".join(item[:9])])
    got = {r.doc_id: (r.first_word, r.end_word, r.matched_words) for r in contamination(docs, bench).collect()}
    assert got == {0: (0, 20, 20), 1: (60, 78, 18)}


def test_nulls_repeats_short_and_empty(spark, docs_of, words):
    item, other = " ".join(words[:30]), " ".join(words[30:60])
    bench = spark.createDataFrame([(1, item, ""), (1, item, ""), (2, None, ""), (3, "", ""), (None, item, ""), (4, "a b", ""), (5, other, "")], ITEMS)
    rows = [(0, None), (1, ""), (2, item), (2, item), (None, item), (None, item), (None, other), (None, None)]
    docs = docs_of([*rows, (5, "x A, b! a-b"), (6, f"{item} x {item}"), (7, item), (7, other), (7, f"{item} z")])
    got = contamination(docs, bench).collect()
    named = sorted((r.doc_id, r.item_id, r.n_places) for r in got if r.doc_id is not None)
    assert named == [(2, 1, 1), (5, 4, 2), (6, 1, 2), (7, 1, 1), (7, 1, 1), (7, 5, 1)]
    nameless = {(r.item_id, r.n_places, r.text_hash) for r in got if r.doc_id is None}
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    assert nameless == {(1, 1, hashes[item]), (5, 1, hashes[other])}
    assert contamination(docs.limit(0), bench).collect() == []
    assert contamination(docs, bench.limit(0)).collect() == []


def test_items_of_one_to_seven_words_equal_a_plain_search(spark, docs_of, words):
    made = random.Random(8)
    few = words[:6]  # so that short items stand in many places
    items = [made.choices(few, k=n) for n in range(1, 8) for _ in range(3)] + [words[:20]]
    texts = [made.choices(few, k=made.randint(0, 120)) for _ in range(60)] + [words[100:140]]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items[:-1]):
            n = len(item)
            at = [k for k in range(len(text) - n + 1) if text[k : k + n] == item]
            if at:
                want[d, i] = (len(at), at[0], at[0] + n, n, n)
    bench = spark.createDataFrame([(i, " ".join(w), "") for i, w in enumerate(items)], ITEMS)
    got = contamination(docs_of([", ".join(t).upper() for t in texts]), bench).collect()
    short = {(r.doc_id, r.item_id): (r.n_places, r.first_word, r.end_word, r.matched_words, r.item_words) for r in got if r.item_words < 8}
    assert short == want


def test_long_text(spark, docs_of, words):
    item = words[:50]
    text = " ".join(random.Random(1).choices(words[100:], k=60_000) + item)
    bench = spark.createDataFrame([(1, " ".join(item), "")], ITEMS)
    (row,) = contamination(docs_of([text]), bench).collect()
    assert (row.first_word, row.end_word) == (60_000, 60_050)


def test_replaced_words_at_every_place_of_short_items(spark, docs_of, words):
    items = [words[100 * n : 100 * n + n] for n in range(8, 18)]
    docs, rule = [], set()
    for item in items:
        n = len(item)
        need = min(13, -(-4 * n // 5))
        for d in range(1, 4):
            for places in itertools.combinations(range(n), d):
                agree = [p not in places for p in range(n)]
                if any(
                    sum(agree[i:j]) >= need and 5 * sum(agree[i:j]) >= 4 * (j - i)
                    for i in range(n)
                    for j in range(i + need, n + 1)
                ):
                    rule.add((len(docs), n))
                docs.append(" ".join(w if a else "changed" for w, a in zip(item, agree, strict=True)))
    bench = spark.createDataFrame([(len(w), " ".join(w), "") for w in items], ITEMS)
    rows = contamination(docs_of(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == rule
    assert all(5 * r.matched_words >= 4 * (r.end_word - r.first_word) for r in rows)
