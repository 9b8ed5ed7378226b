"""Ranked search against scoring every document in plain Python."""

import math
import random
import re

import pytest

from candlewick.llm.ranked_search import SearchSpec, search


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain(docs, items, top=10):
    texts = [(d, terms(t)) for d, t in docs]
    texts = [(d, t) for d, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    df = {}
    for _, t in texts:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        if item is None:
            continue
        ranked = []
        for d, t in texts:
            m = 100 - 75 + (75 * len(t) * n) // total
            score = 0
            for w in terms(text):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, d is None, d or 0, d))
        ranked.sort()
        out += [(item, i, r[3], -r[0]) for i, r in enumerate(ranked[:top], 1)]
    return sorted(out, key=str)


def sample(words):
    made = random.Random(4)
    common = words[:30]
    docs = [(0, None), (1, ""), (2, "..."), (None, common[3]), (3, words[50])]
    for i in range(4, 260):
        k = made.randint(1, 60)
        docs.append((i, " ".join(made.choices(common, k=k) + made.choices(words, k=made.randint(0, 4)))))
    docs += [(1000 + i, docs[100][1]) for i in range(15)] + docs[20:24] + [(None, docs[100][1].upper())]
    docs.append((5000, " ".join(words) * 6))
    items = [(i, " ".join(made.choices(common, k=12) + made.choices(words, k=3))) for i in range(12)]
    items += [(90, docs[100][1]), (91, ""), (92, None), (None, "a"), (93, "nowhere"), (94, " ".join(words[:3000]))]
    return docs, items


@pytest.mark.parametrize("spec", [SearchSpec(), SearchSpec(shard=40, step=2, block_terms=50), SearchSpec(top=3, step=1)])
def test_equals_scoring_every_document(spark, words, spec):
    docs, items = sample(words)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as score", "3 as term")
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as df", "2 as rank")
    got = search(frame.repartition(3), queries, spec)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items, spec.top)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []
