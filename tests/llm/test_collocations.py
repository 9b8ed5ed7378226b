"""Phrases against counting every gram in plain Python."""

import random
import re
from collections import Counter

from candlewick.llm.collocations import PhraseSpec, collocations


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, spec):
    total, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, spec.words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < spec.least:
            continue
        inside = any(
            len(q) > len(p) and v >= a and g == lang and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (g, q), v in f.items() if v >= spec.least
        )
        if inside:
            continue
        n = total[lang]
        cut = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        l, r = f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]
        out.setdefault(lang, []).append((" ".join(p), a, l, r, n, cut[0]))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i, *x) for i, x in enumerate(found[: spec.top], 1)]
    return sorted(rows)


def sample(words):
    made = random.Random(8)
    few = words[:9] + ["É", "THE", "of"]
    rows = [(None, "en"), ("", None), ("one", "en"), (" , \t;\n", "fr"), ("a\x0bb\x0cc d", "en")]
    fixed = ["new york city hall", "to be or not to be", "É the of"]
    for i in range(60):
        lang = made.choice(["en", "fr", None])
        parts = [" ".join(made.choices(few, k=made.randint(0, 12))) for _ in range(6)]
        parts += made.choices(fixed, k=4) + [" ".join(made.choices(words, k=20))]
        made.shuffle(parts)
        rows.append((made.choice([". ", ", ", "\n", "\t", " "]).join(parts), lang))
    rows.append((" ".join(words[:3]) * 3000, "fr"))
    return rows + rows[10:20] + [("same same same same " * 50, "x")]


def test_equals_plain_counts(spark, words):
    rows = sample(words)
    for spec in (PhraseSpec(least=8), PhraseSpec(least=3, top=7), PhraseSpec(least=5, words=3)):
        docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as f", "2 as id", "3 as n")
        got = sorted(tuple(r) for r in collocations(docs, spec).collect())
        assert got == plain(rows, spec)


def test_scores_beyond_64_bits(spark):
    """Every occurrence counts, and 1000 * a * n passes 64 bits for large counts."""
    one = "SELECT cast(4000000000000000 AS bigint) AS a, cast(9000000000000000 AS bigint) AS n, "
    frame = spark.sql(one + "cast(4000000000000007 AS bigint) AS l, cast(4000000000000011 AS bigint) AS r")
    got = frame.selectExpr(
        "cast(1000 * cast(a as decimal(19,0)) as decimal(38,0)) * cast(n as decimal(38,0)) as above",
        "cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as below",
    ).selectExpr("above div below as score").first()
    assert got["score"] == 1000 * 4000000000000000 * 9000000000000000 // (4000000000000007 * 4000000000000011)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
