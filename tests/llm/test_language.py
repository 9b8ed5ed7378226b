"""Held-out accuracy, and texts without language."""

import random

import numpy as np

from candlewick.llm.language import LanguageSpec, held_out, identify, separating_weights, train

SYLLABLES = {
    "en": "th er on an re he in ed nd ha",
    "de": "ein sch en ung ch ie tz pf ber keit",
    "fr": "eau oi ou é è tion ment que ai eux",
    "es": "ción os as ar ll ñ ue dad mente o",
    "xx": "qw zx kj vq wk jz xq zz kk vv",
}


def corpus(docs, seed, words_each):
    made = random.Random(seed)
    rows = []
    for i in range(docs):
        lang = sorted(SYLLABLES)[i % 5]
        parts = SYLLABLES[lang].split()
        text = " ".join(
            "".join(made.choices(parts, k=made.randint(1, 4))).capitalize() for _ in range(words_each)
        )
        rows.append((i, text, lang, 0.5, "a"))
    return rows


SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def test_held_out_accuracy_and_order(spark):
    docs = spark.createDataFrame(corpus(900, 1, 30), SCHEMA)
    model = train(docs.where(~held_out("doc_id")))
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    rows = identify(docs, model).where(held_out("doc_id")).collect()
    assert 200 < len(rows) < 400
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_and_unknown_languages(spark):
    docs = spark.createDataFrame(corpus(100, 2, 30), SCHEMA)
    model = train(docs)
    odd = spark.createDataFrame(
        [(1, None, None, 0.1, "x"), (2, "", "en", 0.1, "x"), (3, "12 !? \n", "en", 0.1, "x"), (None, "the er on", None, None, None), (5, "é", "fr", 0.0, "")],
        SCHEMA,
    )
    got = identify(odd, model).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and [r.score for r in got][:3] == [0.0] * 3
    assert got[3].lang_pred in SYLLABLES and got[4].lang_pred in SYLLABLES
    assert identify(odd, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    nothing = train(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert identify(docs.limit(0), model).collect() == []
    alone = train(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in identify(docs, alone).collect()} == {"de"}


def test_sample_is_bounded_and_long_texts_count_whole(spark):
    docs = spark.createDataFrame(corpus(500, 3, 20), SCHEMA)
    model = train(docs, LanguageSpec(sample=20))
    text = " ".join(["sch" + "ein" * 3] * 40_000)
    long_one = spark.createDataFrame([(1, text, None, None, None)], SCHEMA)
    assert identify(long_one, model).first().lang_pred == "de"


def test_weights_separate():
    made = np.random.default_rng(1)
    x = made.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - 2 * x[:, 3] > 0.3, 1.0, -1.0)
    w = separating_weights(x, y, 60, 10.0)
    assert (np.sign(x @ w[:-1] + 0.5 * w[-1]) == y).mean() > 0.97


def test_held_out_rule(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}
