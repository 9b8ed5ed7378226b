"""Base patterns against plain regular expressions; the field against exhaustive
segmentation and on planted spans it has not seen."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from candlewick.llm.personal_data import (
    KINDS,
    Lattice,
    PersonalModel,
    PersonalSpec,
    _Batch,
    _scores,
    base_spans,
    best_segments,
    find_personal_data,
    fit,
    labelled_stretch,
    luhn,
    regions,
    train,
)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


HARD = [
    None, "", "@", "@@@@", "a@b", "a@b.c", "a@b.c@d.e", "a@b.c_d@e.f", "x..y@-.-", "a@b..c", "é.a@b.cé", "a@b.c.", "%@a.b@c.d.e",
    "1.2.3.4.5.6.7.8", "1.2.3.256", "0001.2.3.4", "1.2.3", "999.1.2.3.4.5", "12.1.1.1.", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111 1111-1112", "4111  1111 1111 1111", "5" * 19, "0" * 13, "0" * 20, "1-2-3-4-5-6-7-8-9-0-1-2-8",
    "+1 (555) 123-4567", "+1", "+12", "+123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1((((2", "++49 30 123456", "+1 555 0100 200   ",
]


def random_texts(n):
    made = random.Random(2)
    return ["".join(made.choices("0123456789.@-+ ()ab_%é\n", k=made.randint(1, 90))) for _ in range(n)]


def test_base_spans_equal_the_patterns():
    for text in HARD + random_texts(4000):
        assert base_spans(text or "") == plain(text), text
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000):
        base_spans(text)  # linear, so it ends


@pytest.fixture(scope="module")
def learned(words):
    made = random.Random(3)
    spec = PersonalSpec(epochs=15)
    stretches = [(" ".join(made.choices(words, k=16)), True) for _ in range(500)]
    return fit(stretches, spec), spec


def test_planted_spans_are_found(learned, words):
    model, spec = learned
    made = random.Random(77)
    hit = wrong = missed = 0
    for _ in range(300):
        text, gold = labelled_stretch(" ".join(made.choices(words, k=16)), True, PersonalSpec(seed=1234))
        lattice = Lattice([text], spec)
        got = {(int(lattice.starts[a]), int(lattice.ends[b - 1]), k) for a, b, k in best_segments(model, lattice)}
        hit, wrong, missed = hit + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.9


def segmentations(lattice, n):
    ways = {}
    for a, b in zip(lattice.first.tolist(), lattice.last.tolist(), strict=True):
        ways.setdefault(a, []).append(b)

    def after(t):
        if t == n:
            yield ()
            return
        for rest in after(t + 1):
            yield ((t, t + 1, 0), *rest)
        for b in ways.get(t, ()):
            for kind, rest in product(range(1, len(KINDS) + 1), list(after(b))):
                yield ((t, b, kind), *rest)

    return after(0)


def path_score(model, lattice, scores, path):
    places = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(lattice.first, lattice.last, strict=True))}
    total, label = 0.0, 0
    for a, b, kind in path:
        total += model.moves[label, kind]
        total += scores[places[a, b], kind - 1] if kind else model.plain[lattice.kinds[a]]
        label = kind
    return total


def test_best_segments_and_slopes_equal_exhaustive_sums():
    made = np.random.default_rng(4)
    spec = PersonalSpec(tokens=3)
    model = PersonalModel.start()
    for part in (model.spans, model.plain, model.moves):
        part += made.normal(0, 0.7, part.shape)
    for text in ("a 12@b 3", "7-8 x", "1"):
        lattice = Lattice([text], spec)
        scores, n = _scores(model, lattice), len(lattice.kinds)
        best = max(segmentations(lattice, n), key=lambda p: path_score(model, lattice, scores, p))
        got = best_segments(model, lattice)
        assert got == [(a, b, kind - 1) for a, b, kind in best if kind]
    # Slopes: differences of the likelihood itself.
    lattice = Lattice(["a 12@b 3", "7-8 x"], spec)
    batch = _Batch(lattice, {(3, 5, 0)}, spec)
    _, spans, plain_, moves = batch.gradient(model)
    for part, slope in ((model.spans, spans), (model.plain, plain_), (model.moves, moves)):
        used = np.argwhere(np.abs(slope) > 1e-4)[:12]
        for at in map(tuple, used):
            part[at] += 1e-3
            high = batch.gradient(model)[0]
            part[at] -= 2e-3
            low = batch.gradient(model)[0]
            part[at] += 1e-3
            assert abs((high - low) / 2e-3 - slope[at]) < 2e-3


def test_documents(docs_of, words):
    made = random.Random(9)
    texts = HARD + [" ".join(words[:50]), "card 4111.1111.1111.1111 here", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"']
    texts += [labelled_stretch(" ".join(made.choices(words, k=16)), True, PersonalSpec())[0] for _ in range(120)]
    texts += [" ".join(words) * 3 + " a.b@c.de " + "12 " * 20000]
    docs = docs_of(texts + [(None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")])
    spec = PersonalSpec(epochs=6)
    model = train(docs, spec)
    rows = find_personal_data(docs, model, spec).collect()
    assert len(rows) == len(texts) + 3
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 3)}
    for i, text in enumerate(texts):
        if i == 3:
            continue
        base, row = plain(text), by_id[i]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in KINDS[:4]]
        spans = [s.split(":") for s in row.spans.split(",") if s]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        assert set(base) <= set(spans) and len(spans) == len(base) + row.n_added
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        added = sorted((a, b) for k, a, b in set(spans) - set(base))
        assert all(b <= a for (_, b), (a, _) in zip(added, added[1:]))
        assert not any(a < y and x < b for a, b in added for _, x, y in base)
        for a, b in added:
            assert any(x <= a and b <= y for x, y in regions(text, spec))
    assert by_id[len(HARD)].spans == ""


def test_empty(docs_of):
    docs = docs_of(["x"]).limit(0)
    assert find_personal_data(docs, train(docs)).collect() == []
