"""Licence and quality rules against plain loops over words and lines."""

import random
import re
from collections import Counter

from candlewick.llm.licenses import BASE_PHRASES, TEMPLATES, scan_licenses
from candlewick.llm.quality import clean_lines, line_fault, QualitySpec


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_labels(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places = []
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({b for _, b in places}))
    return len(found), len(places), min(starts, default=None), max(starts, default=None), labels


def licence_texts(words):
    made = random.Random(3)
    texts = [None, "", "MIT", "mit  License!", "Mit-LICENSE mit license", "general public", "É Apache License"]
    for t in TEMPLATES:
        body = " ".join(made.choices(words, k=50))
        changed = t.text.split()
        changed[3] = "zzz"
        texts += [t.text, f"{body} {t.text.title()}. {body}", f"{body} {' '.join(changed)}"]
    return [*texts, " ".join(words) * 5 + " under the mit license"]


def test_base_places_equal_a_plain_search(docs_of, words):
    texts = licence_texts(words)
    got = {r.doc_id: tuple(r)[1:6] for r in scan_licenses(docs_of(texts)).collect()}
    assert got == {i: base_labels(t) for i, t in enumerate(texts)}


def test_templates_are_found_in_place(docs_of, words):
    texts = licence_texts(words)
    rows = {r.doc_id: r for r in scan_licenses(docs_of(texts)).collect()}
    for n, t in enumerate(TEMPLATES):
        for k in range(2):
            row = rows[7 + 3 * n + k]
            assert t.label in row.labels.split(",") and row.score == 1.0
    plain = docs_of([" ".join(words[:200]), "the software is free of charge"])
    assert all(r.labels == "" and r.score == 0.0 for r in scan_licenses(plain).collect())
    assert scan_licenses(plain.limit(0)).collect() == []


def test_two_notices_in_one_file_are_both_found(docs_of):
    texts, want = [], []
    for one in TEMPLATES:
        for two in TEMPLATES:
            texts.append(f"{one.text} . {two.text}")
            want.append({one.label, two.label})
    rows = {r.doc_id: r for r in scan_licenses(docs_of(texts)).collect()}
    for i, labels in enumerate(want):
        assert labels <= set(rows[i].labels.split(",")), texts[i]


def counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(found) < 20 or 100 * len(covered) > 30 * len(found)
    signs = sum(text.count(c) for c in "#*$%&|<>")
    return len(found), sum(map(len, found)), signs, doubled, len(covered), failed


def test_counts_equal_plain_loops(docs_of, words):
    made = random.Random(5)
    texts = [None, "", "\n\n", " \x0b a\n a\n a\n", "é ü ñ 日本 #*$", "x " * 20, "\r\nline\r\nline\r\n"]
    for _ in range(40):
        lines = [" ".join(made.choices(words[:60], k=made.randint(0, 15))) for _ in range(5)]
        texts.append("\n".join(made.choices(lines, k=made.randint(1, 12))))
    texts.append(" ".join(words) * 4)
    docs = docs_of(texts)
    rows = clean_lines(docs).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: counts(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in rows)
    assert clean_lines(docs.limit(0)).collect() == []


def test_line_rules_and_rejection(docs_of, words):
    spec = QualitySpec()
    assert line_fault("Home | News | Sport | Contact", spec) == "navigation"
    assert line_fault("Copyright 2020. All Rights Reserved.", spec) == "boilerplate"
    assert line_fault("word%%% other### more$$$", spec) == "symbols"
    assert line_fault("Menu", spec) == "punctuation"
    assert line_fault("", spec) is None
    assert line_fault("A whole sentence that says something, with an end.", spec) is None
    prose = ". ".join(" ".join(words[i : i + 9]) for i in range(0, 90, 9)) + "."
    menu = "\n".join(" | ".join(words[i : i + 6]) for i in range(100, 220, 6))
    kept = {r.doc_id: (r.kept, r.clean_text) for r in clean_lines(docs_of([prose, f"{menu}\n{prose}", f"Menu\n{prose}"])).collect()}
    assert kept[0] == (True, prose) and not kept[1][0] and kept[2] == (True, prose)
