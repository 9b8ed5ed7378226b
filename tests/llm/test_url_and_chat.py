"""Temporal lists and perspective rotation on small tables."""

import datetime as dt
import random

from candlewick.llm.chat import ChatSpec, rotate_perspectives
from candlewick.llm.url_filter import filter_captures, url_keys, validity

ENTRIES = "kind string, pattern string, action string, dated date, note string"
CAPTURES = "page_id long, url string, fetched_at timestamp, rule string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_intervals(spark):
    rows = [("host", "a", "add", day(1), ""), ("host", "a", "remove", day(5), ""), ("host", "a", "add", day(9), "")]
    rows += [("host", "b", "add", day(2), ""), ("host", "b", "remove", day(2), ""), ("host", "c", "remove", day(1), "")]
    rows += [(None, "d", "add", day(1), ""), ("host", "e", "add", None, ""), ("host", "f", "other", day(1), "")]
    rows += [("host", "a", "add", day(1), "again")]
    got = {tuple(r) for r in validity(spark.createDataFrame(rows, ENTRIES)).collect()}
    assert got == {("host", "a", day(1), day(5)), ("host", "a", day(9), None)}


def test_keys_of_urls(spark):
    urls = ["HTTP://User:p@Sub.Example.com:80/a/b//c?x=/y#z", "ftp://h", "no scheme", "", None, "http:///x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_keys(__import__("pyspark").sql.functions.col("url")).alias("k"))
    got = [None if r.k is None else {tuple(k) for k in r.k} for r in rows.collect()]
    host = "sub.example.com"
    assert got[0] == {("host", host), ("domain", host), ("domain", "example.com"), ("domain", "com"),
                      ("prefix", f"{host}/a"), ("prefix", f"{host}/a/b"), ("prefix", f"{host}/a/b/c")}
    assert got[1] == {("host", "h"), ("domain", "h")}
    assert got[2:] == [None] * 4


def test_verdicts_equal_a_plain_search(spark):
    made = random.Random(3)
    hosts = ["a.x.org", "b.x.org", "y.com", "z.net"]
    rows = []
    for i in range(300):
        url = f"http://{made.choice(hosts)}/{made.choice('pq')}/{made.choice('rs')}"
        rows.append((i, url, dt.datetime(2024, 1, 1) + dt.timedelta(hours=made.randint(0, 2000)), "old"))
    rows += [(900, None, dt.datetime(2024, 1, 2), ""), (901, "http://y.com", None, ""), rows[0], (None, "http://y.com/p", dt.datetime(2024, 2, 1), "")]
    listed = [("host", "y.com"), ("domain", "x.org"), ("prefix", "z.net/p"), ("prefix", "a.x.org/q/r"), ("domain", "com")]
    entries = []
    for kind, pattern in listed:
        for d in sorted(made.sample(range(80), 4)):
            entries.append((kind, pattern, made.choice(["add", "remove"]), day(d), ""))

    def verdict(url, at):
        if url is None or at is None:
            return (False, 0, None, None)
        host, _, path = url.split("://")[1].partition("/")
        parts = [p for p in path.split("/") if p]
        keys = {("host", host)} | {("prefix", host + "/" + "/".join(parts[: k + 1])) for k in range(len(parts))}
        keys |= {("domain", ".".join(host.split(".")[k:])) for k in range(host.count(".") + 1)}
        hits = []
        for key in keys:
            past = sorted((e[3], e[2]) for e in entries if e[:2] == key and e[3] <= at.date())
            if past and past[-1][1] == "add":
                hits.append((":".join(key), past[-1][0]))
        return (True, len(hits), *min(hits)) if hits else (False, 0, None, None)

    got = filter_captures(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert got.columns == ["page_id", "url", "fetched_at", "blocked", "n_rules", "rule", "listed_since"]
    want = [(i, u, t, *verdict(u, t)) for i, u, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    captures = spark.createDataFrame(rows, CAPTURES)
    none = spark.createDataFrame([], ENTRIES)
    assert not any(r.blocked for r in filter_captures(captures, none).collect())
    assert filter_captures(captures.limit(0), none).collect() == []


TURNS = "conv_id long, turn long, role string, text string, start long"


def test_rotation(spark):
    turns = [(1, 0, "system", "Be kind.", 9), (1, 1, "ann", "Hi", 9), (1, 2, "bob", None, 9), (1, 2, "bob", None, 9)]
    turns += [(1, 3, None, "é", 9), (1, 3000, "ann", "bye", 9), (1, None, "bob", "late", 9), (2, 0, "system", "alone", 9), (None, 0, "ann", "x", 9)]
    data = spark.createDataFrame(turns, TURNS)
    for block in (1, 2, 1024):
        rows = rotate_perspectives(data, ChatSpec(block=block)).collect()
        views = {}
        for r in rows:
            assert r.conv_id == 1
            views.setdefault(r.perspective, []).append(r)
        assert set(views) == {"ann", "bob", "unknown"}
        for view in views.values():
            view.sort(key=lambda r: r.start)
            text = "".join(r.segment for r in view)
            assert [r.speaker for r in view] == ["system", "ann", "bob", "unknown", "ann", "bob"]
            for r in view:
                assert text[r.start : r.end] == r.segment
                assert (r.trained_from is not None) == (r.speaker == r.perspective)
        ann = "".join(r.segment for r in views["ann"])
        assert ann == (
            "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\n<|end|>\n"
            "<|user name=unknown|>\né<|end|>\n<|assistant|>\nbye<|end|>\n<|user name=bob|>\nlate<|end|>\n"
        )
        trained = [ann[r.trained_from : r.end] for r in views["ann"] if r.trained_from is not None]
        assert trained == ["Hi<|end|>\n", "bye<|end|>\n"]
    assert rotate_perspectives(data.limit(0)).collect() == []
