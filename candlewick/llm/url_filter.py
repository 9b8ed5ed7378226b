"""URL filters whose lists change over time, as a temporal join of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, valid_from, valid_to): when an entry was on the list.

    ``entries`` has kind, pattern, action (add or remove) and dated (a date).  An
    entry is active from the day it is added until the day before it is removed;
    of several actions on one day a removal comes last.  valid_to is null for an
    entry that is still active.  Rows with a null in any column are ignored.
    """
    days = (
        entries.select("kind", "pattern", "action", F.col("dated").cast("date").alias("dated"))
        .where("kind is not null and pattern is not null and dated is not null")
        .where(F.col("action").isin("add", "remove"))
        .groupBy("kind", "pattern", "dated")
        .agg(F.max("action").alias("action"))
    )
    later = Window.partitionBy("kind", "pattern").orderBy("dated")
    return (
        days.withColumn("valid_to", F.lead("dated").over(later))
        .where("action = 'add'")
        .select("kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")
    )


def url_keys(url: Column) -> Column:
    """All (kind, pattern) that an entry could match a URL by.

    host: the host name; domain: it and every parent domain; prefix: host and the
    first segments of the path.  A text without scheme and host has none.
    """
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")

    def named(kind: str, patterns: Column) -> Column:
        return F.transform(patterns, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))

    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    keys = F.concat(named("host", F.array(host)), named("domain", domains), named("prefix", prefixes))
    return F.when(host != "", keys)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with blocked, n_rules, rule and listed_since as of each fetch.

    ``captures`` has url and fetched_at.  A capture is blocked if an entry that
    matches its URL was active on the day it was fetched; rule is the first such
    entry as kind:pattern and listed_since the day it was added.

    The verdict depends on URL and day only, so each distinct pair is judged
    once, and each distinct (pattern, day) meets the list's intervals: a busy
    host counts once a day in that join.  Null URL or fetch time: not blocked.
    All rows and columns of ``captures`` stay; columns named like the result are
    replaced.  Either table empty: no capture is blocked.
    """
    new = ("blocked", "n_rules", "rule", "listed_since")
    captures = captures.drop(*new)
    day = F.to_date("fetched_at")
    judged = captures.select("url", day.alias("day")).where("url is not null and day is not null").distinct()
    asked = judged.select("url", "day", F.explode(url_keys(F.col("url"))).alias("k")).select(
        "url", "day", "k.kind", "k.pattern"
    )
    listed = validity(entries)
    active = (
        asked.select("kind", "pattern", "day").distinct()
        .join(listed, ["kind", "pattern"])
        .where("valid_from <= day and (valid_to is null or day < valid_to)")
        .select("kind", "pattern", "day", "valid_from")
    )
    rule = F.concat_ws(":", "kind", "pattern")
    found = (
        asked.join(active, ["kind", "pattern", "day"])
        .groupBy("url", "day")
        .agg(F.count("*").alias("n_rules"), F.min(F.struct(rule.alias("rule"), "valid_from")).alias("r"))
        .select(F.col("url").alias("_url"), F.col("day").alias("_day"), "n_rules", "r")
    )
    same = (captures["url"] == found["_url"]) & (F.to_date(captures["fetched_at"]) == found["_day"])
    return captures.join(found, same, "left").select(
        *captures.columns,
        F.col("n_rules").isNotNull().alias("blocked"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
        F.col("r.rule").alias("rule"),
        F.col("r.valid_from").alias("listed_since"),
    )
