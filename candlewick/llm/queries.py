"""The registered queries of the document operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from candlewick.llm.chat import rotate_perspectives
from candlewick.llm.collocations import collocations
from candlewick.llm.decontamination import contamination
from candlewick.llm.language import held_out, identify, train
from candlewick.llm.licenses import scan_licenses
from candlewick.llm.near_dedup import NearSpec, near_duplicates
from candlewick.llm.packing import pack, public_vocabulary
from candlewick.llm.oracles import OP7_SQL, OP9_SQL, OP12_SQL, OP13_SQL
from candlewick.llm.passages import shared_passages
from candlewick.llm.personal_data import find_personal_data
from candlewick.llm.personal_data import train as train_personal_data
from candlewick.llm.quality import clean_lines
from candlewick.llm.ranked_search import search
from candlewick.llm.repeats import without_repeated_bytes
from candlewick.llm.url_filter import filter_captures, url_keys


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more, at 80 percent of five-word shingles."""
    return shared_passages(documents(spark, folder))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Learn from documents that are not held out, predict all."""
    docs = documents(spark, folder)
    model = train(docs.where(~held_out("doc_id") | docs["doc_id"].isNull()))
    out = identify(docs.select("doc_id", "text"), model).drop("text")
    return out.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2,048 tokens, id 0 after each document."""
    return pack(documents(spark, folder), public_vocabulary)


def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated strings of 400 bytes, removed from all documents."""
    return without_repeated_bytes(documents(spark, folder), keep=False).drop("kept")


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(
        documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence labels of all documents."""
    return scan_licenses(documents(spark, folder))


def _number(text: Column, modulus: int) -> Column:
    """A number below ``modulus`` from the first 24 bits of a text's MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long") % modulus).cast("int")


def captures_and_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a fetch time, and a dated list over their hosts, domains and
    path prefixes.  The tables give neither; both follow from the URLs' MD5."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    seconds = _number(F.concat(F.lit("at"), F.col("page_id").cast("string")), 31_536_000)
    captures = pages.withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + seconds)
    )
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("k")).select("k.*").distinct()
    name = F.concat_ws(":", "kind", "pattern")
    chosen = keys.where(
        ((F.col("kind") == "host") & (_number(name, 4) == 0))
        | ((F.col("kind") == "domain") & F.col("pattern").rlike(r"\..*\.") & (_number(name, 5) == 0))
        | ((F.col("kind") == "prefix") & (_number(name, 7) == 0))
    ).select("kind", "pattern", _number(name, 250).alias("d"), _number(F.concat(name, F.lit("x")), 3).alias("x"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.date_add(start, F.col("d")).alias("dated")),
        F.struct(F.when(F.col("x") > 0, "remove").alias("action"), F.date_add(start, F.col("d") + 40).alias("dated")),
        F.struct(F.when(F.col("x") > 1, "add").alias("action"), F.date_add(start, F.col("d") + 90).alias("dated")),
    )
    entries = chosen.select("kind", "pattern", F.explode(events).alias("e")).select("kind", "pattern", "e.*")
    return captures, entries


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    return filter_captures(*captures_and_lists(spark, folder))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Line-first cleaning of all documents; the cleaned text is left out."""
    return clean_lines(documents(spark, folder)).drop("clean_text")


def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from each participant's perspective."""
    return rotate_perspectives(spark.read.parquet(f"{folder}/conversations.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, linked at 85 percent."""
    return near_duplicates(documents(spark, folder), NearSpec(width=3, percent=85))


def op11_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents.

    The field is fitted to a sample of them while the query is built."""
    docs = documents(spark, folder)
    return find_personal_data(docs, train_personal_data(docs))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two to five words.

    Word, pair and gram counts are stored while the query is built."""
    return collocations(documents(spark, folder))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each benchmark item.

    The index and its counts are stored while the query is built."""
    return search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_pii_spans": op11_pii_spans,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

LLM_ORACLES: dict[str, str] = {
    "op7_url_filter": OP7_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
