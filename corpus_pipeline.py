"""A corpus pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import compress, langid, linededup, packing, simhash
from lectern.llm.common import cut, drop_scratch, table, tidy


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or letterless texts, and those unlike every language that is learned."""
    return langid.keep_known(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for bad go."""
    return compress.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats, or nearly, go; so do documents that lose all their lines."""
    out = linededup.dedup(docs)
    n_lines, n_exact, n_near = (F.col(c) for c in out.columns[-3:])
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.where((n_lines == 0) | (n_lines > n_exact + n_near)).select(*columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("packing", packing_stage),
]
#: The stages' models cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents; every stage but the last is written as Parquet and read again. What a stage wrote
    is deleted once the next one has ended."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        if at + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        before = docs
        with tidy() as keep:
            docs = keep(cut(stage(spark, before, sf_dir)))
        drop_scratch(before)
    return docs
