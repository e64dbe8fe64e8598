"""The thin queries over this subpackage's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bpe, compress, langid, linededup, packing, ppm, rules, simhash, urls
from lectern.llm.common import table


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, and whether it is kept."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    return compress.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_padded_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every document."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op6_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict for every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_line_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of lines and of those that go, and the md5 of the text that stays, for every document."""
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("text_md5"))


def op9_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base_score and score for every document."""
    return ppm.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_hierarchical_packing, op2_isolation_forest_rules, op3_compression_classifier, op4_collision_counting_ann, op5_padded_bpe, op6_anchor_simhash, op7_redirect_url_filter, op8_line_neighbourhoods, op9_hyperdimensional_langid, op10_ppm_scoring)}
SQL: dict[str, str] = {"op7_redirect_url_filter": urls.SQL, "op8_line_neighbourhoods": linededup.SQL}
