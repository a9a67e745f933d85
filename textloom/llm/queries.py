"""Queries of the training-data problems: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import abuse, boilerplate, leaks, linkage, neardup, packing, residue, terms


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of raw_docs rows that store one article."""
    return neardup.near_duplicate_pairs(_table(spark, d, "raw_docs")).select(F.col("a").alias("doc_ord_a"), F.col("b").alias("doc_ord_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per raw_docs row with a body: copy class, near-duplicate class, links of its text."""
    return neardup.near_duplicate_groups(_table(spark, d, "raw_docs")).withColumnRenamed("id", "doc_ord")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rare and common terms of raw_docs."""
    return p2_terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every term of raw_docs."""
    return terms.term_frequencies(_table(spark, d, "raw_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles that repeat an accepted one, and the first that they repeat."""
    history = linkage.run_batches(_table(spark, d, "articles"))
    return history.table("links").select("accepted_ordinal", "ordinal")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Representative of every article after all batches."""
    return linkage.clusters(linkage.run_batches(_table(spark, d, "articles")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every place of a standing line of an account."""
    return boilerplate.mark_lines(_table(spark, d, "articles")).select(F.col("id").alias("ordinal"), F.explode("line_nos").alias("line_no")).select("ordinal", F.col("line_no").cast("long").alias("line_no")).distinct()


def p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every article's Markdown without the standing lines of its account."""
    return boilerplate.mark_lines(_table(spark, d, "articles")).select(F.col("id").alias("ordinal"), F.size("line_nos").cast("long").alias("removed_lines"), "body").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Articles with template residue, filler, an error page or a script notice."""
    return p5_scores(spark, d).where(F.col("kind").isNotNull()).select("ordinal").distinct()


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Kind and coverage of the residue of every article."""
    return residue.score_residue(_table(spark, d, "articles")).select(F.col("id").alias("ordinal"), "kind", "coverage")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every document or piece of one."""
    return packing.pack(_table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation passage, and the item."""
    return p7_shares(spark, d).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of the passage's stretches in the document, for every leak."""
    return leaks.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexual sentence."""
    return p8_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, category and number of such sentences of every document."""
    return abuse.score_abuse(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and rate of such content per source."""
    return abuse.abuse_rates(abuse.score_abuse(_table(spark, d, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_terms, p3_found, p3_clusters, p4_found, p4_bodies, p5_found, p5_scores, p6_containers, p7_found, p7_shares, p8_found, p8_scores, p8_rates)}
