"""Readers of the file formats (S1-S10): Markdown trees, article lists as JSON, the state table, configuration."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.shared import BROADCAST_BYTES, materialize

#: D9; missing keys are normal, so the schema is never inferred.
ARTICLE = "title string, digest string, link string, url string, source string, content_url string, update_time long, create_time long, content string, content_text string, content_markdown string, content_html string, content_length long, fetch_error string"
#: D10.
ARTICLE_FILE = f"account string, total long, crawled_at string, articles array<struct<{', '.join(c.replace(' ', ':', 1) for c in ARTICLE.split(', '))}>>"
#: D11.
STATE = "account string, last_success_time string, last_success_timestamp timestamp, last_batch_dir string, total_articles_ever long, success_count int, failure_count int, last_failure_time string, last_failure_reason string"
# Crawl settings.
DEFAULTS = {"batch_size": 5, "delay_seconds": 5, "delay_jitter": 0.4, "batch_limit": 100, "rest_seconds": 60, "max_retries": 3, "retry_backoff": 2.0}


def lenient(value: Column) -> Column:
    """S3: text of bytes; bytes that aren't UTF-8 are dropped, a genuine U+FFFD only where there were such bytes."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def markdown_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """S1, S2 scan: (path, rel_path, name, mtime, text, md5) of the *.md files under a folder, subfolders too or not."""
    df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive).load(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = str(PurePosixPath(folder.removeprefix("file:"))) + "/"
    rel = F.substring_index(path, base, -1)
    return df.select(path.alias("path"), rel.alias("rel_path"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), F.col("_metadata.file_modification_time").alias("mtime"), lenient(F.col("value")).alias("text"), F.md5("value").alias("md5"))


def with_order(files: DataFrame, name: str = "doc_ord") -> DataFrame:
    """Files numbered from 0 in the order of their path's parts; rows of one path share its number, a null path has none.

    Paths alone, without texts, are sorted by ranges into a table; the ranges are counted and their rows numbered in
    that table, so every reader sees the same ranges. Texts then meet the numbers by path (broadcast by measured size).
    """
    paths = files.where("rel_path IS NOT NULL").select("rel_path").distinct().withColumn("__p", F.split("rel_path", "/"))
    ranged = materialize(paths.repartitionByRange("__p").sortWithinPartitions("__p").withColumn("__part", F.spark_partition_id()), "order")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    r = F.row_number().over(Window.partitionBy("__part").orderBy("__p")) - 1
    numbered = ranged.join(F.broadcast(before.drop("__n")), "__part").select("rel_path", (r + F.col("__before")).cast("long").alias(name))
    size = ranged.agg(F.coalesce(F.sum(F.length("rel_path") * 4 + 48), F.lit(0))).first()[0]
    return files.join(F.broadcast(numbered) if size <= BROADCAST_BYTES else numbered, "rel_path", "left").select(*files.columns, name)


def article_list(spark: SparkSession, path: str) -> DataFrame:
    """Articles of list files, one row each with account and ordinal; a file that is a bare list works too, without an account."""
    text = spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("path"), "value")
    bare = F.ltrim("value").startswith("[")
    wrapped = F.when(bare, F.concat(F.lit('{"articles":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
    x = text.select("path", F.from_json(wrapped, ARTICLE_FILE).alias("f"))
    x = x.select("path", "f.account", F.posexplode("f.articles").alias("ordinal", "a"))
    return x.select("path", "account", "ordinal", "a.*")


def state_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the state under a folder of versions v=N; no state if there is none or it can't be read."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(STATE + ", v int").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], STATE)
    last = df.agg(F.max("v").alias("v"))
    return df.join(F.broadcast(last), "v", "left_semi").drop("v")


def write_state(state: DataFrame, path: str, version: int) -> None:
    """One new version; readers see it when it is complete."""
    state.write.mode("overwrite").parquet(f"{path}/v={version}")


def load_config(text: str | None) -> dict:
    """Defaults with a JSON text's settings over them, key by key (omitted keys keep their defaults)."""
    given = json.loads(text) if text else {}
    return {**{k: v for k, v in given.items() if k != "crawl_settings"}, "crawl_settings": {**DEFAULTS, **given.get("crawl_settings", {})}}


def historical_map(spark: SparkSession, folder: str) -> DataFrame:
    """S7 over a folder: (norm, path, md5) of the latest file of each normal name."""
    from textloom.operators.ingest import history_files

    return history_files(markdown_files(spark, folder))


def source_links(spark: SparkSession, folder: str) -> DataFrame:
    """S6 over a folder."""
    return markdown_files(spark, folder).select(T.source_of("text").alias("link")).where("link <> ''").distinct()
