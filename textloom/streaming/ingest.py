"""Structured Streaming front end of the ingest (W7): the batch function runs on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from textloom.operators import ingest
from textloom.plans.pipeline import ingest_plan


def article_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """Articles from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(stream: DataFrame, accepted: str, checkpoint: str, keywords: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends new articles to accepted, one folder batch=N a micro-batch; a micro-batch that is run again replaces its folder.

    Each batch is compared with the links of the batches before it only, so a repeated run gives the same rows.
    """
    schema = stream.select("*", ingest.article_link().alias("known_link")).schema

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], "link string")
        if n:
            try:
                before = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(accepted).where(F.col("batch") < n).select(F.col("known_link").alias("link")).where("link <> ''").distinct()
            except Exception as e:  # nothing accepted yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new = ingest_plan(batch, before, keywords)["new"].withColumn("known_link", ingest.article_link())
        blank = new.where("known_link = ''")
        first = new.where("known_link <> ''").groupBy("known_link").agg(F.min("ordinal").alias("ordinal"))
        new.join(first, ["known_link", "ordinal"], "left_semi").unionByName(blank).write.mode("overwrite").parquet(f"{accepted}/batch={n}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Articles per account and window of crawled_at, with a watermark for late ones."""
    return events.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", every), "account").agg(F.count("*").alias("articles"))
