"""Sinks that write one file a row (K1, K2, K9) and lists with their counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str, path: str = "rel_path", text: str = "text", replace: bool = False) -> DataFrame:
    """K2: (path, written) of one UTF-8 file a row under a folder that all executors share; an existing one stays unless replace.

    A file appears whole, by renaming, so a task that is run again leaves the same files. Null paths and texts write
    nothing and give no row, nor do paths that leave the folder; of rows with one path one is written. Lazy: files are
    written when the result is read.
    """
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).where("path IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
        for b in batches:
            names, done = b.column("path").to_pylist(), []
            for name, body in zip(names, b.column("text").to_pylist(), strict=True):
                at = f"{base}/{name}"
                fresh = replace or system.get_file_info(at).type == fs.FileType.NotFound
                if fresh:
                    system.create_dir(at.rpartition("/")[0])
                    part = f"{at}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as out:
                        out.write(body.encode("utf-8", "replace"))
                    system.move(part, at)
                done.append(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.bool_())], names=["path", "written"])

    return rows.mapInArrow(run, "path string, written boolean")


def filtered_header(new: DataFrame, skipped: DataFrame, keywords: tuple[str, ...], at: str, account: str = "account") -> DataFrame:
    """(account, total, original_total, skipped_historical, filtered_at, keywords) of each account's filtered list."""
    both = new.select(account, F.lit(1).alias("n")).unionByName(skipped.select(account, F.lit(0).alias("n")))
    g = both.groupBy(account).agg(F.sum("n").alias("total"), F.count("*").alias("original_total"))
    words = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    return g.select(account, "total", "original_total", (F.col("original_total") - F.col("total")).alias("skipped_historical"), F.lit(at).alias("filtered_at"), words.alias("keywords"))


def filtered_rows(new: DataFrame, account: str = "account") -> DataFrame:
    """(account, json): the articles of the filtered lists, one JSON object a row; a list isn't gathered into one row."""
    return new.select(account, F.to_json(F.struct(*[c for c in new.columns if c != account]), {"ignoreNullFields": "false"}).alias("json"))


def write_filtered(new: DataFrame, skipped: DataFrame, keywords: tuple[str, ...], at: str, folder: str, account: str = "account") -> None:
    """The headers and the lists as JSON lines, a folder an account."""
    filtered_header(new, skipped, keywords, at, account).write.mode("overwrite").json(f"{folder}/lists")
    filtered_rows(new, account).write.mode("overwrite").partitionBy(account).text(f"{folder}/articles")


def as_path(*parts: Column) -> Column:
    """A relative path of its parts."""
    return F.concat_ws("/", *parts)
