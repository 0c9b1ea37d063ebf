"""Files: mapping lists of videos, binary papers, and what is still to be fetched."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.text import sanitize_filename, session_id, video_id

#: A mapping list's entries.
MAPPING = "youtube_url string, chamber string, session_date string, session_id string, sitting_number string"


def video_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The entries of JSON mapping lists with video and session ids filled in; an entry without either keeps null and says so in ``error``."""
    df = spark.read.schema(MAPPING).option("multiLine", True).json(path)
    built = session_id(F.col("sitting_number"), F.try_to_date("session_date", "yyyy-MM-dd"))
    df = df.withColumn("video_id", video_id(F.col("youtube_url"))).withColumn("session_id", F.coalesce("session_id", built))
    error = F.when(F.col("video_id").isNull(), "no video id in the address").when(F.col("session_id").isNull(), "no session date")
    return df.withColumn("error", error)


def stored_papers(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, content) of the binary files below ``folder``; pruned to the columns that are asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def to_fetch(links: DataFrame, stored: DataFrame) -> DataFrame:
    """The links whose file is not stored yet; a file is named by date and title."""
    named = links.withColumn("name", sanitize_filename(F.concat(F.coalesce("session_date", F.lit("undated")), F.lit("_"), "title", F.lit(".pdf"))))
    return named.join(stored.select("name").distinct(), "name", "left_anti")


def _opened(url: str):
    return urllib.request.urlopen(url, timeout=60)


def download(links: DataFrame, folder: str, opener: Callable = _opened, piece: int = 1 << 16) -> DataFrame:
    """(name, pdf_url, status, bytes) of every link (name, pdf_url) after its file was stored below ``folder``, a shared one.

    A stored file is ``skipped``; a new one is streamed in pieces under another name and renamed when whole, so that a task
    run again or two at once never leave half a file; what cannot be read is ``failed`` and tried again by the next run.
    """

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names, urls = b.column(0).to_pylist(), b.column(1).to_pylist()
            status, size = [], []
            for name, url in zip(names, urls):
                path = os.path.join(folder, name)
                if os.path.exists(path):
                    status.append("skipped")
                    size.append(os.path.getsize(path))
                    continue
                part = f"{path}.{os.getpid()}.part"
                try:
                    with opener(url) as source, open(part, "wb") as out:
                        shutil.copyfileobj(source, out, piece)
                    os.replace(part, path)
                    status.append("success")
                    size.append(os.path.getsize(path))
                except (OSError, ValueError):
                    if os.path.exists(part):
                        os.remove(part)
                    status.append("failed")
                    size.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(status, pa.string()), pa.array(size, pa.int64())], names=["name", "pdf_url", "status", "bytes"])

    asked = links.filter("name IS NOT NULL").groupBy("name").agg({"pdf_url": "min"}).toDF("name", "pdf_url")
    return asked.mapInArrow(run, "name string, pdf_url string, status string, bytes bigint")
