"""Fetched resources as tables, and sinks for results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def decoded(content: Column) -> Column:
    """UTF-8 text of a binary body; bad bytes are replaced, never raised."""
    return F.make_valid_utf8(content.cast("string"))


@F.pandas_udf(T.BinaryType())
def gunzipped(content: pd.Series) -> pd.Series:
    """Bodies that start with the gzip mark, unpacked; others as they are."""
    import gzip

    return content.map(lambda b: gzip.decompress(b) if b and b[:2] == b"\x1f\x8b" else b)


def glb_json(content: Column) -> Column:
    """The JSON chunk of a binary glTF file; its length is a little-endian number at byte 12."""
    h = F.hex(content)
    pair = lambda i: F.substring(h, i, 2)
    size = F.conv(F.concat(pair(31), pair(29), pair(27), pair(25)), 16, 10).cast("int")
    return F.when(h.startswith("676C5446"), F.substring(content, F.lit(21), size).cast("string"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Request log lines: method, url, status, n."""
    return spark.read.schema("method string, url string, status int, n bigint").json(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, size, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")


def write_trace(log: DataFrame, path: str) -> None:
    log.select("method", "url", "status", "n").orderBy("url").write.json(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """One JSON object with sorted colors and fonts."""
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("token"))))
    tokens.agg(pick("color").alias("colors"), pick("font").alias("fonts")).write.json(path)


def write_lines(refs: DataFrame, column: str, path: str) -> None:
    """Sorted distinct lines."""
    refs.select(column).distinct().orderBy(column).write.text(path)
