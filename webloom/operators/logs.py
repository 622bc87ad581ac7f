"""Request logs and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def request_log(records: DataFrame) -> DataFrame:
    """url, method (first), status (last that is known), n over records(url, method, status, seq)."""
    status = F.max_by("status", "seq")
    known = records.filter("status is not null").groupBy("url").agg(status.alias("status"))
    every = records.groupBy("url").agg(F.min_by("method", "seq").alias("method"), F.count("*").alias("n"))
    return every.join(known, "url", "left").select("url", "method", "status", "n")


def in_flight(events: DataFrame, key: str) -> DataFrame:
    """events(key, seq, step) with open: the running sum of steps of +1 and -1, never below 0."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("s", F.sum("step").over(w))
    return rows.withColumn("open", F.col("s") - F.least(F.lit(0), F.min("s").over(w))).drop("s")


def inventory(files: DataFrame) -> DataFrame:
    """ext, files, bytes over files(path, size)."""
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def clone_summary(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: files, bytes, pages (HTML outside `shots`), colors, fonts over files(path, size), tokens(kind, token)."""
    page = F.lower("path").endswith(".html") & ~F.regexp_replace("path", "[^/]*$", "").contains("shots")
    sizes = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(page).alias("pages"), F.lit(1).alias("one"))
    kinds = tokens.agg(F.count_if(F.col("kind") == "color").alias("colors"), F.count_if(F.col("kind") == "font").alias("fonts"), F.lit(1).alias("one"))
    return sizes.join(kinds, "one").drop("one")
