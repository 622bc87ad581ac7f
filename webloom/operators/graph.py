"""Depth-bounded closures over import and link graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, seeds: DataFrame, depth: int = 3, enough: int | None = None) -> DataFrame:
    """(node, depth): nodes within `depth` steps of seeds(node), by the shortest way; no further step is taken once
    `enough` nodes are known. Edges are written once, so that no step makes them anew.

    Semi-naive: each step joins only the last frontier; new nodes are those not yet visited. Results of a
    step are checkpointed to the shared folder, so the plan does not grow and lost executors cost one step."""
    spark = edges.sparkSession
    edges = _kept(spark, edges.select("src", "dst").distinct())
    known = 0
    visited = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for step in range(1, depth + 1):
        new = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = _kept(spark, new.withColumn("depth", F.lit(step)))
        new = frontier.count()
        if not new:
            break
        known += new
        visited = visited.unionByName(frontier)
        if enough is not None and known >= enough:
            break
    return visited


def _kept(spark, df: DataFrame) -> DataFrame:
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/webloom-{uuid.uuid4().hex}")
    return df.checkpoint()


def crawl(links: DataFrame, starts: DataFrame, pages: int = 200, depth: int = 50) -> DataFrame:
    """Reached pages, at most max(2, pages) of them: nearest first, then by name (the cap is the feature)."""
    found = closure(links, starts, depth, max(2, pages))
    return found.orderBy("depth", "node").limit(max(2, pages))


def page_seeds(homepage: DataFrame, sitemap: DataFrame, extra: DataFrame) -> DataFrame:
    """node: what a crawl starts from: routes of the homepage, of the sitemap, and extra ones, pages only."""
    from ..functions import predicates as P

    rows = homepage.select("route").unionByName(sitemap.select("route")).unionByName(extra.select("route"))
    return rows.filter(P.page_route(F.col("route")) | (F.col("route") == "/")).select(F.col("route").alias("node")).distinct()


def rounds(step, start: DataFrame, most: int = 2) -> DataFrame:
    """Apply step until the number of rows stays the same, at most `most` times."""
    size, out = start.count(), start
    for _ in range(most):
        out = _kept(start.sparkSession, step(out).distinct())
        now = out.count()
        if now == size:
            break
        size = now
    return out
