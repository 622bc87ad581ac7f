"""A whole site copied: crawl, discover, fetch, rewrite and verify, each step a table made from the ones before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls
from ..operators import bundles, graph, html, site


@dataclass(frozen=True)
class Clone:
    """pages: page_id, route, html, page_file, depth, framework; refs: ref of all that pages and bundles name; files: path;
    rewritten: page_id, html, missing; problems: page_id, ref, problem."""

    pages: DataFrame
    refs: DataFrame
    files: DataFrame
    rewritten: DataFrame
    problems: DataFrame


def clone(pages: DataFrame, scripts: DataFrame, resources: DataFrame, seeds: DataFrame, origin: str, most: int = 200, depth: int = 50) -> Clone:
    """pages(page_id, route, html) and scripts(url, text) of a site, the paths of all it serves as resources(url), and
    seeds(node), the routes to start from. At most `most` pages are kept: the cap is part of the result."""
    links = html.routes(html.anchors(pages)).join(pages.select("page_id", F.col("route").alias("src")), "page_id")
    edges = links.select("src", urls.canonical_route(F.col("route"), F.lit(origin)).alias("dst")).filter("dst is not null")
    reached = graph.crawl(edges, seeds, most, depth).select(F.col("node").alias("route"))
    # `most` bounds these rows and the route map below.
    held = pages.join(F.broadcast(reached), "route").withColumn("page_file", urls.route_file(F.col("route"))).withColumn("framework", html.framework(F.col("html")))
    held = held.withColumn("depth", F.size(F.split("page_file", "/")) - 1)
    assets = html.assets(held).filter(~F.col("bucket").isin("routes", "next_images")).select("ref")
    named = bundles.refs(scripts).select("ref")
    refs = assets.unionByName(named).distinct().filter(~P.telemetry(F.col("ref")))
    fetched = site.download_assets(refs, origin, resources).filter("path is not null").select("path")
    files = fetched.unionByName(held.select(F.col("page_file").alias("path"))).distinct()
    routes = {r[0]: r[1] for r in held.select("route", "page_file").collect()}
    rewritten = site.rewrite_pages(held, routes, origin)
    checked = rewritten.select("page_id", "html").join(held.select("page_id", "page_file", "framework"), "page_id")
    return Clone(held, refs, files, rewritten, site.verify_pages(checked, files))
