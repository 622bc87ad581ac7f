"""Sites as folders: fetch jobs, route lookup, file serving, rewriting and verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls


def fetch(jobs: DataFrame, resources: DataFrame) -> DataFrame:
    """jobs(url) against resources(url, content): ok with a local path, or failed. Retries are Spark's own."""
    got = resources.select("url", F.lit(True).alias("found"))
    return jobs.distinct().join(got, "url", "left").select("url", F.coalesce("found", F.lit(False)).alias("ok"), F.when(F.col("found"), urls.local_path(F.col("url"))).alias("path"))


def sitemap_routes(sitemaps: DataFrame) -> DataFrame:
    """url, route: same-host <loc> entries of sitemaps(url, text) as paths."""
    rows = sitemaps.select("url", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"))
    same = urls.authority(F.col("loc")) == urls.authority(F.col("url"))
    path = F.coalesce(F.try_parse_url("loc", F.lit("PATH")), F.lit(""))
    return rows.filter(same).select("url", F.when(path == "", "/").otherwise(path).alias("route")).distinct()


def playlist_refs(playlists: DataFrame) -> DataFrame:
    """url, segment: resolved non-comment lines of HLS playlists(url, text) on the same host."""
    lines = playlists.select("url", F.explode(F.split("text", "\r?\n")).alias("line")).filter((F.trim("line") != "") & ~F.col("line").startswith("#"))
    rows = lines.select("url", urls.resolve("url", F.trim("line")).alias("segment"))
    return rows.filter(F.coalesce(urls.authority(F.col("segment")) == urls.authority(F.col("url")), F.lit(False))).distinct()


def route_candidates(path: Column) -> Column:
    """A path's lookup keys in order: raw, decoded, and both without trailing slashes."""
    bare = lambda p: F.when(F.regexp_replace(p, "/+$", "") == "", "/").otherwise(F.regexp_replace(p, "/+$", ""))
    return F.array(path, urls.unquote(path), bare(path), bare(urls.unquote(path)))


def lookup_routes(refs: DataFrame, routes: DataFrame) -> DataFrame:
    """refs(path, ...) with target: the file of the first lookup key that routes(route, target) holds."""
    key = F.when(F.col("route") == "/", "/").otherwise(F.regexp_replace("route", "/+$", ""))
    known = routes.groupBy(key.alias("key")).agg(F.max("target").alias("t"))
    paths = refs.select("path").distinct()
    tried = paths.select("path", F.posexplode(route_candidates(F.col("path"))).alias("prio", "key"))
    best = tried.join(known, "key").groupBy("path").agg(F.min_by("t", "prio").alias("target"))
    return refs.join(best, "path", "left")


def rewritten(refs: DataFrame, routes: DataFrame, origin: str | None = None) -> DataFrame:
    """Relational form of a page's rewriting: refs(tag, attr, url, framework, depth) with new_url, missing. URLs on the
    origin's host count as paths."""
    if origin:
        own = F.coalesce(urls.authority(F.col("url")) == urls.authority(F.lit(origin)), F.lit(False))
        refs = refs.withColumn("url", F.when(own, urls.site_path(F.col("url"), F.lit(origin))).otherwise(F.col("url")))
    path, tail = urls.split_tail(F.col("url"))
    rows = lookup_routes(refs.withColumn("path", path).withColumn("tail", tail), routes)
    prefix = urls.depth_prefix(F.col("depth"))
    hands_off = ~F.col("url").startswith("/") | F.col("url").startswith("//") | (F.col("tag") == "meta") | P.keep_absolute(F.col("framework"), F.col("tag"), F.col("attr"), F.col("url"))
    optimizer = urls.optimizer_target(F.col("url"))
    guess = ~hands_off & (optimizer == "") & F.col("target").isNull() & ~P.asset_path(F.col("path"))
    new = (
        F.when(hands_off, F.col("url")).when(optimizer != "", F.concat(prefix, optimizer))
        .when(F.col("target").isNotNull(), F.concat(prefix, "target", "tail")).when(P.asset_path(F.col("path")), F.concat(prefix, F.regexp_replace("path", "^/+", ""), F.col("tail")))
        .otherwise(F.concat(prefix, urls.route_file(F.col("path")), F.col("tail")))
    )
    return rows.withColumn("new_url", new).withColumn("missing", F.when(guess, F.col("path")))


def path_problems(refs: DataFrame, files: DataFrame) -> DataFrame:
    """page_id, ref, problem of refs(page_id, ref): root-absolute leftovers, and relative ones without a file.

    Optional columns: page_file (paths are resolved against its folder), tag, attr and framework (references that the
    framework compares literally may stay absolute; those of `meta` are never paths)."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in refs.columns else F.lit("")
    rows = refs.select("page_id", F.trim("ref").alias("ref"), have("page_file").alias("page_file"), have("tag").alias("tag"), have("attr").alias("attr"), have("framework").alias("framework"))
    local = rows.filter((F.col("ref") != "") & (F.lower("tag") != "meta") & ~F.col("ref").rlike("^(?:https?://|//|data:|blob:|mailto:|tel:|javascript:|#)"))
    kept = (F.col("framework") != "") & P.keep_absolute(F.col("framework"), F.col("tag"), F.col("attr"), F.col("ref"))
    left = local.filter(F.col("ref").startswith("/") & ~kept).select("page_id", "ref", F.lit("absolute").alias("problem"))
    bare = urls.unquote(urls.strip_query(F.col("ref")))
    path = urls.normal_path(F.concat(F.regexp_replace("page_file", "[^/]*$", ""), bare))
    absent = local.filter(~F.col("ref").startswith("/")).filter(bare != "").withColumn("path", path).join(files.select("path").distinct(), "path", "left_anti")
    return left.unionByName(absent.select("page_id", "ref", F.lit("missing").alias("problem"))).distinct()


def verify_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """path_problems of pages(page_id, html, page_file, framework): all reference attributes and css url()."""
    from .html import html_attrs

    found = html_attrs(pages)
    several = F.when(F.col("attr").endswith("srcset"), urls.srcset(F.col("value"))).otherwise(F.array("value"))
    refs = found.select("page_id", "tag", "attr", F.explode(several).alias("ref"))
    styles = pages.select("page_id", F.lit("style").alias("tag"), F.lit("url").alias("attr"), F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)url\(\s*["']?([^)"'\s<>]+)"""), F.lit(1))).alias("ref"))
    return path_problems(refs.unionByName(styles).join(pages.select("page_id", "page_file", "framework"), "page_id"), files)


def missing_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct refs(ref) that no file(path) serves."""
    return refs.select(F.col("ref").alias("path")).distinct().join(files.select("path").distinct(), "path", "left_anti")


def served_files(path: Column, is_folder: Column) -> Column:
    """Candidate files of a bare path, in the order a static server tries them: a folder's index or namesake,
    a file as it is named, a page's own file."""
    last = F.element_at(F.split(path, "/"), -1)
    folder = F.array(F.concat(path, F.lit("/index.html")), F.concat(path, F.lit("/"), last, F.lit(".html")))
    return F.when(path == "", F.array(F.lit("index.html"))).when(last.contains("."), F.array(path)).when(is_folder, folder).otherwise(F.array(F.concat(path, F.lit(".html"))))


def serve(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(path) with file: the first candidate that exists, else null."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = files.filter(F.col("path").contains("/")).select(F.explode(above).alias("bare")).distinct().withColumn("folder", F.lit(True))
    bare = F.regexp_replace(urls.unquote(urls.strip_query(F.col("path"))), "^/+|/+$", "")
    paths = requests.select("path").distinct().withColumn("bare", bare).join(folders, "bare", "left")
    tried = paths.select("path", F.posexplode(served_files(F.col("bare"), F.coalesce("folder", F.lit(False)))).alias("prio", "file"))
    best = tried.join(files.select(F.col("path").alias("file")).distinct(), "file").groupBy("path").agg(F.min_by("file", "prio").alias("file"))
    return requests.join(best, "path", "left")


def optimizer_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(ref) with file: the exact path of the original, else the least path with its lower-cased name."""
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    rows = refs.withColumn("source", urls.optimizer_target(F.col("ref")))
    exact = files.select(F.col("path").alias("exact")).distinct()
    named = files.groupBy(name(F.col("path")).alias("base")).agg(F.min("path").alias("named"))
    out = rows.join(exact, rows.source == exact.exact, "left").withColumn("base", name(F.col("source"))).join(named, "base", "left")
    return out.select("ref", "source", F.coalesce("exact", "named").alias("file"))


#: A crawl's page cap bounds its route map; `rewritten` takes maps of any size as tables.
MOST_ROUTES = 100_000


def rewrite_pages(pages: DataFrame, routes: dict[str, str], origin: str | None = None) -> DataFrame:
    """page_id, html, missing of pages(page_id, html, depth, framework): the document form of `rewritten`.

    One regular expression per document cannot carry per-match decisions, hence Arrow batches; `routes` is
    the site's own small map. Comments and script bodies stay as they are, and a second run changes nothing."""
    if len(routes) > MOST_ROUTES:
        raise ValueError(f"{len(routes)} routes: use rewritten(), which joins them")
    known = {(k if k == "/" else k.rstrip("/")): v for k, v in routes.items()}
    own = origin.rstrip("/").lower() if origin else None

    @F.pandas_udf("html string, missing array<string>")
    def run(html: pd.Series, depth: pd.Series, framework: pd.Series) -> pd.DataFrame:
        import re
        from urllib.parse import parse_qs, unquote

        script = re.compile(r"(<script\b[^>]*>)(.*?)(</script\s*>)|(<!--.*?-->)", re.S | re.I)
        attribute = re.compile(r"""(\s)([a-zA-Z][\w:-]*)(\s*=\s*)(["'])(.*?)\4""", re.S)
        css = re.compile(r"""url\((\s*["']?)(/(?!/)[^)"'\s<>]*)""", re.I)
        takes = {"src", "href", "poster", "srcset", "data", "xlink:href", "imagesrcset"}

        def one(text, depth, framework):
            prefix, lost = "../" * int(depth or 0) or "./", set()
            turbo = "turbopack" in (framework or "").lower()

            def target(url, tag, attr):
                if own and url.lower().startswith(own) and url[len(own) : len(own) + 1] in ("", "/", "?", "#"):
                    url = "/" + url[len(own) :].lstrip("/")
                if not url.startswith("/") or url.startswith("//"):
                    return url
                path, tail = re.match(r"(?s)([^?#]*)(.*)", url).groups()
                if attr.startswith("data-") or (tag in ("script", "link") and path.startswith("/_next/") and (turbo or "turbopack" in path.rsplit("/", 1)[-1].lower())):
                    return url
                if path == "/_next/image":
                    source = unquote((parse_qs(tail[1:].replace("&amp;", "&")).get("url") or [""])[0])
                    if source:
                        bare = unquote(source).split("?")[0].split("#")[0]
                        return prefix + (bare.rsplit("/", 1)[-1] if re.match(r"(?:https?:)?//", bare) else bare.lstrip("/"))
                for key in (path, unquote(path), path.rstrip("/") or "/", unquote(path).rstrip("/") or "/"):
                    if key in known:
                        return prefix + known[key] + tail
                last = path.rsplit("/", 1)[-1]
                if "." in last and not last.startswith("."):
                    return prefix + path.lstrip("/") + tail
                lost.add(path)
                return prefix + (path.strip("/") + ".html" if path.strip("/") else "index.html") + tail

            def opening(m):
                tag = re.match(r"<([a-zA-Z][\w:-]*)", m[0])[1].lower()
                if tag == "meta":
                    return m[0]

                def attr(a):
                    name, value = a[2].lower(), a[5]
                    if name not in takes:
                        return a[0]
                    if name.endswith("srcset"):
                        parts = [re.match(r"(?s)(\s*)(.*?)((?:\s+[\d.]+[wx])?\s*)$", p).groups() for p in value.split(",")]
                        new = ",".join(a_ + target(u, tag, name) + d for a_, u, d in parts)
                    else:
                        new = target(value, tag, name)
                    return f"{a[1]}{a[2]}{a[3]}{a[4]}{new}{a[4]}"

                return attribute.sub(attr, m[0])

            def markup(part):
                part = re.sub(r"<[a-zA-Z][^>]*>", opening, part)
                return css.sub(lambda m: f"url({m[1]}{prefix}{m[2].lstrip('/')}", part)

            out, at = [], 0
            for m in script.finditer(text or ""):
                out.append(markup(text[at : m.start()]))
                out.append(m[4] if m[4] is not None else markup(m[1]) + m[2] + m[3])
                at = m.end()
            out.append(markup((text or "")[at:]))
            return "".join(out), sorted(lost)

        return pd.DataFrame([one(*x) for x in zip(html, depth, framework)], columns=["html", "missing"])

    return pages.select("page_id", run("html", "depth", "framework").alias("r")).select("page_id", "r.html", "r.missing")


def rewrite_css(text: Column, depth: int = 2, origin: str | None = None) -> Column:
    """Root-absolute url() references made relative to a file `depth` folders below the root."""
    prefix = "../" * depth or "./"
    if origin:
        text = F.regexp_replace(text, r"(?i)(url\(\s*[\"']?)" + origin.rstrip("/").replace(".", r"\.") + r"(?=/)", "$1")
    return F.regexp_replace(text, r"(?i)(url\(\s*[\"']?)/(?!/)", f"$1{prefix}")


def strip_origin(text: Column, origin: str) -> tuple[Column, Column]:
    """(text without the origin, number of occurrences)."""
    new = F.replace(text, F.lit(origin), F.lit(""))
    return new, ((F.length(text) - F.length(new)) / len(origin)).cast("long")


def problem_summary(events: DataFrame) -> DataFrame:
    """One row over events(url, status): failures that count, and whether the run was clean."""
    counts = events.filter(~P.noise(F.col("url"))).agg(F.count_if(F.col("status") >= 400).alias("failed"))
    return counts.withColumn("clean", F.col("failed") == 0)


def failed_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(url) that failed and count: no noise, no media, no prefetch, no file(path) of their own."""
    path = urls.unquote(F.regexp_replace(urls.strip_query(F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")), "^/+", ""))
    rows = requests.filter(~P.noise(F.col("url")) & ~urls.html_ext(F.col("url")).isin(*P.PLAYED)).withColumn("path", path)
    return rows.join(files.select("path").distinct(), "path", "left_anti").drop("path")


def dns_failure(error: Column) -> Column:
    """Whether a fetch log's error says that a host name was not found."""
    return F.lower(error).rlike("name or service not known|getaddrinfo|nodename nor servname|name resolution|nxdomain")


def api_payloads(payloads: DataFrame) -> DataFrame:
    """payloads(path, body) by bare path with a leading slash; bodies that are no JSON are left out."""
    bare = urls.strip_query(F.col("path"))
    rows = payloads.select(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)).alias("path"), F.col("body").cast("string").alias("body"))
    return rows.filter(F.try_parse_json("body").isNotNull()).groupBy("path").agg(F.max("body").alias("body"))


def api_answers(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """requests(path) with body: the payload of the path, else of the path without its slash, else {}."""
    exact = payloads.select("path", F.col("body").alias("b1"))
    bare = payloads.select(F.col("path").alias("bare"), F.col("body").alias("b2"))
    rows = requests.join(exact, "path", "left").withColumn("bare", F.regexp_replace("path", "/+$", "")).join(bare, "bare", "left")
    return rows.select("path", F.coalesce("b1", "b2", F.lit("{}")).alias("body"))


#: Where a site's manifest may lie.
MANIFESTS = ("manifest.json", "manifest.webmanifest", "site.webmanifest")


def download_assets(refs: DataFrame, origin: str, resources: DataFrame) -> DataFrame:
    """refs(ref) with path: the local file of what resources(url, content) hold on the origin's host, else null."""
    rows = refs.select("ref").distinct().withColumn("url", urls.downloadable(F.col("ref"), F.lit(origin)))
    own = rows.filter(F.coalesce(urls.authority(F.col("url")) == urls.authority(F.lit(origin)), F.lit(False)))
    found = own.join(resources.select("url").distinct(), "url", "left_semi").select("ref", urls.local_path(F.col("url")).alias("path"))
    return refs.join(found, "ref", "left")


def first_stage(origin: str, routes: DataFrame, resources: DataFrame) -> DataFrame:
    """kind, url, ok, path of a crawl's first fetches: the homepage, extra routes(route), and the manifests."""
    spark = routes.sparkSession
    bare = F.regexp_replace(F.trim("route"), "^/+|/+$", "")
    extra = routes.filter(bare != "").select(F.lit("page").alias("kind"), F.concat(F.lit(origin + "/"), bare).alias("url"))
    fixed = spark.createDataFrame([("page", origin + "/"), *(("manifest", f"{origin}/{m}") for m in MANIFESTS)], "kind string, url string")
    jobs = fixed.unionByName(extra).distinct()
    return jobs.join(fetch(jobs.select("url"), resources), "url").filter("ok or kind = 'page'").select("kind", "url", "ok", "path")


def page_errors(events: DataFrame) -> DataFrame:
    """route, kind, problem of events(route, kind, text, url): script errors and console errors that are the page's own."""
    text, url = F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))
    script = (F.col("kind") == "pageerror") & ~P.noise(text)
    console = (F.col("kind") == "error") & ((url == "") | ~P.noise(url))
    return events.filter(script | console).select("route", "kind", F.when(script, F.concat("route", F.lit(" pageerror: "), text)).otherwise(F.concat("route", F.lit(" console: "), text, F.lit(" ["), url, F.lit("]"))).alias("problem"))


def verification(problems: DataFrame, failed: DataFrame, errors: DataFrame) -> DataFrame:
    """kind, detail: one report of path problems(ref), failed requests(url) and page errors(problem)."""
    one = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), F.col(column).alias("detail"))
    return one(problems, "path", "ref").unionByName(one(failed, "request", "url")).unionByName(one(errors, "error", "problem")).distinct()
