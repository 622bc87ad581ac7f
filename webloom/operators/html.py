"""HTML: attributes, asset buckets, frameworks, masking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls

_ATTRS = "page_id long, pos int, tag string, attr string, value string, rel string"


def html_attrs(pages: DataFrame) -> DataFrame:
    """One row per URL-bearing attribute of pages(page_id, html), in document order; the first of repeated
    attributes counts. Markup is tolerated as browsers do, hence a parser in Arrow batches."""

    def run(batches):
        import html as entities
        import re
        from html.parser import HTMLParser

        media = re.compile(r"\.(?:png|jpe?g|webp|avif|gif|svg|ico|mp4|webm)(?:$|[?#])", re.I)

        class Attributes(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.found = []

            def handle_starttag(self, tag, attrs):
                own = {}
                for k, v in attrs:
                    own.setdefault(k, v)
                rel = (own.get("rel") or "").lower()
                for k, v in own.items():
                    value = entities.unescape(v or "").strip()
                    if not value:
                        continue
                    url = k in ("src", "srcset", "poster", "xlink:href", "ios-src", "environment-image", "skybox-image") or k.startswith("data-")
                    url |= k == "href" and tag not in ("base", "body", "html")
                    url |= k == "data" and tag == "object"
                    url |= k == "content" and tag == "meta" and ("/" in value or media.search(value) is not None)
                    if url:
                        self.found.append((tag, k, value, rel))

        for batch in batches:
            rows = []
            for page, text in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist()):
                parser = Attributes()
                try:
                    parser.feed(text or "")
                    parser.close()
                except (AssertionError, ValueError):
                    pass  # keep what came before the error
                rows += [(page, i, *x) for i, x in enumerate(parser.found)]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _ATTRS.split(", ")])

    return pages.select("page_id", "html").mapInArrow(run, _ATTRS)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: the ordered distinct of lists."""
    least = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    return least.select(*keys, *[F.col(f"first.{c}").alias(c) for c in order])


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, pos, href of <a> tags outside comments and scripts, by expressions alone."""
    bare = masked(F.col("html"))
    hrefs = F.regexp_extract_all(bare, F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def routes(links: DataFrame) -> DataFrame:
    """Distinct routes of each page's links, the query kept, with their first position."""
    route = F.trim(F.regexp_replace("href", "(?s)#.*$", ""))
    rows = links.filter(P.same_origin(F.col("href"))).withColumn("route", route).filter((F.col("route") != "") & ~F.col("route").startswith("?"))
    return first_seen(rows, ["page_id", "route"], ["pos"])


def masked(html: Column) -> Column:
    """Comments and script bodies emptied, so that nothing in them looks like markup."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)(<script\b[^>]*>).*?(</script\s*>)", "$1$2")


def bucket(value: Column, tag: Column, attr: Column, rel: Column) -> Column:
    """The inventory bucket of a reference, null if none takes it."""
    ext = urls.html_ext(value)
    optimizer = value.contains("/_next/image?url=")
    kinds = [("scripts", P.SCRIPT), ("stylesheets", ("css",)), ("images", P.IMAGE), ("fonts", P.FONT), ("videos", P.PLAYED), ("links", P.LINK)]
    generic = F.when(optimizer, "images")
    for name, exts in kinds:
        generic = generic.when(ext.isin(*exts), name)
    link = F.when(rel.contains("stylesheet") | (ext == "css"), "stylesheets").when(ext.isin(*P.IMAGE) | optimizer, "images").when(ext.isin(*P.FONT), "fonts").when(ext.isin(*P.PLAYED), "videos").otherwise("links")
    data = F.when(ext.isin(*P.MEDIA), "data_attrs")
    return F.when(attr.startswith("data-"), data).when((tag == "script") & (attr == "src"), "scripts").when((tag == "a") & (attr == "href"), "routes").when((tag == "link") & (attr == "href"), link).otherwise(generic)


def assets(pages: DataFrame) -> DataFrame:
    """page_id, bucket, ref, pos: each page's same-origin references by bucket, ordered and distinct; an
    optimizer reference also stands under next_images, and its decoded original under images."""
    rows = html_attrs(pages)
    several = F.when(F.col("attr") == "srcset", urls.srcset(F.col("value"))).when(F.col("attr").startswith("data-") & F.col("value").contains(",") & ~urls.html_ext(F.col("value")).isin(*P.MEDIA), urls.srcset(F.col("value"))).otherwise(F.array("value"))
    rows = rows.select("page_id", "pos", "tag", "attr", "rel", F.posexplode(several).alias("sub", "ref")).filter(P.same_origin(F.col("ref")))
    kind = bucket(F.col("ref"), F.col("tag"), F.col("attr"), F.col("rel"))
    optimizer = F.col("ref").contains("/_next/image?url=")
    both = F.array(F.struct(kind.alias("bucket"), F.col("ref").alias("r")), F.when(optimizer, F.struct(F.lit("next_images").alias("bucket"), F.col("ref").alias("r"))), F.when(optimizer & kind.isin("images"), F.struct(F.lit("images").alias("bucket"), urls.optimizer_source(F.col("ref")).alias("r"))))
    flat = rows.select("page_id", "pos", "sub", F.posexplode(both).alias("part", "x")).filter("x.bucket is not null and x.r <> ''")
    flat = flat.select("page_id", F.col("x.bucket").alias("bucket"), F.when(F.col("x.bucket") == "routes", F.regexp_replace("x.r", "(?s)#.*$", "")).otherwise(F.col("x.r")).alias("ref"), (F.col("pos").cast("long") * 10000 + F.col("sub") * 3 + F.col("part")).alias("pos"))
    flat = flat.filter((F.col("bucket") != "routes") | ((F.col("ref") != "") & ~F.col("ref").startswith("?")))
    return first_seen(flat, ["page_id", "bucket", "ref"], ["pos"])


def framework(html: Column) -> Column:
    """The front-end framework that the markup shows."""
    low = F.lower(html)
    module = html.rlike(r"(?i)<script[^>]+type\s*=\s*[\"']module[\"']")
    hashed = html.rlike(r"assets/[^\"'<>\s]*-[A-Za-z0-9_\-]{6,}\.(?:js|css)")
    mount = html.rlike(r"(?i)id\s*=\s*[\"'](?:root|app|__next|main)[\"']")
    return (
        F.when(F.coalesce(F.trim(html), F.lit("")) == "", "unknown")
        .when(P.any_part(html, ("/_next/static/chunks/turbopack-", "__turbopack")), "next-turbopack")
        .when(P.any_part(html, ("/_next/static/", "__NEXT_DATA__", 'id="__next"', "id='__next'")), "next-webpack")
        .when(html.contains("/_astro/"), "astro")
        .when(html.rlike(r"\.svelte[-.]") | (low.contains("sveltekit") & html.contains("/_app/immutable")), "svelte")
        .when(html.rlike(r"/assets/index-[^\"'\s<>]*\.js") | (html.rlike(r"id\s*=\s*[\"']root[\"']") & html.rlike(r"/assets/[^\"'\s<>]*\.js")), "vite-spa")
        .when(module & (low.contains("modulepreload") | hashed) & ~mount, "svelte")
        .when(low.rlike(r"chunks?/|_app/immutable|__vite|parcel|gatsby|_nuxt|nuxt-|bundle[.-]|app\.[a-f0-9]{6,}\.js"), "unknown")
        .otherwise("static")
    )


def parser_hint(label: Column) -> Column:
    return F.when(label == "next-webpack", "webpack").when(label == "next-turbopack", "turbopack").when(label == "vite-spa", "vite").when(label.isin("astro", "svelte"), label).otherwise("generic")


def text_refs(pages: DataFrame) -> DataFrame:
    """page_id, pos, ref: optimizer references and quoted root or relative ones anywhere in the source."""
    raw = F.replace("html", F.lit("\\/"), F.lit("/"))
    optimizer = F.regexp_extract_all(raw, F.lit(r"""(/_next/image\?url=[^"'`\s<>\\]+)"""), F.lit(1))
    quoted = F.regexp_extract_all(raw, F.lit(r"""["'`]((?:/|\./|\.\./)[^"'`\s<>\\]{1,300})["'`]"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(F.concat(optimizer, quoted)).alias("pos", "ref")).filter(P.same_origin(F.col("ref")))
    return first_seen(rows, ["page_id", "ref"], ["pos"])


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """ref, pos: the distinct refs of first(ref, pos), then those of second(ref, pos) that are new."""
    rows = first.select("ref", F.lit(0).alias("part"), "pos").unionByName(second.select("ref", F.lit(1).alias("part"), "pos"))
    return first_seen(rows, ["ref"], ["part", "pos"])
