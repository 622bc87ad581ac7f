"""URL and path functions: Column in, Column out, evaluated by the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVALID = r'[<>:"\\|?*\x00-\x1f]'


def strip_query(c: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(c, r"(?s)[?#].*$", "")


def split_tail(c: Column) -> tuple[Column, Column]:
    """(path, query and fragment)."""
    return strip_query(c), F.regexp_extract(c, r"(?s)^[^?#]*([?#].*)?$", 1)


def unquote(c: Column) -> Column:
    """Percent-decoding; a plus sign stays, and text that cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def html_ext(c: Column) -> Column:
    """Lower-cased extension of a reference in HTML, of any length, not decoded."""
    return F.lower(F.regexp_extract(strip_query(c), r"\.([A-Za-z0-9]+)$", 1))


def bundle_ext(c: Column) -> Column:
    """Lower-cased extension of 2 to 5 characters of a reference in a bundle, decoded first."""
    return F.regexp_extract(unquote(F.lower(strip_query(c))), r"\.([a-z0-9]{2,5})$", 1)


def authority(c: Column) -> Column:
    """Lower-cased host and port; null for what is no URL."""
    return F.lower(F.try_parse_url(c, F.lit("AUTHORITY")))


def join_url(*parts: Column) -> Column:
    """Parts in a row; double slashes collapse, but for those after a colon."""
    return F.regexp_replace(F.concat(*parts), r"(?<!:)//+", "/")


def normalize_url(raw: Column) -> tuple[Column, Column]:
    """(page URL, origin) of what a user typed: https by default, no fragment, no trailing slash on the path."""
    full = F.trim(raw)
    full = F.when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), full).otherwise(F.concat(F.lit("https://"), full))
    origin = F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(full, r"^[^?#]*(\?[^#]*)?", 1)
    return F.concat(origin, F.when(path == "", "/").otherwise(path), query), origin


def canonical_route(ref: Column, origin: Column) -> Column:
    """Site route: origin cut off, leading slash, no query, fragment or trailing slash; null for other sites."""
    own = F.when(ref.startswith(origin), F.substring(ref, F.length(origin) + 1, F.lit(1 << 30))).otherwise(ref)
    bare = F.regexp_replace(strip_query(own), "/+$", "")
    return F.when(~own.contains("://"), F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)))


def route_file(route: Column) -> Column:
    """Sibling-file name of a route: / is index.html, /a/b is a/b.html."""
    p = F.regexp_replace(F.trim(route), "^/+|/+$", "")
    return F.when(p == "", "index.html").otherwise(F.concat(p, F.lit(".html")))


def safe_segment(segment: Column) -> Column:
    """Decoded path segment fit for a file name; separators that decoding brought in are replaced too."""
    s = F.regexp_replace(unquote(segment), INVALID + r"|/", "_")
    s = F.regexp_replace(F.trim(s), r"\.+$", "")
    return F.when(s == "", "_").otherwise(s)


def local_path(url: Column) -> Column:
    """Relative file path of a URL or path: directories become index.html, extensionless pages get .html only
    with a query, whose sanitised start names the variant."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    is_dir = path.endswith("/") | (path == "")
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), safe_segment)
    base = F.array_join(parts, "/")
    last = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
    named = F.substring(F.regexp_replace(unquote(query), INVALID + r"|[/\s]", "_"), 1, 80)
    stem = F.when(is_dir, F.when(base == "", "index").otherwise(F.concat(base, F.lit("/index")))).otherwise(base)
    plain = F.when(is_dir, F.concat(stem, F.lit(".html"))).otherwise(base)
    extensionless = is_dir | ~last.contains(".")
    return F.when((query != "") & extensionless, F.concat(stem, F.lit("__"), named, F.lit(".html"))).otherwise(plain)


def depth_prefix(depth: Column) -> Column:
    return F.when(depth > 0, F.repeat(F.lit("../"), depth.cast("int"))).otherwise("./")


def optimizer_source(ref: Column) -> Column:
    """The decoded original of an image-optimizer reference, '' for others."""
    return unquote(F.regexp_extract(ref, r"/_next/image\?url=([^&\"'`\s<>]+)", 1))


def srcset(value: Column) -> Column:
    """array<string> of a srcset's URLs: only a trailing width or density is cut off, spaces in names stay."""
    bare = F.transform(F.split(value, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\s+[0-9.]+[wx]$", "")))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


@F.pandas_udf(T.StringType())
def js_unescape(s: pd.Series) -> pd.Series:
    r"""\/, \u0026 and any other \uXXXX, then &amp;: Spark has no expression for the general escape."""
    import re

    def one(x):
        if x is None or ("\\" not in x and "&" not in x):
            return x
        return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x.replace("\\/", "/")).replace("&amp;", "&")

    return s.map(one, na_action="ignore")


def normalize_ref(ref: Column) -> Column:
    """A bundle's literal as a path (of unescaped text): quotes and end punctuation off, spaces encoded,
    slashes collapsed, leading junk dropped (``../a`` becomes ``/a``), chunk paths made absolute."""
    r = F.regexp_replace(F.regexp_replace(ref, r"^[\s\"'`]+|[\s\"'`]+$", ""), r"[.,;]+$", "")
    r = F.replace(r, F.lit(" "), F.lit("%20"))
    r = F.regexp_replace(r, r"(?<!:)/{2,}", "/")
    r = F.regexp_replace(r, r"^[^A-Za-z0-9_~/]+", "")
    # Nested, not as a choice between values: each would repeat all the steps above.
    return F.regexp_replace(F.regexp_replace(r, "^(?=static/chunks/)", "/_next/"), "^(?=_next/)", "/")


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 resolution; used after deduplication."""
    from urllib.parse import urljoin

    def one(b, r):
        try:
            return urljoin(b or "", r or "")
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)])


def site_path(url: Column, origin: Column) -> Column:
    """Path and query of a URL on the origin's host, normalised; other URLs as they are."""
    path = F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url(url, F.lit("QUERY"))), F.lit("")))
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(authority(url) == authority(origin), normalize_ref(rooted)).otherwise(url)


def route_slug(route: Column) -> Column:
    """A route as a file-name part: decoded, other characters as underscores, `home` for /."""
    s = F.regexp_replace(F.regexp_replace(unquote(route), r"[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "home").otherwise(s)


def clone_name(origin: Column) -> Column:
    """A folder name for an origin's copy."""
    return F.concat(F.regexp_replace(F.regexp_replace(origin, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[^A-Za-z0-9.-]+", "-"), F.lit("-clone"))


def optimizer_target(ref: Column) -> Column:
    """Local path of an image-optimizer reference, '' for others: remote originals are stored by their name."""
    source = unquote(unquote(F.replace(F.regexp_extract(ref, r"(?s)_next/image\?(?:[^#]*?&(?:amp;)?)?url=([^&#]+)", 1), F.lit("+"), F.lit(" "))))
    remote = source.rlike("^(?:https?:)?//")
    return F.when(remote, F.element_at(F.split(strip_query(source), "/"), -1)).otherwise(F.regexp_replace(strip_query(source), "^/+", ""))


def normal_path(path: Column) -> Column:
    """A relative path with its `.` and `..` steps taken; steps above the root stay."""
    start = F.array().cast("array<string>")

    def step(done, part):
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def downloadable(ref: Column, origin: Column) -> Column:
    """The absolute URL of a page's reference; null for what cannot be fetched (empty, inline, mail, fragments)."""
    r = F.trim(ref)
    skipped = (F.coalesce(r, F.lit("")) == "") | r.rlike("^(?:data:|mailto:|tel:|javascript:|blob:|#)")
    scheme = F.regexp_extract(origin, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    full = F.when(r.startswith("//"), F.concat(scheme, r)).otherwise(r)
    base = F.when(origin.endswith("/"), origin).otherwise(F.concat(origin, F.lit("/")))
    return F.when(~skipped, resolve(base, full))
