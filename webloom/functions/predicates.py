"""Reference predicates and the fixed lists behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Extension classes, schemes and host hints that decide results.
IMAGE = ("png", "jpg", "jpeg", "gif", "webp", "avif", "svg", "ico", "bmp")
FONT = ("woff", "woff2", "ttf", "otf", "eot")
VIDEO = ("mp4", "webm", "ogv", "mov", "m4v", "m3u8")
AUDIO = ("mp3", "wav", "oga", "ogg", "flac", "aac")
TIMED_TEXT = ("vtt", "srt")
SCRIPT = ("js", "mjs", "cjs")
LINK = ("json", "wasm", "webmanifest", "map", "xml", "txt", "pdf", "glb", "gltf", "drc", "riv", "fbx", "obj", "ply", "splat", "usdz", "mtl")
MEDIA = IMAGE + VIDEO + AUDIO + TIMED_TEXT
PLAYED = VIDEO + AUDIO + TIMED_TEXT
PAGE_SCHEMES = ("data:", "blob:", "mailto:", "tel:", "javascript:")
BUNDLE_SCHEMES = ("data:", "blob:", "about:", "chrome:", "javascript:", "mailto:", "tel:", "wss:", "ws:")
TELEMETRY = (
    "googletagmanager", "googletagservices", "gtag/js", "google-analytics", "googleadservices", "doubleclick", "fbevents", "hotjar",
    "mixpanel", "segment.io", "fullstory", "analytics.js", "_vercel/insights", "insights/script.js", "gtm.js",
)


def any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def any_part(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def same_origin(ref: Column, origin: Column | None = None) -> Column:
    """Relative, root-absolute, or on the origin's host; without an origin all absolute URLs are foreign."""
    u = F.trim(ref)
    absolute = u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//")
    own = F.lit(False) if origin is None else F.coalesce(urls.authority(F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https:"), u))) == urls.authority(origin), F.lit(False))
    return (u != "") & ~any_prefix(F.lower(u), PAGE_SCHEMES) & ~u.startswith("#") & F.when(absolute, own).otherwise(True)


def fetchable(ref: Column) -> Column:
    """A literal that can be a path: length, scheme and character rules."""
    return F.length(ref).between(2, 300) & ~any_prefix(F.lower(ref), BUNDLE_SCHEMES) & ~ref.rlike(r"[<>\n\r\t]") & ~ref.contains("${") & ref.contains("/") & ~ref.contains("node_modules/") & ~ref.isin(".", "..", "/")


def bundle_ref(ref: Column) -> Column:
    return F.lower(urls.strip_query(ref)).rlike(r"\.(js|css)$")


def telemetry(ref: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(ref, F.lit(""))), r"(?s)\?.*$", "")
    return any_part(low, TELEMETRY) | low.rlike(r"^/[0-9a-f]{8,}/script\.js")


def page_route(route: Column) -> Column:
    r = F.regexp_replace(urls.strip_query(route), "/+$", "")
    last = F.element_at(F.split(r, "/"), -1)
    return (r != "") & F.lower(F.regexp_extract(last, r"[^.](\.[^.]*)$", 1)).isin("", ".html", ".htm")


def asset_path(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return last.contains(".") & ~last.startswith(".")


def keep_absolute(framework: Column, tag: Column, attr: Column, url: Column) -> Column:
    """References that scripts compare literally: data attributes, and turbopack's own scripts and links."""
    path = urls.strip_query(url)
    turbo = F.lower(framework).contains("turbopack") | F.lower(F.element_at(F.split(path, "/"), -1)).contains("turbopack")
    return F.lower(attr).startswith("data-") | (F.lower(tag).isin("script", "link") & path.startswith("/_next/") & turbo)


def impostor(text: Column) -> Column:
    """HTML where an asset was expected: its first 512 characters start with markup, after white space."""
    head = F.lower(F.regexp_replace(F.substring(text, 1, 512), r"^\s+", ""))
    return head.startswith("<!doctype") | head.startswith("<html")


#: By context, what is left out of a verification report or answered with a stub.
NOISE = {
    "verify": (
        "googletagmanager", "googletagservices", "gtag/js", "google-analytics", "googleadservices", "doubleclick", "googlesyndication", "pagead/",
        "analytics", "fbevents", "hotjar", "mixpanel", "segment.io", "fullstory", "favicon", "_rsc=", "cdn-cgi",
    ),
    "serve": (
        "googletagmanager", "googletagservices", "gtag/js", "google-analytics", "googleadservices", "doubleclick", "fbevents.js", "hotjar",
        "mixpanel", "segment.io", "fullstory", "analytics.js", "_vercel/insights", "cdn-cgi", "sw.js",
    ),
}


def noise(url: Column, context: str = "verify") -> Column:
    """Requests that a report leaves aside (empty and inline ones too), or that a server answers with a stub
    (hashed beacon scripts too)."""
    low = F.lower(F.coalesce(url, F.lit("")))
    if context == "serve":
        return any_part(low, NOISE[context]) | F.regexp_replace(low, r"(?s)\?.*$", "").rlike(r"^/[0-9a-f]{8,}/script\.js$")
    return (low == "") | low.startswith("data:") | low.startswith("blob:") | any_part(low, NOISE[context])


def numeric_variable(name: Column) -> Column:
    """A template variable that counts: a usual index name, or a short name that does not stand for a thing."""
    v = F.trim(name)
    usual = v.rlike("^(?:_|i|j|k|n|x|y|o|h|idx|num|index|count)$")
    return usual | (v.rlike("^[A-Za-z_][A-Za-z0-9_]{0,2}$") & ~v.rlike("(?i)terrain|scene|name|path|url|level|mode|type|key|label|title|atlas"))
