"""Bundles: references in script text, frame clusters, templates and their expansion, asset files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..functions import urls

_Q, _NQ = "[\"'`]", "[^\"'`\\s<>]"
_PATH = r"A-Za-z0-9_./%+?#&=@:$~\-"
#: Asset extensions and directories that mark a literal as a reference.
ASSET_EXTS = (
    "js|css|woff2?|ttf|otf|eot|fnt|font|icon|png|jpe?g|webp|avif|gif|svg|ico|mp4|webm|mp3|ogg|wav|glb|gltf|drc|ktx2?|basis|bin|wasm|hdr|exr|"
    "json|atlas|pbf|parquet|m3u8|mov|m4v|ply|splat|riv|fbx|obj|mtl|usdz|pvr|astc|dds|dae|stl|3ds|usd|usda|usdc|vrm|lottie|splinecode|tga|ttc|vtt"
)
DIRECTORIES = "frames|photo|skills|videos?|images?|assets|fonts?|media|models?|textures?|data|static|common|3d-elements|projects?|blog|icons?|logos?"
_NEXT_STATIC = r"(?i)(/_next/static/(?:chunks|css|media)/[^\"'`\s\\<>]+?\.(?:js|css|woff2?|ttf|otf|png|jpe?g|webp|avif|svg|glb|gltf|wasm|json|mp4|webm|mov|m3u8|fbx|obj|ply|splat|riv)(?:[?#][^\"'`\s\\<>]*)?)"
_QUOTED_ASSET = rf"(?i){_Q}([{_PATH}]{{1,220}}?\.(?:{ASSET_EXTS})(?:[?#][^\"'`\s<>]*)?){_Q}"
_IMPORTMAP = r"(?is)<script[^>]+type\s*=\s*[\"']importmap[\"'][^>]*>(.*?)</script>"
_DECODER = r"set(?:Decoder|Transcoder|MeshoptDecoder)Path\(\s*[\"'`]([^\"'`()]{1,180})[\"'`]"
_SET_PATH = r"setPath\(\s*[\"'`]([^\"'`()]{1,180})[\"'`]\s*\)"
#: Ids of any length, from their first digit on: one cut to its last digits names another chunk.
_ID_HASH = r"""(?<!\d)(\d{2,})["']?\s*:\s*["']([0-9a-f]{8,64})["']"""
#: Patterns by parser, in discovery order; group 1 is the reference.
PARSERS: dict[str, tuple[str, ...]] = {
    "webpack": (r"static/chunks/([A-Za-z0-9_.$-]+\.(?:js|css))", r"(?:^|[^A-Za-z0-9_.-])((?:\d{1,9}\.)?[A-Za-z0-9_.$-]{0,300}[0-9a-f]{8,}\.[A-Za-z0-9_.$-]{0,300}\.?(?:js|css))", r"((?:/)?_next/static/(?:chunks|css|media)/[^\"'`\s\\<>]+?\.(?:js|css)(?:[?#][^\"'`\s\\<>]*)?)"),
    "turbopack": (r"parseChunk[^;]{0,600}?[\"'`]([^\"'`]{1,220}?\.js(?:[?#][^\"'`]*)?)[\"'`]", r"(?i)((?:/)?_next/static/chunks/[^\"'`\s\\<>]*?[0-9a-f]{8,}[^\"'`\s\\<>]*?\.(?:js|css)(?:[?#][^\"'`\s\\<>]*)?)", _NEXT_STATIC),
    "vite": (r"import\(\s*[\"'`]([^\"'`]{1,220}?)[\"'`]\s*\)", rf"{_Q}([{_PATH}]{{1,120}}?assets/[A-Za-z0-9_./\-]{{1,180}}){_Q}", rf"(?i){_Q}([{_PATH}]{{1,220}}?\.(?:glb|gltf|drc|ktx2?|font|icon|webp|basis|hdr|bin|wasm|fnt|atlas|ply|splat|riv|fbx|obj|mtl|usdz)(?:[?#][^\"'`\s<>]*)?){_Q}"),
    "scene": (rf"(?i){_Q}([{_PATH}]{{1,220}}?(?:/common/|/assets/(?:audio|fonts|images|geometries|libs)/|lottie/|data\.json|scene\.glb|draco|basis|meshopt|transcoder|worker|setPath)[{_PATH}]{{0,120}}){_Q}", rf"(?i){_Q}([{_PATH}]{{1,120}}?(?:worker|transcoder|draco|basis)[A-Za-z0-9_./\-]{{0,100}}\.(?:js|wasm)){_Q}", _SET_PATH),
    "loaders": (_DECODER, rf"(?i){_Q}({_NQ}{{1,220}}?typeface\.json(?:[?#]{_NQ}*)?){_Q}", rf"(?i){_Q}({_NQ}{{1,220}}?\.splinecode(?:[?#]{_NQ}*)?){_Q}", r"[\"']url[\"']\s*:\s*[\"']([^\"']+)[\"']"),
    "generic": (_QUOTED_ASSET, r"(?i)url\(\s*[\"']?([^)\"'\s<>]{1,300})[\"']?\s*\)", _NEXT_STATIC, r"/_next/image\?url=([^&\"'`\s<>]+)", r"(/_next/image\?url=[^&\"'`\s<>]+)", rf"{_Q}(/(?:{DIRECTORIES})/[{_PATH}]{{0,200}}){_Q}"),
}
ALWAYS = ("loaders", "generic")
#: Files beside a decoder path, and extensions of absolute URLs that are assets.
DECODER_FILES = ("draco_decoder.js", "draco_decoder.wasm", "draco_wasm_wrapper.js", "basis_transcoder.js", "basis_transcoder.wasm", "meshopt_decoder.js", "meshopt_decoder.wasm")
ABSOLUTE_EXTS = ("js", "css", "drc", "ktx2", "wasm", "json", "bin", "glb", "gltf", "exr", "avif", "webp", "png", "jpg", "ogg", "mp3", "wav", "woff2", "ktx", "basis", "data")


@dataclass(frozen=True)
class Limits:
    """Caps that are part of the results."""

    top_segments: int = 15
    prefixes: int = 12
    numbers: int = 50
    ids: int = 150
    fillers: int = 15
    frame_span: int = 5000
    enum: int = 5000
    gaps: int = 8
    depth: int = 3
    pages: int = 200
    bases: int = 10
    relative: int = 3000
    path_ids: int = 400


def _literals(name: str, text: Column) -> Column:
    """Raw references of one parser, in discovery order."""
    lists = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PARSERS[name]]
    whole = lambda c: F.filter(c, lambda r: ~r.contains("${"))
    if name == "webpack":
        in_chunks = lambda c: F.transform(c, lambda r: F.concat(F.lit("/_next/static/chunks/"), F.regexp_replace(r, r"^[./]+|[./]+$", "")))
        near = r"miniCssF[\s\S]{0,6000}?" + _ID_HASH
        styles = F.zip_with(F.regexp_extract_all(text, F.lit(near), F.lit(1)), F.regexp_extract_all(text, F.lit(near), F.lit(2)), lambda i, h: F.concat(F.lit("/_next/static/chunks/"), i, F.lit("."), h, F.lit(".css")))
        lists = [in_chunks(lists[0]), in_chunks(lists[1]), styles, lists[2]]
    elif name == "scene":
        lists[2] = whole(lists[2])
    elif name == "loaders":
        folder = lambda b: F.when(b.endswith("/"), b).otherwise(F.concat(b, F.lit("/")))
        files = F.array(*[F.lit(f) for f in DECODER_FILES])
        lists[0] = F.flatten(F.transform(whole(lists[0]), lambda b: F.transform(files, lambda f: F.concat(folder(F.trim(b)), f))))
        maps = F.regexp_extract_all(text, F.lit(_IMPORTMAP), F.lit(1))
        imports = F.transform(maps, lambda m: F.coalesce(F.map_values(F.from_json(m, "imports map<string,string>")["imports"]), F.array().cast("array<string>")))
        lists.insert(3, F.flatten(imports))
    elif name == "generic":
        lists[3] = F.transform(lists[3], lambda r: F.when(urls.unquote(r).startswith("/"), urls.unquote(r)).otherwise(F.concat(F.lit("/"), urls.unquote(r))))
    return F.concat(*lists)


def _tagged(raw: Column, order: int, name: str) -> Column:
    """array<struct>: a list's references, normalised (absolute ones only without end punctuation)."""
    tidy = (lambda r: F.regexp_replace(r, r"[.,;]+$", "")) if name == "absolute" else urls.normalize_ref
    return F.transform(raw, lambda r, i: F.struct(F.lit(order).alias("parser_order"), i.alias("pos"), F.lit(name).alias("parser"), tidy(r).alias("ref")))


def refs(bundles: DataFrame, parsers: tuple[str, ...] = tuple(PARSERS)) -> DataFrame:
    """url, parser, ref, parser_order, pos: normalised, fetchable, distinct references of bundles(url, text).

    Escapes are undone first. Absolute URLs stand under the parser ``absolute``, unchanged."""
    # All parsers' lists in one array: the text is scanned and unescaped once, and exploded once. The outer
    # form keeps Catalyst from testing that array for emptiness in a filter beforehand, and references are
    # normalised inside it, where a filter on them cannot be pushed below and repeat the work.
    plain = bundles.select("url", urls.js_unescape("text").alias("text"))
    lists = [_tagged(_literals(name, F.col("text")), order, name) for order, name in enumerate(p for p in PARSERS if p in parsers or p in ALWAYS)]
    lists.append(_tagged(F.regexp_extract_all("text", F.lit(r"(https?://[^\"'`\s<>\\]+)"), F.lit(1)), len(PARSERS), "absolute"))
    rows = plain.select("url", F.explode_outer(F.concat(*lists)).alias("x")).filter("x is not null").select("url", "x.*")
    if "webpack" in parsers:
        rows = rows.unionByName(chunk_map(bundles).select("url", F.lit("webpack").alias("parser"), F.lit(0).alias("parser_order"), F.lit(-1).alias("pos"), "ref"))
    ref = F.col("ref")
    fits = P.fetchable(ref) & ~ref.rlike("(?i)^https?://") & ~ref.contains("\\")
    asset = ~ref.rlike(r"[{}]") & urls.bundle_ext(ref).isin(*ABSOLUTE_EXTS)
    good = rows.filter(F.when(F.col("parser") == "absolute", asset).otherwise(fits))
    least = good.groupBy("url", "ref").agg(F.min(F.struct("parser_order", "pos", "parser")).alias("f"))
    return least.select("url", "f.parser", "ref", "f.parser_order", "f.pos")


def chunk_map(bundles: DataFrame) -> DataFrame:
    """url, chunk_id, hash, ref of id-to-hash maps with hashes of 12 digits or more. A chunk is called by the
    first name that a map of names gives its id, else by the id."""
    pairs = F.regexp_extract_all("text", F.lit(f"({_ID_HASH})"), F.lit(1))
    rows = bundles.select("url", F.explode(pairs).alias("p")).select("url", F.regexp_extract("p", r"^(\d+)", 1).alias("chunk_id"), F.regexp_extract("p", r"([0-9a-f]{8,64})[\"']$", 1).alias("hash"))
    rows = rows.filter(F.length("hash") >= 12).distinct()
    maps = F.array_join(F.regexp_extract_all("text", F.lit(r"""\(\{((?:\d+:["'][0-9a-f]{8}["'],?)+)\}\)"""), F.lit(1)), ",")
    named = bundles.select("url", F.posexplode(F.regexp_extract_all(maps, F.lit(r"""(\d+:["'][0-9a-f]{8})"""), F.lit(1))).alias("pos", "p"))
    names = named.groupBy("url", F.regexp_extract("p", r"^(\d+)", 1).alias("chunk_id")).agg(F.min_by(F.regexp_extract("p", "(.{8})$", 1), "pos").alias("name"))
    called = F.coalesce("name", "chunk_id")
    return rows.join(names, ["url", "chunk_id"], "left").select("url", "chunk_id", "hash", F.concat(F.lit("/_next/static/chunks/"), called, F.lit("."), "hash", F.lit(".js")).alias("ref"))


def loader_bases(text: Column, limits: Limits = Limits()) -> Column:
    """array<string>: root-absolute folders that loaders are pointed at; a leading variable is dropped."""
    raw = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (_SET_PATH, _DECODER)])
    bare = F.transform(raw, lambda b: F.regexp_replace(F.trim(b), r"^\$\{[^}]+\}", ""))
    rooted = F.transform(F.filter(bare, lambda b: b.startswith("/")), lambda b: F.when(b.endswith("/"), b).otherwise(F.concat(b, F.lit("/"))))
    return F.slice(F.array_distinct(rooted), 1, limits.bases)


def relative_refs(bundles: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """url, ref: relative asset literals of bundles(url, text) below each of the bundle's loader bases."""
    rows = bundles.select("url", loader_bases(F.col("text"), limits).alias("bases"), urls.js_unescape("text").alias("text")).filter(F.size("bases") > 0)
    literals = F.filter(F.regexp_extract_all("text", F.lit(_QUOTED_ASSET), F.lit(1)), lambda r: ~r.rlike("^(?:/|https?://|data:|blob:)"))
    # Enough literals to reach the cap, so that the product stays small.
    few = F.slice(literals, 1, limits.relative)
    made = F.slice(F.flatten(F.transform(few, lambda r: F.transform("bases", lambda b: F.concat(b, F.regexp_replace(r, r"^[./]+", ""))))), 1, limits.relative)
    tidy = F.transform(made, urls.normalize_ref)
    return rows.select("url", F.explode_outer(tidy).alias("ref")).filter(P.fetchable(F.col("ref"))).distinct()


def path_ids(bundles: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """url, pos, id: relative path literals without an extension, which can stand for a template's variable."""
    literals = F.regexp_extract_all("text", F.lit(r"""["'`]([^"'`\s<>]*/[^"'`\s<>]*)["'`]"""), F.lit(1))
    good = F.filter(literals, lambda p: ~p.contains("://") & (F.length(p) <= 120) & (urls.bundle_ext(p) == "") & ~p.rlike(r"^(?:/|\./|\.\./)"))
    return bundles.select("url", F.posexplode(F.slice(good, 1, limits.path_ids)).alias("pos", "id"))


def frame_clusters(bundles: DataFrame) -> DataFrame:
    """url, folder, prefix, ext, width, first, last, files, pad: numbered frame files grouped."""
    got = F.regexp_extract_all("text", F.lit(r"(/frames/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*?\d{1,6}\.[A-Za-z0-9]+)"), F.lit(1))
    p = r"^/frames/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]*?)(\d{1,6})\.([A-Za-z0-9]+)$"
    rows = bundles.select("url", F.explode(got).alias("r")).select("url", *[F.regexp_extract("r", p, i).alias(n) for i, n in ((1, "folder"), (2, "prefix"), (3, "digits"), (4, "e"))])
    rows = rows.select("url", "folder", "prefix", F.lower("e").alias("ext"), F.length("digits").alias("width"), F.col("digits").cast("long").alias("n"))
    out = rows.groupBy("url", "folder", "prefix", "ext", "width").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("files"))
    return out.withColumn("pad", F.when((F.col("width") >= 2) & (F.col("files") >= 2), F.col("width")).otherwise(0))


def zero_filled(n: Column, pad: Column) -> Column:
    """Padded with zeros, never cut."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(pad, F.length(s)).cast("int"), F.lit("0"))


def expand_frames(specs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """specs(template, first, last, pad) with url: one row per frame; spans that are empty or too long go."""
    ok = specs.filter(F.col("template").contains("{}") & (F.col("last") >= F.col("first")) & (F.col("last") - F.col("first") <= limits.frame_span))
    rows = ok.withColumn("n", F.explode(F.sequence("first", "last")))
    number = F.when(F.col("pad") > 0, zero_filled(F.col("n"), F.col("pad"))).otherwise(F.col("n").cast("string"))
    return rows.withColumn("frame_url", F.replace("template", F.lit("{}"), number)).drop("n")


def top_segments(docs: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """key, segment, uses, rank: most frequent path segments in quoted literals, first seen first among equals."""
    literals = F.regexp_extract_all(text, F.lit(r"""["'`]([^"'`\s<>]{1,120})["'`]"""), F.lit(1))
    paths = F.filter(literals, lambda s: s.contains("/") & ~s.contains("://"))
    segments = F.flatten(F.transform(paths, lambda s: F.split(s, "/")))
    rows = docs.select(key, F.posexplode(segments).alias("pos", "segment")).filter(F.col("segment").rlike("^[A-Za-z0-9][A-Za-z0-9_-]{1,23}$"))
    uses = rows.groupBy(key, "segment").agg(F.count("*").alias("uses"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("uses"), "pos"))
    return uses.withColumn("rank", rank).filter(F.col("rank") <= limits.top_segments).drop("pos")


def lod_gaps(parts: DataFrame, limits: Limits = Limits(), keys: tuple[str, ...] = ("root", "tail")) -> DataFrame:
    """keys, n: whole numbers missing between a group's neighbouring ones, the first few of each group."""
    nums = parts.select(*keys, F.col("num").cast("long").alias("num")).distinct()
    after = nums.withColumn("next", F.lead("num").over(Window.partitionBy(*keys).orderBy("num"))).filter(F.col("next") > F.col("num") + 1)
    # No more of a gap than can be kept is written out, however wide it is.
    missing = after.select(*keys, F.explode(F.sequence(F.col("num") + 1, F.least(F.col("next") - 1, F.col("num") + limits.gaps))).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("n"))
    return missing.withColumn("rank", rank).filter(F.col("rank") <= limits.gaps).select(*keys, F.col("n").cast("int").alias("n"))


def expand_templates(specs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """specs(prefixes, suffix, ids, fillers) with prefix, url: numbers, pooled ids and fillers after each prefix."""
    bad = lambda c: c.contains("${") | c.contains("}")
    rows = specs.filter((F.col("suffix") != "") & ~F.col("suffix").contains("${")).withColumn("prefix", F.explode(F.slice("prefixes", 1, limits.prefixes))).filter((F.col("prefix") != "") & ~bad(F.col("prefix")))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(limits.numbers - 1)), lambda i: i.cast("string"))
    fill = F.filter(F.slice("fillers", 1, limits.fillers), lambda f: (f != "") & ~bad(f))
    middles = F.concat(numbers, F.slice("ids", 1, limits.ids), fill)
    return rows.withColumn("middle", F.explode(middles)).withColumn("url", F.concat("prefix", "middle", "suffix")).drop("middle")


def live_prefixes(probes: DataFrame, answers: DataFrame) -> DataFrame:
    """Prefixes of probes(prefix, url) with at least one good answer(url)."""
    return probes.join(answers.select("url").distinct(), "url", "left_semi").select("prefix").distinct()


def id_pools(bundles: DataFrame, most: int = 300) -> DataFrame:
    """url, pos, ids: string arrays of two or more identifiers (the first `most`), one of which mixes letters and
    digits or is a path. Of a longer array the rest is left out."""
    arrays = F.regexp_extract_all("text", F.lit(r"""\[(\s*["'][A-Za-z0-9_./-]{1,64}["']\s*,[A-Za-z0-9_./"',\s-]*)\]"""), F.lit(1))
    rows = bundles.select("url", F.posexplode(arrays).alias("pos", "a"))
    each = F.filter(F.regexp_extract_all("a", F.lit(r"""["']([A-Za-z0-9_./-]{1,64})["']"""), F.lit(1)), lambda i: ~i.rlike("^_+$"))
    ids = rows.select("url", "pos", F.array_distinct(F.slice(each, 1, most)).alias("ids"))
    return ids.filter((F.size("ids") >= 2) & F.exists("ids", lambda i: i.contains("/") | ((F.length(i) >= 3) & i.rlike("[A-Za-z]") & i.rlike("[0-9]"))))


def id_pool(pools: DataFrame, each: int = 400, most: int = 800) -> DataFrame:
    """pos, id: one ordered pool of the distinct ids of all pools(url, pos, ids); the caps are part of the result."""
    rows = pools.select("url", F.col("pos").alias("array"), F.posexplode(F.slice("ids", 1, each)).alias("nth", "id")).filter(~F.col("id").rlike("^_*$"))
    least = rows.groupBy("id").agg(F.min(F.struct("url", "array", "nth")).alias("first")).orderBy("first").limit(most)
    return least.select((F.row_number().over(Window.orderBy("first")) - 1).alias("pos"), "id")


def probes(ids: Column, fillers: Column) -> Column:
    """What is tried behind a prefix to see whether it is live: 0 and 1, a sample of the ids, a few fillers."""
    good = F.filter(fillers, lambda f: (f != "") & ~f.contains("${") & ~f.contains("}"))
    return F.array_distinct(F.concat(F.array(F.lit("0"), F.lit("1")), probe_ids(ids), F.slice(good, 1, 3)))


def probe_and_expand(specs: DataFrame, answers: DataFrame, limits: Limits = Limits(numbers=30)) -> DataFrame:
    """prefix, url: specs(prefixes, suffix, ids, fillers, most) expanded for the prefixes of which a probe is among
    answers(url, text) with an asset; a page in an asset's place is no answer."""
    named = specs.select(F.slice("prefixes", 1, F.greatest(F.lit(1), F.least(F.col("most"), F.lit(64)))).alias("prefixes"), "suffix", "ids", "fillers")
    tried = named.filter((F.col("suffix") != "") & ~F.col("suffix").contains("${")).select(F.explode("prefixes").alias("prefix"), "suffix", "ids", "fillers")
    tried = tried.filter((F.col("prefix") != "") & ~F.col("prefix").rlike(r"\$\{|\}"))
    asked = tried.select("prefix", "suffix", F.explode(probes(F.col("ids"), F.col("fillers"))).alias("probe")).withColumn("url", F.concat("prefix", "probe", "suffix"))
    live = live_prefixes(asked.select("prefix", "url"), answers.filter(~P.impostor(F.col("text"))))
    kept = tried.join(live, "prefix", "left_semi").select(F.array("prefix").alias("prefixes"), "suffix", "ids", "fillers")
    return expand_templates(kept, limits).select("prefix", "url").filter(~P.telemetry(F.col("url"))).distinct()


def two_variable_templates(bundles: DataFrame, limits: Limits = Limits(), keys: int = 60, pairs: tuple[int, int] = (12, 17)) -> DataFrame:
    """url, prefixes, suffix, probe, refs of backtick literals with two variables in bundles(url, text).

    The first variable stands for its quoted alternatives, or for frequent path segments; numbers missing among
    the middles of one prefix and suffix are filled in; relative prefixes stand below each loader base. Where the second
    variable counts (or is short), `probe` is true and the prefixes are a template's, to be probed; where it does
    not count, refs are the literals without it."""
    lit = F.regexp_extract_all("text", F.lit(r"`([^`$]*\$\{[^}]+\}[^`$]*\$\{[^}]+\}[^`]*?\.[A-Za-z0-9]{2,5})`"), F.lit(1))
    rows = bundles.select("url", F.posexplode(lit).alias("pos", "lit"))
    part = lambda i: F.regexp_extract("lit", r"(?s)^([^$]*)\$\{([^}]+)\}([^$]*)\$\{([^}]+)\}(.*)$", i)
    rows = rows.select("url", "pos", part(1).alias("prefix"), part(2).alias("first"), part(3).alias("middle"), F.trim(part(4)).alias("second"), part(5).alias("suffix"))
    rows = rows.filter(~F.col("suffix").rlike(r"[${}]") & ~F.col("prefix").contains("}") & ~F.col("middle").contains("}"))
    rows = rows.groupBy("url", "prefix", "middle", "second", "suffix").agg(F.min_by("first", "pos").alias("first"), F.min("pos").alias("pos"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter(F.col("rank") <= keys)
    group = ("url", "prefix", "suffix")
    numbered = r"^(.*?)(\d+)([^/]*)$"
    cut = lambda i: F.regexp_extract("middle", numbered, i)
    parts = rows.filter(F.col("middle").rlike(numbered)).select(*group, cut(1).alias("root"), cut(3).alias("tail"), F.expr("try_cast(regexp_extract(middle, '^(.*?)([0-9]+)([^/]*)$', 2) as bigint)").alias("num")).filter("num is not null")
    gaps = lod_gaps(parts, limits, (*group, "root", "tail")).groupBy(*group).agg(F.slice(F.array_sort(F.collect_list(F.concat("root", F.col("n").cast("string"), "tail"))), 1, limits.gaps).alias("gaps"))
    fillers = top_segments(bundles, "url", "text", limits).groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda x: x["segment"]).alias("fillers"))
    bases = bundles.select("url", loader_bases(F.col("text"), limits).alias("bases"))
    rows = rows.join(gaps, list(group), "left").join(fillers, "url", "left").join(bases, "url", "left")
    none = F.array().cast("array<string>")
    quoted = F.slice(F.array_distinct(F.filter(F.regexp_extract_all("first", F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1)), lambda a: ~a.rlike(r"[${]"))), 1, 8)
    few = F.slice(F.coalesce("fillers", none), 1, 8)
    absolute = F.col("prefix").rlike("(?i)^(?:/|https?://)")
    bare = F.regexp_replace("prefix", "^[./]+", "")
    ropes = F.when(absolute, F.array("prefix")).when(F.col("prefix") == "", F.coalesce("bases", none)).otherwise(F.concat(F.transform(F.coalesce("bases", none), lambda b: F.concat(b, bare)), F.array("prefix")))
    rows = rows.withColumn("fills", F.when(F.size(quoted) > 0, quoted).otherwise(F.concat(few, F.transform(few, lambda f: F.concat(f, F.lit("/"))), F.array(F.lit(""))))).withColumn("ropes", ropes)
    rows = rows.withColumn("mid", F.explode(F.concat(F.array("middle"), F.array_remove(F.coalesce("gaps", none), F.col("middle")))))
    numeric = P.numeric_variable(F.col("second"))
    made = lambda fills, over, *rest: F.flatten(F.transform(fills, lambda f: F.transform(over, lambda b: urls.join_url(b, f, F.col("mid"), *rest))))
    fills = F.when(numeric, F.col("fills")).otherwise(F.slice("fills", 1, pairs[1]))
    return rows.select(
        "url", made(fills, F.col("ropes")).alias("prefixes"), "suffix", (numeric | (F.length("second") <= 4)).alias("probe"),
        F.when(numeric, none).otherwise(made(F.slice("fills", 1, pairs[1]), F.slice("ropes", 1, pairs[0]), F.col("suffix"))).alias("refs"),
    )


def expand_enum(specs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """specs(key, bases, ids, exts): base/id.ext in that order of nesting, the first `enum` of each key."""
    based = lambda b: F.when(b.endswith("/"), b).otherwise(F.concat(b, F.lit("/")))
    made = F.flatten(F.flatten(F.transform("bases", lambda b: F.transform("ids", lambda i: F.transform("exts", lambda e: F.concat(based(b), i, F.lit("."), e))))))
    return specs.select("key", F.posexplode(F.slice(made, 1, limits.enum)).alias("pos", "url"))


def css_refs(css: DataFrame) -> DataFrame:
    """path, ref, resolved: local url() references of stylesheets(path, text), against the file's folder."""
    got = F.array_distinct(F.regexp_extract_all("text", F.lit(r"""(?i)url\(\s*["']?([^)"'\s<>]{1,300})["']?\s*\)"""), F.lit(1)))
    rows = css.select("path", F.explode(got).alias("ref")).filter(~F.col("ref").rlike(r"(?i)^(?:data:|blob:|https?:|//|#|%23)"))
    return rows.withColumn("resolved", urls.resolve("path", "ref"))


def design_tokens(css: DataFrame) -> DataFrame:
    """kind, token: distinct colours and font names over all stylesheets."""
    colors = F.regexp_extract_all("text", F.lit(r"(#[0-9a-fA-F]{3,8}\b|rgba?\([^)]{1,60}\)|hsla?\([^)]{1,60}\))"), F.lit(1))
    fonts = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)font-family\s*:\s*([^;}]{1,200})"), F.lit(1)), lambda f: F.split(f, ",")))
    fonts = F.filter(F.transform(fonts, lambda f: F.regexp_replace(F.trim(f), "^[\"']+|[\"']+$", "")), lambda f: f != "")
    rows = css.select(F.lit("color").alias("kind"), F.explode(colors).alias("token")).unionByName(css.select(F.lit("font").alias("kind"), F.explode(fonts).alias("token")))
    return rows.distinct()


def gltf_refs(files: DataFrame) -> DataFrame:
    """url, kind, ref of glTF files(url, text): buffers and images that are no data URIs."""
    kind = "array<struct<uri:string>>"
    doc = files.select("url", F.from_json("text", f"buffers {kind}, images {kind}").alias("j"))
    each = lambda n: doc.select("url", F.lit(n).alias("kind"), F.explode(F.col(f"j.{n}.uri")).alias("ref"))
    return each("buffers").unionByName(each("images")).filter("ref is not null and ref not like 'data:%'")


def importmap_refs(pages: DataFrame) -> DataFrame:
    """page_id, name, ref of import maps in pages(page_id, html)."""
    body = F.regexp_extract("html", _IMPORTMAP, 1)
    return pages.select("page_id", F.explode(F.from_json(body, "imports map<string,string>")["imports"]).alias("name", "ref"))


def frame_sequences(bundles: DataFrame) -> DataFrame:
    """url, template, first, last, pad of `sequence:{folder, prefix, startIndex, endIndex, extension, padLength}`, read
    from the first 600 characters of its body; without folder, prefix or either index there is no sequence."""
    bodies = F.regexp_extract_all("text", F.lit(r"sequence\s*:\s*\{([^}]{1,600})"), F.lit(1))
    rows = bundles.select("url", F.explode(bodies).alias("b"))
    text = lambda k: F.regexp_extract("b", rf"{k}\s*:\s*[\"'`]([^\"'`]{{1,80}})[\"'`]", 1)
    number = lambda k: F.expr(f"try_cast(try_cast(regexp_extract(b, '{k}\\\\s*:\\\\s*([0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1) as double) as bigint)")
    ext = F.when(text("extension") == "", "webp").otherwise(text("extension"))
    template = F.concat(F.lit("/frames/"), text("folder"), F.lit("/"), text("prefix"), F.lit("{}."), ext)
    rows = rows.filter((text("folder") != "") & (text("prefix") != "")).select("url", template.alias("template"), number("startIndex").alias("first"), number("endIndex").alias("last"), F.coalesce(number("padLength"), F.lit(0)).cast("int").alias("pad"))
    return rows.filter("first is not null and last is not null").filter(~F.col("template").contains("${"))


def other_sequences(sequences: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sequences that no cluster of frame files covers: frame_sequences() minus frame_clusters(), by template and ends."""
    template = F.concat(F.lit("/frames/"), "folder", F.lit("/"), "prefix", F.lit("{}."), "ext")
    known = clusters.select("url", template.alias("template"), "first", "last").distinct()
    return sequences.join(known, ["url", "template", "first", "last"], "left_anti")


def template_specs(bundles: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """url, prefix, variable, suffix, alternatives of backtick literals with one or two variables that end in an
    asset extension; of two, the first is replaced by each of its quoted alternatives (or left out)."""
    exts = r"\.(?:" + ASSET_EXTS + ")"
    two = r"`([^`$]{0,200}(?:\$\{[^}`]+\}[^`$]+)?\$\{[^}`]+\}[^`$]*?" + exts + r")`"
    rows = bundles.select("url", F.posexplode(F.regexp_extract_all("text", F.lit(two), F.lit(1))).alias("pos", "lit"))
    quoted = lambda c: F.slice(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1)), lambda a: ~a.rlike(r"[${]"))), 1, 8)
    pair = F.col("lit").rlike(r"\$\{[^}]*\}.*\$\{")
    first = F.regexp_extract("lit", r"^[^$]*\$\{([^}]*)\}", 1)
    fills = F.when(pair & (F.size(quoted(first)) > 0), quoted(first)).when(pair, F.array(F.lit(""))).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("url", "pos", "lit", F.explode(fills).alias("fill"))
    one = F.when(F.col("fill").isNull(), F.col("lit")).otherwise(F.concat(F.regexp_extract("lit", r"^([^$]*)\$\{", 1), F.col("fill"), F.regexp_extract("lit", r"^[^$]*\$\{[^}]*\}(.*)$", 1)))
    part = lambda i: F.regexp_extract("one", r"(?s)^([^$]*)\$\{([^}]*)\}(.*)$", i)
    return rows.select("url", "pos", one.alias("one")).select("url", "pos", part(1).alias("prefix"), part(2).alias("variable"), part(3).alias("suffix"), quoted(part(2)).alias("alternatives"))


def probe_ids(ids: Column, tries: int = 25) -> Column:
    """A systematic sample of an id array: the first two, evenly spaced ones, the last."""
    n = F.size(ids)
    spaced = F.transform(F.sequence(F.lit(1), F.lit(tries - 1)), lambda i: F.bround(n * i / tries).cast("int"))
    places = F.array_distinct(F.filter(F.concat(F.array(F.lit(0), F.lit(1)), spaced, F.array(n - 1)), lambda p: (p >= 0) & (p < n)))
    return F.transform(places, lambda p: F.get(ids, p))


def lottie_refs(files: DataFrame) -> DataFrame:
    """url, ref of animation files(url, text): asset folder and name, no data URIs."""
    rows = files.select("url", F.explode(F.from_json("text", "assets array<struct<u:string,p:string>>")["assets"]).alias("a"))
    return rows.select("url", F.concat(F.coalesce("a.u", F.lit("")), F.col("a.p")).alias("ref")).filter("ref is not null and ref not like 'data:%'")


def embedded_urls(files: DataFrame) -> DataFrame:
    """url, ref: distinct absolute URLs anywhere in a file's text, up to white space or a quote."""
    return files.select("url", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"""(https?://[^"'\s<>\\]+)"""), F.lit(1)))).alias("ref"))


def deep_files(files: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Files that can name further files: scenes, and JSON below a size."""
    low = F.lower("path")
    return files.filter(low.rlike(r"\.(gltf|glb|splinecode)$") | (low.endswith(".json") & (F.col("size") < limit)))


def stylesheets(files: DataFrame) -> DataFrame:
    """The style sheets of files(path, ...), by extension."""
    return files.filter(F.lower("path").endswith(".css"))


def api_hints(responses: DataFrame) -> DataFrame:
    """url, ref: asset references in JSON response bodies."""
    return responses.select("url", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf'(?i)"((?:https?:/)?/[^"\s]{{1,300}}\.(?:{ASSET_EXTS}))"'), F.lit(1)))).alias("ref"))
