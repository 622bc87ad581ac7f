"""Registered queries over whole tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls
from ..operators import bundles, graph, html, logs, site
from ..sources.derived import table, with_derived
from . import clone as plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_derived(sql)
        return f

    return add


_MASK = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script\b[^>]*>).*?(</script\s*>)', '\1\2', 'g')"""
_ANCHORS = f"""a as (select page_id, unnest(x) as href, unnest(range(len(x))) as pos from (select page_id, regexp_extract_all({_MASK}, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) as x from pages)),
r as (select page_id, trim(regexp_replace(href, '(?s)#.*$', '')) as route, pos from a where trim(href) <> '' and not regexp_matches(lower(trim(href)), '^(data:|blob:|mailto:|tel:|javascript:|#)') and not regexp_matches(trim(href), '^([a-zA-Z][a-zA-Z0-9+.\\-]*:)?//')),
routes as (select page_id, route, min(pos)::int as pos from r where route <> '' and route not like '?%' group by 1, 2)"""
_EXT = "lower(regexp_extract(regexp_replace({0}, '(?s)[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"with {_ANCHORS} select * from routes")
def link_routes(spark, sf):
    return html.routes(html.anchors(table(spark, sf, "pages")))


@query(f"with {_ANCHORS} select route, count(distinct page_id) as n_pages, count(*) as n_links from r where route <> '' and route not like '?%' group by 1 order by n_links desc, route limit 20")
def top_link_targets(spark, sf):
    links = html.anchors(table(spark, sf, "pages")).filter(P.same_origin(F.col("href"))).withColumn("route", F.trim(F.regexp_replace("href", "(?s)#.*$", "")))
    rows = links.filter((F.col("route") != "") & ~F.col("route").startswith("?"))
    return rows.groupBy("route").agg(F.count_distinct("page_id").alias("n_pages"), F.count("*").alias("n_links")).orderBy(F.desc("n_links"), "route").limit(20)


@query(f"select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as authority, {_PATH} as path, regexp_replace(url, '(?s)[?#].*$', '') as bare from pages")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.authority(u).alias("authority"), F.try_parse_url(u, F.lit("PATH")).alias("path"), urls.strip_query(u).alias("bare"))


@query(f"select page_id, concat(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), case when regexp_replace({_PATH}, '/+$', '') = '' then '/' else regexp_replace({_PATH}, '/+$', '') end, regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1)) as page_url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as origin from pages")
def normalize_url(spark, sf):
    page, origin = urls.normalize_url(F.regexp_replace("url", "^https://", ""))
    keep, same = urls.normalize_url(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.when(F.col("url").startswith("https://"), page).otherwise(keep).alias("page_url"), F.when(F.col("url").startswith("https://"), origin).otherwise(same).alias("origin"))


_LOCAL = f"""with t as (select page_id, {_PATH} as p, regexp_extract(regexp_replace(url, '#.*$', ''), '^[^?]*\\?(.*)$', 1) as q from pages),
s as (select page_id, q, p = '' or p like '%/' as d, array_to_string(list_transform(list_filter(str_split(p, '/'), lambda x: x <> ''), lambda x: case when regexp_replace(trim(regexp_replace(url_decode(x), '[<>:"\\\\|?*/]', '_', 'g')), '\\.+$', '') = '' then '_' else regexp_replace(trim(regexp_replace(url_decode(x), '[<>:"\\\\|?*/]', '_', 'g')), '\\.+$', '') end), '/') as b from t),
u as (select *, case when not d then b when b = '' then 'index' else b || '/index' end as stem, d or not contains(regexp_extract(b, '[^/]*$'), '.') as e from s)
select page_id, case when q <> '' and e then stem || '__' || substr(regexp_replace(url_decode(q), '[<>:"\\\\|?*/\\s]', '_', 'g'), 1, 80) || '.html' when d then stem || '.html' else b end as path from u"""


@query(_LOCAL)
def local_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.local_path(F.col("url")).alias("path"))


@query(f"select page_id, case when trim({_PATH}, '/') = '' then 'index.html' else trim({_PATH}, '/') || '.html' end as file, regexp_replace({_PATH}, '/+$', '') <> '' and lower(regexp_extract(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '[^/]*$'), '[^.](\\.[^.]*)$', 1)) in ('', '.html', '.htm') as is_page from pages")
def route_files(spark, sf):
    path = F.try_parse_url("url", F.lit("PATH"))
    return table(spark, sf, "pages").select("page_id", urls.route_file(path).alias("file"), P.page_route(path).alias("is_page"))


@query(f"select page_id, length({_MASK}) as kept, length(html) as whole from pages")
def html_masking(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(html.masked(F.col("html"))).cast("long").alias("kept"), F.length("html").cast("long").alias("whole"))


@query("select page_id, regexp_matches(lower(regexp_replace(substr(html, 1, 512), '^\\s+', '')), '^(<!doctype|<html)') as impostor from pages")
def impostor_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.impostor(F.col("html")).alias("impostor"))


_T = " or ".join(f"contains(lower(split_part(ref, '?', 1)), '{t}')" for t in P.TELEMETRY)
_REFS = "select page_id, case cast(page_id % 5 as int) when 0 then '/gtm.js?id=1' when 1 then concat('/', substr(md5(url), 1, 9), '/script.js') when 2 then 'https://www.google-analytics.com/x' else url end as ref from pages"


@query(f"select page_id, ref, {_T} or regexp_matches(lower(split_part(ref, '?', 1)), '^/[0-9a-f]{{8,}}/script\\.js') as telemetry from ({_REFS})")
def telemetry_filter(spark, sf):
    rows = spark.sql(_REFS.replace("from pages", "from {pages}"), pages=table(spark, sf, "pages"))
    return rows.withColumn("telemetry", P.telemetry(F.col("ref")))


_FRAMEWORK = """case when trim(html) = '' then 'unknown' when contains(html, '/_next/static/chunks/turbopack-') or contains(html, '__turbopack') then 'next-turbopack'
 when contains(html, '/_next/static/') or contains(html, '__NEXT_DATA__') or contains(html, 'id="__next"') then 'next-webpack' when contains(html, '/_astro/') then 'astro'
 when regexp_matches(html, '\\.svelte[-.]') then 'svelte' when regexp_matches(html, '/assets/index-[^"''\\s<>]*\\.js') then 'vite-spa'
 when regexp_matches(lower(html), 'chunks?/|_app/immutable|__vite|parcel|gatsby|_nuxt|nuxt-|bundle[.-]|app\\.[a-f0-9]{6,}\\.js') then 'unknown' else 'static' end"""


@query(f"select f as framework, case f when 'next-webpack' then 'webpack' when 'next-turbopack' then 'turbopack' when 'vite-spa' then 'vite' when 'astro' then 'astro' when 'svelte' then 'svelte' else 'generic' end as hint, count(*) as n from (select {_FRAMEWORK} as f from derived_pages) group by 1, 2")
def framework(spark, sf):
    rows = table(spark, sf, "derived_pages").select(html.framework(F.col("html")).alias("framework"))
    return rows.groupBy("framework", html.parser_hint(F.col("framework")).alias("hint")).agg(F.count("*").alias("n"))


@query(f"""with {_ANCHORS}, d as (select page_id, unnest(regexp_extract_all(html, '(?:src|href|poster|srcset|data-hero)="([^"]+)"', 0)) as m from derived_pages where html not in (select html from pages)),
v as (select page_id, split_part(m, '=', 1) as attr, replace(regexp_extract(m, '"(.*)"', 1), '&amp;', '&') as v from d),
x as (select page_id, attr, unnest(case when attr = 'srcset' then list_transform(str_split(v, ', '), lambda s: split_part(s, ' ', 1)) else [v] end) as ref from v),
b as (select page_id, ref, case when attr = 'data-hero' then 'data_attrs' when ref like '/p/%' then 'routes' when contains(ref, '/_next/image?url=') then 'images' when {_EXT.format('ref')} = 'css' then 'stylesheets' when attr = 'href' then 'links' when {_EXT.format('ref')} = 'js' then 'scripts' when {_EXT.format('ref')} = 'mp4' then 'videos' else 'images' end as bucket from x)
select bucket, count(distinct (page_id, ref)) as n_refs, count(distinct page_id) as n_pages from (select * from b union all select page_id, ref, 'next_images' from b where contains(ref, '/_next/image?url=')
 union all select page_id, url_decode(regexp_extract(ref, 'url=([^&]+)', 1)), 'images' from b where contains(ref, '/_next/image?url=')
 union all select page_id, replace(route, '&amp;', '&'), 'routes' from routes join derived_pages using (page_id) where html in (select html from pages)) group by 1""")
def asset_buckets(spark, sf):
    rows = html.assets(table(spark, sf, "derived_pages"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n_refs"), F.count_distinct("page_id").alias("n_pages"))


@query("select page_id, unnest(['/img/a' || page_id || '.avif', '/img/b' || page_id || '.avif']) as url from pages where page_id % 7 = 2")
def srcset_candidates(spark, sf):
    value = F.regexp_extract("html", r'srcset="([^"]*)"', 1)
    return table(spark, sf, "derived_pages").filter(value != "").select("page_id", F.explode(urls.srcset(value)).alias("url"))


@query("""with f as (select url, unnest(regexp_extract_all(text, '/frames/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]*?\\d{1,6}\\.[A-Za-z0-9]+')) as r from derived_bundles),
g as (select url, regexp_extract(r, '/frames/([^/]+)/', 1) as folder, regexp_extract(r, '/(f)\\d+\\.', 1) as prefix, regexp_extract(r, '\\.([a-z]+)$', 1) as ext, regexp_extract(r, '(\\d+)\\.[a-z]+$', 1) as d from f)
select url, folder, prefix, ext, length(d)::int as width, min(d::bigint) as first, max(d::bigint) as last, count(*) as files, case when length(d) >= 2 and count(*) >= 2 then length(d) else 0 end::int as pad from g group by url, folder, prefix, ext, length(d)""")
def frame_clusters(spark, sf):
    return bundles.frame_clusters(table(spark, sf, "derived_bundles"))


@query("select page_id, replace(template, '{}', case when pad > 0 then lpad(n::varchar, greatest(pad, length(n::varchar))::int, '0') else n::varchar end) as frame_url from (select *, unnest(range(first, last + 1)) as n from derived_frames where last >= first)")
def frame_expand(spark, sf):
    return bundles.expand_frames(table(spark, sf, "derived_frames")).select("page_id", "frame_url")


@query("""with l as (select page_id, unnest(list_filter(regexp_extract_all(html, '["''`]([^"''`\\s<>]{1,120})["''`]', 1), lambda s: contains(s, '/') and not contains(s, '://'))) as s, 1 as one from pages),
m as (select page_id, list(s) as ls from (select page_id, s, row_number() over () as o from l) group by page_id),
g as (select page_id, segs, unnest(segs) as seg, unnest(range(len(segs))) as pos from (select page_id, flatten(list_transform(list_filter(regexp_extract_all(html, '["''`]([^"''`\\s<>]{1,120})["''`]', 1), lambda s: contains(s, '/') and not contains(s, '://')), lambda s: str_split(s, '/'))) as segs from pages)),
c as (select page_id, seg as segment, count(*) as uses, min(pos) as p from g where regexp_matches(seg, '^[A-Za-z0-9][A-Za-z0-9_-]{1,23}$') group by 1, 2)
select page_id, segment, uses, rank from (select page_id, segment, uses, row_number() over (partition by page_id order by uses desc, p)::int as rank from c) where rank <= 15""")
def top_segments(spark, sf):
    return bundles.top_segments(table(spark, sf, "pages"), "page_id", "html")


@query("with g as (select root, tail, list_sort(list_distinct(list(num))) as nums from derived_lods group by 1, 2) select root, tail, unnest(list_filter(range(nums[1], nums[-1] + 1), lambda x: not list_contains(nums, x))[1:8])::int as n from g")
def lod_gaps(spark, sf):
    return bundles.lod_gaps(table(spark, sf, "derived_lods"))


_ROUTED = f"with {_ANCHORS}, p as (select page_id, route, regexp_replace(route, '(?s)[?#].*$', '') as path from routes union select page_id, concat('/p/', cast((page_id*2)%50 as varchar), '/'), concat('/p/', cast((page_id*2)%50 as varchar), '/') from pages where page_id % 7 = 4)"


def _page_refs(spark, sf):
    own = html.routes(html.anchors(table(spark, sf, "pages"))).select("page_id", F.col("route").alias("url"))
    more = table(spark, sf, "pages").filter("page_id % 7 = 4").selectExpr("page_id", "concat('/p/', cast((page_id*2)%50 as string), '/') as url")
    return own.unionByName(more).distinct().select("page_id", "url", F.lit("a").alias("tag"), F.lit("href").alias("attr"), F.lit("static").alias("framework"), F.lit(1).alias("depth"))


@query(_ROUTED + " select page_id, p.route as url, d.target from p join derived_routes d on d.route = rtrim(p.path, '/')")
def route_lookup(spark, sf):
    refs = _page_refs(spark, sf).withColumn("path", urls.strip_query(F.col("url")))
    return site.lookup_routes(refs, table(spark, sf, "derived_routes")).filter("target is not null").select("page_id", "url", "target")


@query(_ROUTED + " select path as route, count(distinct page_id) as n_pages from p left join derived_routes d on d.route = rtrim(p.path, '/') where d.target is null and path like '/%' and not (contains(regexp_extract(path, '[^/]*$'), '.') and regexp_extract(path, '[^/]*$') not like '.%') group by 1")
def missing_routes(spark, sf):
    rows = site.rewritten(_page_refs(spark, sf), table(spark, sf, "derived_routes")).filter("missing is not null")
    return rows.groupBy(F.col("missing").alias("route")).agg(F.count_distinct("page_id").alias("n_pages"))


_FILE_REFS = "select page_id, unnest(['img/a' || page_id || '.avif', './v/' || page_id || '.mp4', '/left/' || page_id || '.png', 'https://x.example/' || page_id]) as ref from pages"


@query(f"with f as (select substr(path, 2) as path from derived_files) select page_id, ref, case when ref like '/%' then 'absolute' else 'missing' end as problem from ({_FILE_REFS}) where ref not like 'https:%' and (ref like '/%' or regexp_replace(ref, '^\\./', '') not in (select path from f))")
def path_problems(spark, sf):
    i = F.col("page_id").cast("string")
    refs = table(spark, sf, "pages").select("page_id", F.explode(F.array(F.concat(F.lit("img/a"), i, F.lit(".avif")), F.concat(F.lit("./v/"), i, F.lit(".mp4")), F.concat(F.lit("/left/"), i, F.lit(".png")), F.concat(F.lit("https://x.example/"), i))).alias("ref"))
    return site.path_problems(refs, table(spark, sf, "derived_files").select(F.expr("substr(path, 2)").alias("path")))


@query("select distinct '/img/a' || page_id || '.avif' as path from pages where page_id % 3 = 0")
def missing_files(spark, sf):
    refs = table(spark, sf, "pages").selectExpr("concat('/img/a', cast(page_id as string), '.avif') as ref")
    return site.missing_files(refs, table(spark, sf, "derived_files"))


@query("select distinct url, concat('/assets/b', unnest([(page_id*2)%n, (page_id*2+1)%n])::varchar, '.js') as ref from (select page_id, (select count(*) from pages) as n, '/assets/b' || page_id || '.js' as url from pages)")
def bundle_refs_vite(spark, sf):
    return bundles.refs(table(spark, sf, "derived_bundles"), ("vite",)).filter(P.bundle_ref(F.col("ref"))).select("url", "ref")


@query("select url, ref from (select distinct url, unnest(regexp_extract_all(text, '\"((?:/frames|/assets)/[^\"]+)\"', 1)) as ref from derived_bundles)")
def bundle_refs_generic(spark, sf):
    return bundles.refs(table(spark, sf, "derived_bundles"), ()).select("url", "ref")


@query("select '/assets/b' || page_id || '.js' as url, cast(100 + page_id as varchar) as chunk_id, substr(md5(cast(page_id as varchar)), 1, 16) as hash, '/_next/static/chunks/' || cast(100 + page_id as varchar) || '.' || substr(md5(cast(page_id as varchar)), 1, 16) || '.js' as ref from pages")
def bundle_chunk_map(spark, sf):
    return bundles.chunk_map(table(spark, sf, "derived_bundles"))


@query("select '/assets/b' || page_id || '.js' as url, array_to_string(['hair' || page_id, 'coat' || page_id], ',') as ids from pages")
def id_pools(spark, sf):
    return bundles.id_pools(table(spark, sf, "derived_bundles")).select("url", F.array_join("ids", ",").alias("ids"))


def _template_specs(spark, sf):
    return table(spark, sf, "derived_templates").select(F.array("prefix").alias("prefixes"), "suffix", F.array(F.concat(F.lit("id"), F.col("array_id").cast("string"))).alias("ids"), F.array(F.lit("low"), F.lit("${bad}")).alias("fillers"), "alive")


_TEMPLATE = "select prefix, prefix || m || suffix as url, alive from (select *, unnest(list_concat(list_transform(range(0, 50), lambda i: i::varchar), ['id' || array_id, 'low'])) as m from derived_templates)"


@query(f"select prefix, url from ({_TEMPLATE})")
def template_expand(spark, sf):
    return bundles.expand_templates(_template_specs(spark, sf)).select("prefix", "url")


@query("select distinct prefix from derived_templates where alive")
def live_prefixes(spark, sf):
    made = bundles.expand_templates(_template_specs(spark, sf))
    return bundles.live_prefixes(made.select("prefix", "url"), made.filter("alive and url like '%_1.drc'").select("url"))


@query("select 'k' || page_id as key, (unnest(range(0, 4)))::int as pos, unnest(['/e/x.glb', '/e/x.ktx2', '/e/' || page_id || '.glb', '/e/' || page_id || '.ktx2']) as url from pages")
def enum_expand(spark, sf):
    i = F.col("page_id").cast("string")
    specs = table(spark, sf, "pages").select(F.concat(F.lit("k"), i).alias("key"), F.array(F.lit("/e")).alias("bases"), F.array(F.lit("x"), i).alias("ids"), F.array(F.lit("glb"), F.lit("ktx2")).alias("exts"))
    return bundles.expand_enum(specs)


_EDGES = "select page_id as s, unnest([(page_id*2)%n, (page_id*2+1)%n]) as d from (select page_id, (select count(*) from pages) as n from pages)"


@query(f"with recursive e as (select distinct '/assets/b' || s || '.js' as src, '/assets/b' || d || '.js' as dst from ({_EDGES})), c as (select '/assets/b1.js' as node, 0 as depth union select e.dst, c.depth + 1 from c join e on e.src = c.node where c.depth < 3) select node, min(depth)::int as depth from c group by 1")
def bundle_closure(spark, sf):
    edges = bundles.refs(table(spark, sf, "derived_bundles"), ("vite",)).filter(P.bundle_ref(F.col("ref"))).select(F.col("url").alias("src"), F.col("ref").alias("dst"))
    return graph.closure(edges, spark.createDataFrame([("/assets/b1.js",)], "node string"), 3)


@query(f"with recursive e as (select distinct s as src, d as dst from ({_EDGES})), c as (select 1::bigint as node, 0 as depth union select e.dst, c.depth + 1 from c join e on e.src = c.node where c.depth < 5) select node, min(depth)::int as depth from c group by 1 order by 2, 1 limit 40")
def page_crawl(spark, sf):
    return graph.crawl(table(spark, sf, "derived_edges"), spark.createDataFrame([(1,)], "node bigint"), 40, 5)


@query("with t as (select 'color' as kind, unnest(regexp_extract_all(text, '#[0-9a-fA-F]{3,8}\\b|rgba?\\([^)]{1,60}\\)|hsla?\\([^)]{1,60}\\)')) as token from derived_css union all select 'font', unnest(['Font ' || (page_id%9), 'serif']) from pages) select distinct kind, token from t")
def design_tokens(spark, sf):
    return bundles.design_tokens(table(spark, sf, "derived_css"))


@query("select path, '../img/' || regexp_extract(path, '(\\d+)', 1) || '.png' as ref, '/img/' || regexp_extract(path, '(\\d+)', 1) || '.png' as resolved from derived_css union all select path, '/f/' || regexp_extract(path, '(\\d+)', 1) || '.woff2', '/f/' || regexp_extract(path, '(\\d+)', 1) || '.woff2' from derived_css")
def css_refs(spark, sf):
    return bundles.css_refs(table(spark, sf, "derived_css"))


@query("select url, 'buffers' as kind, unnest(from_json(text->'$.buffers', '[{\"uri\":\"VARCHAR\"}]')).uri as ref from derived_json union all select url, 'images', unnest(from_json(text->'$.images', '[{\"uri\":\"VARCHAR\"}]')).uri from derived_json")
def gltf_refs(spark, sf):
    return bundles.gltf_refs(table(spark, sf, "derived_json"))


@query("select page_id, 'three' as name, '/lib/three' || (page_id%5) || '.js' as ref from derived_importmaps")
def importmap_refs(spark, sf):
    return bundles.importmap_refs(table(spark, sf, "derived_importmaps"))


_LOG = "select user_id || '/' || event_type as url, case when event_id % 2 = 0 then 'GET' else 'POST' end as method, case when event_id % 3 = 0 then null else cast(200 + event_id % 2 as int) end as status, event_id as seq from events"


@query(f"select url, min_by(method, seq) as method, max_by(status, seq) filter (where status is not null) as status, count(*) as n from ({_LOG}) group by url")
def request_log(spark, sf):
    return logs.request_log(spark.sql(_LOG.replace("from events", "from {events}"), events=table(spark, sf, "events")))


@query("with s as (select user_id, event_id as seq, sum(case when event_id % 5 < 3 then 1 else -1 end) over (partition by user_id order by event_id) as s from events) select user_id, seq, (s - least(0, min(s) over (partition by user_id order by seq)))::bigint as open from s")
def inflight_clamped(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id", "event_id as seq", "case when event_id % 5 < 3 then 1 else -1 end as step")
    return logs.in_flight(rows, "user_id").select("user_id", "seq", "open")


@query()
def rewrite_pages(spark, sf):
    rows = table(spark, sf, "derived_pages").withColumn("depth", (F.col("page_id") % 3).cast("int")).withColumn("framework", html.framework(F.col("html")))
    return site.rewrite_pages(rows, {"/": "index.html", "/de": "de.html", "/p/8": "p/8.html"})


@query("select path, regexp_replace(text, '(url\\(\\s*[\"'']?)/([^/])', '\\1../\\2', 'g') as text from derived_css")
def rewrite_css(spark, sf):
    return table(spark, sf, "derived_css").select("path", site.rewrite_css(F.col("text"), 1).alias("text"))


_N = {c: " or ".join(f"contains(lower(url), '{t}')" for t in terms) for c, terms in P.NOISE.items()}
_REQUESTS = "select page_id, case cast(page_id % 4 as int) when 0 then concat('/favicon.ico?', cast(page_id as string)) when 1 then concat('/', substr(md5(url), 1, 10), '/script.js') when 2 then '/sw.js' else url end as url from pages"


@query(f"select page_id, url, {_N['verify']} as ignored, {_N['serve']} or regexp_matches(lower(split_part(url, '?', 1)), '^/[0-9a-f]{{8,}}/script\\.js$') as stubbed from ({_REQUESTS})")
def noise_filters(spark, sf):
    rows = spark.sql(_REQUESTS.replace("from pages", "from {pages}"), pages=table(spark, sf, "pages"))
    return rows.select("page_id", "url", P.noise(F.col("url")).alias("ignored"), P.noise(F.col("url"), "serve").alias("stubbed"))


_SCRIPT = "select page_id, '/js/s' || page_id || '.js' as url, md5(page_id::varchar) as h, '/models/p' || (page_id%7) || '/' as b1, '/draco' || (page_id%3) || '/' as b2 from pages"


@query(f"select url, b1 as base from ({_SCRIPT}) union all select url, b2 from ({_SCRIPT})")
def loader_bases(spark, sf):
    return table(spark, sf, "derived_scripts").select("url", F.explode(bundles.loader_bases(F.col("text"))).alias("base"))


@query(f"select url, unnest([b1, b2]) || r as ref from (select *, unnest(['planets/x' || page_id || '.drc', 'ring' || page_id || '.glb']) as r from ({_SCRIPT}))")
def relative_refs(spark, sf):
    return bundles.relative_refs(table(spark, sf, "derived_scripts"))


_BY_PARSER = {
    "webpack": "'/_next/static/chunks/t' || substr(h, 1, 8) || '.js'",
    "turbopack": "unnest(['/tb/t' || substr(h, 1, 8) || '.js', '/_next/static/media/' || substr(h, 1, 12) || '.woff2'])",
    "loaders": "unnest([b2 || 'draco_decoder.js', b2 || 'draco_decoder.wasm', b2 || 'draco_wasm_wrapper.js', b2 || 'basis_transcoder.js', b2 || 'basis_transcoder.wasm', b2 || 'meshopt_decoder.js', b2 || 'meshopt_decoder.wasm', '/fonts/f' || page_id || '.typeface.json', '/sw/' || page_id || '.json'])",
    "scene": "unnest(['/draco' || (page_id%3), '/lib/assets/audio/a' || page_id, b1])",
    "absolute": "'https://cdn.example.org/lib/k' || page_id || '.wasm'",
}


def _by_parser(name: str):
    def run(spark, sf):
        found = bundles.refs(table(spark, sf, "derived_scripts"), () if name == "absolute" else (name,))
        return found.filter(F.col("parser") == name).select("url", "ref")

    run.__name__ = f"script_refs_{name}"
    return run


for _name, _sql in _BY_PARSER.items():
    query(f"select url, {_sql} as ref from ({_SCRIPT})")(_by_parser(_name))


@query("select '/js/s' || page_id || '.js' as url, 'set/' || page_id || '/part' as id from pages")
def path_ids(spark, sf):
    return bundles.path_ids(table(spark, sf, "derived_scripts")).select("url", "id")


@query("select distinct 'https://site' || (page_id%10) || '.example.com/sitemap.xml' as url, '/s/' || page_id as route from pages")
def sitemap_routes(spark, sf):
    return site.sitemap_routes(table(spark, sf, "derived_sitemaps"))


@query("select url, unnest([replace(url, 'list.m3u8', 'seg' || page_id || '.ts'), 'https://v.example.com/abs/' || substr(md5(page_id::varchar), 1, 6) || '.ts']) as segment from (select page_id, 'https://v.example.com/p/' || page_id || '/list.m3u8' as url from pages)")
def playlist_refs(spark, sf):
    return site.playlist_refs(table(spark, sf, "derived_playlists"))


@query("select '/js/q' || page_id || '.js' as url, '/frames/v' || (page_id%3) || '/f_{}.webp' as template, page_id % 7 as first, 100::bigint as last, 4 as pad from pages")
def frame_sequences(spark, sf):
    return bundles.frame_sequences(table(spark, sf, "derived_sequences"))


@query("select '/assets/b' || page_id || '.js' as url, '/models/m' || page_id || '/lod_' as prefix, 'i' as variable, '.glb' as suffix from pages")
def template_specs(spark, sf):
    return bundles.template_specs(table(spark, sf, "derived_bundles")).select("url", "prefix", "variable", "suffix")


@query("select '/api/' || page_id as path, case when page_id % 5 = 0 then '{}' else '{\"a\":\"/m/' || page_id || '.glb\",\"b\":\"/no/' || page_id || '\"}' end as body from pages union all select '/api/' || page_id || '/', case when page_id % 5 = 0 then '{}' else '{\"a\":\"/m/' || page_id || '.glb\",\"b\":\"/no/' || page_id || '\"}' end from pages")
def api_answers(spark, sf):
    asked = table(spark, sf, "pages").selectExpr("explode(array(concat('/api/', cast(page_id as string)), concat('/api/', cast(page_id as string), '/'))) as path")
    return site.api_answers(asked, site.api_payloads(table(spark, sf, "derived_payloads")))


@query("select case when page_id % 2 = 0 then '/' else '' end || 'api/' || page_id || '?v=1' as url, '/m/' || page_id || '.glb' as ref from pages where page_id % 5 <> 0")
def api_hints(spark, sf):
    return bundles.api_hints(table(spark, sf, "derived_payloads").selectExpr("path as url", "body as text"))


@query("select '/l/' || page_id || '.json' as url, 'i/' || page_id || '.png' as ref from pages")
def lottie_refs(spark, sf):
    return bundles.lottie_refs(table(spark, sf, "derived_lotties"))


@query("select '/l/' || page_id || '.json' as url, 'https://a.example.org/assets/' || page_id || '.png' as ref from pages")
def embedded_urls(spark, sf):
    return bundles.embedded_urls(table(spark, sf, "derived_lotties"))


@query("select '/d' || page_id as path, case page_id % 4 when 0 then 'd' || page_id || '/index.html' when 1 then 'd' || page_id || '.html' end as file from pages")
def serve_routes(spark, sf):
    return site.serve(table(spark, sf, "pages").selectExpr("concat('/d', cast(page_id as string)) as path"), table(spark, sf, "derived_tree"))


@query("select '/_next/image?url=%2Fx%2Fd' || page_id || '.png&w=64' as ref, case when page_id % 4 <> 3 then 'img/D' || page_id || '.PNG' end as file from pages")
def optimizer_files(spark, sf):
    refs = table(spark, sf, "pages").selectExpr("concat('/_next/image?url=%2Fx%2Fd', cast(page_id as string), '.png&w=64') as ref")
    return site.optimizer_files(refs, table(spark, sf, "derived_tree")).select("ref", "file")


@query("select count(*) as files, sum(size)::bigint as bytes, count(*) filter (where path like '%.html' and path not like 'shots/%') as pages, (select count(*) from (select distinct unnest(regexp_extract_all(text, '#[0-9a-fA-F]{3,8}\\b|rgba?\\([^)]{1,60}\\)|hsla?\\([^)]{1,60}\\)')) from derived_css)) as colors, (select count(distinct page_id % 9) + 1 from pages) as fonts from derived_tree")
def clone_summary(spark, sf):
    return logs.clone_summary(table(spark, sf, "derived_tree"), bundles.design_tokens(table(spark, sf, "derived_css")))


@query("select page_id, replace(html, 'https://example.com', '') as html, (length(html) - length(replace(html, 'https://example.com', ''))) // 19 as n from (select page_id, html || url || ' https://example.com/x' as html from pages)")
def strip_origin(spark, sf):
    text, n = site.strip_origin(F.expr("concat(html, url, ' https://example.com/x')"), "https://example.com")
    return table(spark, sf, "pages").select("page_id", text.alias("html"), n.alias("n"))


@query("select '/g/' || page_id || '.' || e as url, 400 + page_id % 2 as status from (select page_id, unnest(['png', 'js']) as e from pages) where not (e = 'png' and page_id % 2 = 0)")
def failed_requests(spark, sf):
    asked = table(spark, sf, "pages").selectExpr("page_id", "explode(array('png', 'js', 'mp4', 'png?_rsc=1')) as e").selectExpr("concat('/g/', cast(page_id as string), '.', e) as url", "400 + page_id % 2 as status")
    files = table(spark, sf, "pages").selectExpr("explode(array(concat('g/', cast(page_id * 2 as string), '.png'), concat('g/h', cast(page_id as string), '.js'))) as path").unionByName(table(spark, sf, "pages").selectExpr("concat('g/', cast(page_id - page_id % 2 as string), '.png') as path"))
    return site.failed_requests(asked, files)


def _values(spark, sf, text):
    """Rows that Spark and DuckDB make by the same SQL from the raw pages."""
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("from pages", "from {pages}"), pages=table(spark, sf, "pages"))


_JOBS = "select concat('/img/a', cast(page_id as string), '.avif') as url from pages"


@query(f"select distinct j.url, f.path is not null as ok, substr(f.path, 2) as path from ({_JOBS}) j left join derived_files f on f.path = j.url")
def asset_fetch(spark, sf):
    return site.fetch(_values(spark, sf, _JOBS), table(spark, sf, "derived_files").select(F.col("path").alias("url")))


_SITE = "https://s.example.com"
_ASKED = f"""select concat('/img/a', cast(page_id as string), '.avif') as ref, page_id from pages union all select concat('https://other.example.net/', cast(page_id as string), '.png'), page_id from pages
 union all select concat('//s.example.com/img/a', cast(page_id as string), '.avif?v=1'), page_id from pages union all select concat('data:', cast(page_id as string)), page_id from pages"""


@query(f"select ref, case when page_id % 3 <> 0 and (ref like '/img%' or ref like '//s.example%') then 'img/a' || page_id || '.avif' end as path from ({_ASKED})")
def download_assets(spark, sf):
    held = table(spark, sf, "derived_files").filter("path like '/img/%'").selectExpr(f"explode(array(concat('{_SITE}', path), concat('{_SITE}', path, '?v=1'))) as url")
    return site.download_assets(_values(spark, sf, _ASKED).select("ref"), _SITE, held).select("ref", "path")


@query(f"""select 'page' as kind, '{_SITE}/s/' || page_id as url, page_id % 2 = 0 as ok, case when page_id % 2 = 0 then 's/' || page_id end as path from pages
 union all select 'page', '{_SITE}/', false, null union all select 'manifest', '{_SITE}/manifest.json', true, 'manifest.json'""")
def first_stage(spark, sf):
    served = table(spark, sf, "pages").filter("page_id % 2 = 0").selectExpr(f"concat('{_SITE}/s/', cast(page_id as string)) as url").unionByName(spark.createDataFrame([(f"{_SITE}/manifest.json",)], "url string"))
    return site.first_stage(_SITE, table(spark, sf, "pages").selectExpr("concat('/s/', cast(page_id as string), '/') as route"), served)


_SIZED = "select concat('f', cast(page_id as string), case cast(page_id % 5 as int) when 0 then '.gltf' when 1 then '.JSON' when 2 then '.glb' when 3 then '.css' else '.splinecode' end) as path, page_id * 100000 as size from pages"


@query(f"select path, size from ({_SIZED}) where path not like '%.css' and (path not like '%.JSON' or size < 2000000)")
def deep_files(spark, sf):
    return bundles.deep_files(_values(spark, sf, _SIZED))


@query(f"select path from ({_SIZED}) where path like '%.css'")
def stylesheets(spark, sf):
    return bundles.stylesheets(_values(spark, sf, _SIZED)).select("path")


@query(f"select page_id, case when trim(regexp_replace({_PATH}, '[^A-Za-z0-9_-]+', '_', 'g'), '_') = '' then 'home' else trim(regexp_replace({_PATH}, '[^A-Za-z0-9_-]+', '_', 'g'), '_') end as slug, regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '[^A-Za-z0-9.-]+', '-', 'g') || '-clone' as folder from pages")
def copy_names(spark, sf):
    origin = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", urls.route_slug(F.try_parse_url("url", F.lit("PATH"))).alias("slug"), urls.clone_name(origin).alias("folder"))


_TYPED = f"select page_id, case cast(page_id % 4 as int) when 0 then concat('{_SITE}/a/', cast(page_id as string), '/?q=1') when 1 then concat('b/', cast(page_id as string), '#x') when 2 then '{_SITE}' else 'https://o.example.net/x' end as ref from pages"


@query(f"""select page_id, ref, case page_id % 4 when 0 then '/a/' || page_id when 1 then '/b/' || page_id when 2 then '/' end as route,
 case page_id % 4 when 0 then '/a/' || page_id || '/?q=1' when 2 then '/' else ref end as path from ({_TYPED})""")
def canonical_routes(spark, sf):
    return _values(spark, sf, _TYPED).select("page_id", "ref", urls.canonical_route(F.col("ref"), F.lit(_SITE)).alias("route"), urls.site_path(F.col("ref"), F.lit(_SITE)).alias("path"))


_NAMED = "select page_id, case cast(page_id % 6 as int) when 0 then 'i' when 1 then 'idx' when 2 then 'url' when 3 then 'ab' when 4 then ' count ' else 'longer' end as name from pages"


@query(f"select page_id, name, page_id % 6 in (0, 1, 3, 4) as counts from ({_NAMED})")
def numeric_variables(spark, sf):
    return _values(spark, sf, _NAMED).withColumn("counts", P.numeric_variable(F.col("name")))


_SEEN = "select concat(case when page_id % 3 = 0 then '/favicon.ico?' else '/a' end, cast(page_id as string)) as url, cast(200 + 204 * (page_id % 2) as int) as status from pages"


@query(f"select count(*) filter (where status >= 400 and url not like '/favicon%') as failed, count(*) filter (where status >= 400 and url not like '/favicon%') = 0 as clean from ({_SEEN})")
def problem_summary(spark, sf):
    return site.problem_summary(_values(spark, sf, _SEEN))


_EVENTS = "select concat('/r', cast(page_id as string)) as route, case cast(page_id % 3 as int) when 0 then 'pageerror' when 1 then 'error' else 'log' end as kind, case when page_id % 2 = 0 then 'x is undefined' else 'at hotjar.js' end as text, case when page_id % 5 = 0 then 'https://www.google-analytics.com/a' else '/a.js' end as url from pages"


@query(f"""select route, kind, case kind when 'pageerror' then route || ' pageerror: ' || text else route || ' console: ' || text || ' [' || url || ']' end as problem
 from ({_EVENTS}) where (kind = 'pageerror' and text not like '%hotjar%') or (kind = 'error' and url = '/a.js')""")
def page_errors(spark, sf):
    return site.page_errors(_values(spark, sf, _EVENTS))


@query("select page_id, array_to_string(list_concat(['0', '1'], list_transform(list_sort(list_distinct(list_concat([0, 1, 29], list_transform(range(1, 25), lambda i: round_even(30 * i / 25, 0)::int)))), lambda k: 'x' || k), ['low']), ',') as tried from pages")
def probe_sets(spark, sf):
    ids = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("x"), i.cast("string")))
    return table(spark, sf, "pages").select("page_id", F.array_join(bundles.probes(ids, F.array(F.lit("low"), F.lit("${bad}"))), ",").alias("tried"))


@query("select concat('/_next/image?w=64&amp;url=', case when page_id % 2 = 0 then '%2Fi%2F' || page_id || '.png%3Fv%3D1' else 'https%3A%2F%2Fo.example.net%2Fp%2F' || page_id || '.png' end) as ref, case when page_id % 2 = 0 then 'i/' else '' end || page_id || '.png' as target from pages")
def optimizer_targets(spark, sf):
    refs = _values(spark, sf, "select concat('/_next/image?w=64&amp;url=', case when page_id % 2 = 0 then concat('%2Fi%2F', cast(page_id as string), '.png%3Fv%3D1') else concat('https%3A%2F%2Fo.example.net%2Fp%2F', cast(page_id as string), '.png') end) as ref from pages")
    return refs.withColumn("target", urls.optimizer_target(F.col("ref")))


@query("select page_id, unnest(['/a/' || page_id || '.js', './c' || (page_id % 7) || '.png']) as ref from pages")
def text_refs(spark, sf):
    rows = _values(spark, sf, "select page_id, concat('x=\"\\\\/a\\\\/', cast(page_id as string), '.js\" y=`./c', cast(page_id % 7 as string), '.png` z=\"//cdn/d.js\"') as html from pages")
    return html.text_refs(rows).select("page_id", "ref")


@query("select '/a' || i as ref, (row_number() over (order by i) - 1)::int as pos from (select distinct page_id % 20 as i from pages) union all select '/b' || page_id, page_id::int from pages")
def page_and_trace_refs(spark, sf):
    first = _values(spark, sf, "select distinct concat('/a', cast(page_id % 20 as string)) as ref, cast(page_id % 20 as int) as pos from pages")
    second = _values(spark, sf, "select concat('/b', cast(page_id as string)) as ref, cast(page_id as int) as pos from pages union all select concat('/a', cast(page_id % 20 as string)), 5 from pages")
    return html.ordered_union(first, second).select("ref", "pos")


_FRAMED = """select concat('/js/', cast(page_id as string)) as url, concat('sequence:{folder:"v",prefix:"f",startIndex:1E0,endIndex:', cast(2 + page_id % 2 as string), ',extension:"webp"} "/frames/v/f1.webp" "/frames/v/f2.webp" sequence:{folder:"only"}') as text from pages"""


@query("select '/js/' || page_id as url, '/frames/v/f{}.webp' as template, 1::bigint as first, 3::bigint as last, 0 as pad from pages where page_id % 2 = 1")
def other_sequences(spark, sf):
    rows = _values(spark, sf, _FRAMED)
    return bundles.other_sequences(bundles.frame_sequences(rows), bundles.frame_clusters(rows))


_TWO = """select concat('/js/t', cast(page_id as string), '.js') as url, concat('a.setPath("/lib/");x(`/t', cast(page_id % 3 as string), '/$', '{q?"hi":"lo"}/lod-1$', '{i}.glb`);x(`/t', cast(page_id % 3 as string), '/$', '{q?"hi":"lo"}/lod-4$', '{i}.glb`);y(`rel/$', '{q?"a":"b"}/m$', '{kind2}.drc`)') as text from pages"""


@query(f"""select '/js/t' || page_id || '.js' as url, '/t' || (page_id % 3) || '/' || unnest(['hi', 'lo', 'hi', 'lo', 'hi', 'lo', 'hi', 'lo']) || '/lod-' || unnest([1, 1, 2, 2, 3, 3, 4, 4]) as prefix, '.glb' as suffix, true as probe from pages
 union all select '/js/t' || page_id || '.js', unnest(['/lib/rel/a/m.drc', '/lib/rel/b/m.drc', 'rel/a/m.drc', 'rel/b/m.drc']), '', false from pages""")
def two_variable_templates(spark, sf):
    found = bundles.two_variable_templates(_values(spark, sf, _TWO))
    specs = found.filter("probe").select("url", F.explode("prefixes").alias("prefix"), "suffix", "probe")
    return specs.unionByName(found.filter("not probe").select("url", F.explode("refs").alias("prefix"), F.lit("").alias("suffix"), "probe")).distinct()


@query("select p as prefix, p || m || '.drc' as url from (select page_id, '/t/' || page_id || '/' as p, unnest(list_concat(list_transform(range(0, 30), lambda i: i::varchar), ['id1', 'id2', 'low'])) as m from pages where page_id % 4 = 1)")
def probe_and_expand(spark, sf):
    specs = table(spark, sf, "pages").select(F.array(F.concat(F.lit("/t/"), F.col("page_id").cast("string"), F.lit("/")), F.lit("/${bad}/")).alias("prefixes"), F.lit(".drc").alias("suffix"), F.array(F.lit("id1"), F.lit("id2")).alias("ids"), F.array(F.lit("low")).alias("fillers"), F.lit(12).alias("most"))
    answers = table(spark, sf, "pages").filter("page_id % 2 = 1").selectExpr("concat('/t/', cast(page_id as string), '/id2.drc') as url", "case when page_id % 4 = 1 then 'bytes' else ' <!doctype html>' end as text")
    return bundles.probe_and_expand(specs, answers)


@query("select (row_number() over (order by u, k) - 1)::int as pos, id from (select id, min(u) as u, min(k) as k from (select '/assets/b' || lpad((page_id)::varchar, 9, '0') as u, unnest([0, 1]) as k, unnest(['hair' || page_id, 'same']) as id from pages) group by id) order by pos limit 800")
def id_pool(spark, sf):
    rows = _values(spark, sf, "select concat('/assets/b', lpad(cast(page_id as string), 9, '0')) as url, concat('x=[\"hair', cast(page_id as string), '\",\"same\",\"__\"]') as text from pages")
    return bundles.id_pool(bundles.id_pools(rows))


_COPIED = """select page_id, concat('<img src="../img/a', cast(page_id as string), '.avif" srcset="../v/', cast(page_id as string), '.mp4 1x, ./gone.png 2x"><a href="/left">x</a><script src="/_next/turbopack-1.js"></script><meta content="/og.png"><p style="background:url(../img/none.png)">') as html, concat('p/', cast(page_id as string), '.html') as page_file, 'next-turbopack' as framework from pages"""


@query("""select page_id, unnest(case when page_id % 3 = 0 then ['../img/a' || page_id || '.avif', '../v/' || page_id || '.mp4', './gone.png', '/left', '../img/none.png'] else ['./gone.png', '/left', '../img/none.png'] end) as ref from pages""")
def verify_pages(spark, sf):
    return site.verify_pages(_values(spark, sf, _COPIED), table(spark, sf, "derived_files").select(F.expr("substr(path, 2)").alias("path"))).select("page_id", "ref")


@query("select distinct node from (select '/' as node union all select '/p' || page_id from pages union all select '/e' || (page_id % 3) from pages)")
def page_seeds(spark, sf):
    home = _values(spark, sf, "select '/' as route from pages union all select concat('/p', cast(page_id as string)) from pages union all select concat('/p', cast(page_id as string), '.png') from pages")
    return graph.page_seeds(home, home, _values(spark, sf, "select concat('/e', cast(page_id % 3 as string)) as route from pages"))


@query("select distinct page_id + k as n from pages, (select unnest(range(0, 3)) as k)")
def deep_rounds(spark, sf):
    return graph.rounds(lambda df: df.unionByName(df.select((F.col("n") + 1).alias("n"))), table(spark, sf, "pages").select(F.col("page_id").alias("n")), 2)


_MADE = """select page_id, concat('/s/', cast(page_id as string)) as route, concat('<a href="/s/', cast((page_id*2)%n as string), '">a</a><a href="https://s.example.com/s/', cast((page_id*2+1)%n as string), '">b</a><img src="/img/a', cast(page_id as string), '.avif"><img src="/img/none', cast(page_id as string), '.png">') as html from (select page_id, (select count(*) from pages) as n from pages) t"""


@query("""with recursive e as (select distinct '/s/' || s as src, '/s/' || (s*2)%n as dst from (select page_id as s, (select count(*) from pages) as n from pages)),
c as (select '/s/1' as node, 0 as depth union select e.dst, c.depth + 1 from c join e on e.src = c.node where c.depth < 50),
kept as (select node from (select node, min(depth) as d from c group by node) order by d, node limit 40),
m as (select page_id, (select count(*) from pages) as n from pages where '/s/' || page_id in (select node from kept))
select page_id, '../img/none' || page_id || '.png' as ref from m union all select page_id, '../img/a' || page_id || '.avif' from m where page_id % 3 = 0
 union all select page_id, '../s/' || (page_id*2+1)%n || '.html' from m where '/s/' || (page_id*2+1)%n not in (select node from kept)""")
def clone_site(spark, sf):
    files = table(spark, sf, "derived_files").selectExpr(f"concat('{_SITE}', path) as url")
    scripts = spark.createDataFrame([], "url string, text string")
    made = plan.clone(_values(spark, sf, _MADE), scripts, files, spark.createDataFrame([("/s/1",)], "node string"), _SITE, 40)
    return made.problems.select("page_id", "ref")
