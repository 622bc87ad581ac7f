"""Derived corpora: web material the raw pages lack, built from `pages` by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = "select page_id, url, html, cast(page_id as string) as id, md5(cast(page_id as string)) as h from pages"

SQL = {
    "derived_pages": f"""select page_id, url, case cast(page_id % 7 as int)
 when 0 then concat('<html><head><link rel="stylesheet" href="/_next/static/css/',substr(h,1,8),'.css"><script src="/_next/static/chunks/webpack-',substr(h,1,16),'.js"></script></head><body><img src="/_next/image?url=%2Fimg%2F',id,'.png&amp;w=640&amp;q=75"></body></html>')
 when 1 then concat('<html><head><script src="/_next/static/chunks/turbopack-',substr(h,1,12),'.js"></script></head><body data-hero="/media/',id,'.avif"></body></html>')
 when 2 then concat('<html><head><link rel="stylesheet" href="/_astro/p.',substr(h,1,8),'.css"></head><body><img src="/img/a',id,'.avif" srcset="/img/a',id,'.avif 1x, /img/b',id,'.avif 2x"></body></html>')
 when 3 then concat('<html><body><div id="root"></div><script type="module" src="/assets/index-',substr(h,1,8),'.js"></script></body></html>')
 when 4 then concat('<html><head><link rel="modulepreload" href="/x/Foo.svelte-',substr(h,1,8),'.js"></head><body><a href="/p/',cast((page_id*2)%50 as string),'">n</a></body></html>')
 when 5 then concat('<html><head><script src="/js/bundle.',substr(h,1,8),'.js"></script></head><body><video src="/v/',id,'.mp4" poster="/v/',id,'.jpg"></video></body></html>')
 else html end as html from ({_BASE}) t""",
    "derived_bundles": """select page_id as bundle_id, concat('/assets/b',id,'.js') as url,
 concat('import("/assets/b',cast((page_id*2)%n as string),'.js");import("/assets/b',cast((page_id*2+1)%n as string),'.js");',
 'f("/frames/v',cast(page_id%3 as string),'/f',lpad(id,4,'0'),'.webp");f("/frames/v',cast(page_id%3 as string),'/f',lpad(cast(page_id+3 as string),4,'0'),'.webp");',
 'x.load(`/models/m',id,'/lod_',concat('$','{i}'),'.glb`);var m={',cast(100+page_id as string),':"',substr(h,1,16),'"};ids=["hair',id,'","coat',id,'"];') as text
 from (select page_id, cast(page_id as string) as id, md5(cast(page_id as string)) as h, (select count(*) from pages) as n from pages) t""",
    "derived_edges": "select page_id as src, (page_id*2)%n as dst from (select page_id, (select count(*) from pages) as n from pages) t union all select page_id, (page_id*2+1)%n from (select page_id, (select count(*) from pages) as n from pages) t",
    "derived_files": "select concat('/img/a',cast(page_id as string),'.avif') as path from pages where page_id % 3 <> 0 union all select concat('/v/',cast(page_id as string),'.mp4') from pages where page_id % 3 <> 0",
    "derived_css": f"""select concat('/css/',id,'.css') as path, concat('@font-face{{src:url(/f/',id,'.woff2)}} a{{color:#',substr(h,1,6),';background:rgb(',cast(page_id%256 as string),',0,0) url("../img/',id,'.png");font-family:"Font ',cast(page_id%9 as string),'", serif}} b{{background:url(https://cdn.example.org/x.png);color:hsl(',cast(page_id%360 as string),',50%,50%)}}') as text from ({_BASE}) t""",
    "derived_json": f"""select concat('/m/',id,'.gltf') as url, concat('{{"buffers":[{{"uri":"b',id,'.bin"}}],"images":[{{"uri":"t',id,'.png"}},{{"uri":"u',substr(h,1,4),'.jpg"}}]}}') as text from ({_BASE}) t""",
    "derived_importmaps": f"""select page_id, concat('<script type="importmap">{{"imports":{{"three":"/lib/three',cast(page_id%5 as string),'.js"}}}}</script>') as html from ({_BASE}) t""",
    "derived_routes": "select concat('/p/', cast(r as string)) as route, concat('p/', cast(r as string), '.html') as target from (select distinct (page_id*2)%50 as r from pages) t where r % 4 = 0",
    "derived_frames": "select page_id, concat('/seq/', cast(page_id%4 as string), '/f{}.webp') as template, page_id % 11 as first, page_id % 11 + page_id % 5 - 1 as last, cast(page_id % 4 as int) as pad from pages",
    "derived_lods": "select page_id, concat('/g/', cast(page_id%3 as string), '/lod-') as root, '.glb' as tail, cast(page_id % 13 * 2 as int) as num from pages where page_id % 13 <> 5",
    "derived_templates": "select page_id, concat('/t/', cast(page_id as string), '/part_') as prefix, '.drc' as suffix, array_id, page_id % 3 <> 0 as alive from (select page_id, cast(page_id % 4 as int) as array_id from pages) t",
    "derived_scripts": f"""select concat('/js/s',id,'.js') as url, concat('a.setPath("/models/p',cast(page_id%7 as string),'/");d.setDecoderPath("/draco',cast(page_id%3 as string),'");l("planets/x',id,'.drc");w("./ring',id,'.glb");parseChunk("/tb/t',substr(h,1,8),'.js");n("\\/_next\\/static\\/media\\/',substr(h,1,12),'.woff2");s("/lib/assets/audio/a',id,'");y("/fonts/f',id,'.typeface.json");{{"url":"/sw/',id,'.json"}};i("/_next/image?url=%2Fo%2F',id,'.png&w=64");k("https://cdn.example.org/lib/k',id,'.wasm");ids("set/',id,'/part")') as text from ({_BASE}) t""",
    "derived_sitemaps": f"""select concat('https://site',cast(page_id%10 as string),'.example.com/sitemap.xml') as url, concat('<urlset><loc> https://site',cast(page_id%10 as string),'.example.com/s/',id,'?q=1 </loc><loc>https://other.example.net/',id,'</loc></urlset>') as text from ({_BASE}) t""",
    "derived_playlists": f"""select concat('https://v.example.com/p/',id,'/list.m3u8') as url, concat('#EXTM3U\n#EXTINF:4,\nseg',id,'.ts\n\n/abs/',substr(h,1,6),'.ts\nhttps://cdn.example.org/x.ts\n') as text from ({_BASE}) t""",
    "derived_sequences": f"""select concat('/js/q',id,'.js') as url, concat('sequence:{{folder:"v',cast(page_id%3 as string),'",prefix:"f_",startIndex:',cast(page_id%7 as string),',endIndex:1e2,padLength:4}}') as text from ({_BASE}) t""",
    "derived_payloads": f"""select concat(case when page_id%2=0 then '/' else '' end,'api/',id,'?v=1') as path, case when page_id%5=0 then '<html>' else concat('{{"a":"/m/',id,'.glb","b":"/no/',id,'"}}') end as body from ({_BASE}) t""",
    "derived_lotties": f"""select concat('/l/',id,'.json') as url, concat('{{"assets":[{{"u":"i/","p":"',id,'.png"}},{{"u":"","p":"data:image"}}],"more":"https://a.example.org/assets/',id,'.png"}}') as text from ({_BASE}) t""",
    "derived_tree": """select concat('d',cast(page_id as string),'/index.html') as path, page_id as size from pages where page_id % 4 = 0 union all select concat('d',cast(page_id as string),'.html'), page_id from pages where page_id % 4 < 2
 union all select concat('shots/d',cast(page_id as string),'.html'), page_id from pages where page_id % 4 = 2 union all select concat('img/D',cast(page_id as string),'.PNG'), page_id from pages where page_id % 4 <> 3""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw or derived table."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace("{", "{{").replace("}", "}}").replace("from pages", "from {pages}")
    return spark.sql(text, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def with_derived(query: str) -> str:
    """DuckDB SQL with the derived corpora it names as common table expressions."""
    used = [n for n in SQL if n in query]
    head = ", ".join(f"{n} as materialized ({SQL[n]})" for n in used)
    if not used:
        return query
    return f"with recursive {head}, {query.split('with recursive ', 1)[1]}" if query.lstrip().startswith("with recursive ") else f"with {head}, {query.lstrip()[5:]}" if query.lstrip().startswith("with ") else f"with {head} {query}"
