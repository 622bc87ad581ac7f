"""Golden cases of single functions and operators."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.functions import urls
from webloom.operators import bundles, graph, html, logs, site
from webloom.sources import resources
from webloom.streaming import requests


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given_url", "want"),
    [("https://a.io/?p=1", "index__p=1.html"), ("https://a.io/", "index.html"), ("/f/x.ttf?v", "f/x.ttf"), ("/a/b.js?ver=2", "a/b.js"), ("/n/?page=2", "n/index__page=2.html"), ("/a%2F..%2Fb", "a_.._b"), ("/about", "about")],
)
def test_local_path(spark, given_url, want):
    assert value(spark, urls.local_path(F.lit(given_url))) == want


def test_url_functions(spark):
    assert value(spark, urls.route_file(F.lit("/"))) == "index.html"
    assert value(spark, urls.route_file(F.lit("/a/b/"))) == "a/b.html"
    assert value(spark, urls.unquote(F.lit("a+b%20c"))) == "a+b c"
    assert value(spark, urls.unquote(F.lit("%zz"))) == "%zz"
    assert value(spark, urls.normalize_ref(F.lit("../a//b.js,"))) == "/a/b.js"
    assert value(spark, urls.normalize_ref(F.lit("static/chunks/x.js"))) == "/_next/static/chunks/x.js"
    assert value(spark, urls.srcset(F.lit("/a b.png 1x, /c.png 480w"))) == ["/a b.png", "/c.png"]
    assert value(spark, urls.js_unescape(F.lit("\\/a\\u0026b&amp;c\\u00e9"))) == "/a&b&cé"
    page, origin = urls.normalize_url(F.lit("a.io/x/?q=1#f"))
    assert (value(spark, page), value(spark, origin)) == ("https://a.io/x?q=1", "https://a.io")
    assert value(spark, urls.canonical_route(F.lit("https://a.io/x/?q"), F.lit("https://a.io"))) == "/x"
    assert value(spark, urls.canonical_route(F.lit("https://b.io/x"), F.lit("https://a.io"))) is None
    assert value(spark, urls.join_url(F.lit("https://a.io/"), F.lit("/x"))) == "https://a.io/x"
    assert value(spark, urls.bundle_ext(F.lit("/a.GLB?x"))) == "glb"
    assert value(spark, urls.depth_prefix(F.lit(2))) == "../../"


def test_predicates(spark):
    yes = lambda c: value(spark, c)
    assert yes(P.same_origin(F.lit("/a"))) and yes(P.same_origin(F.lit("x:y")))
    assert not yes(P.same_origin(F.lit("//cdn/a"))) and not yes(P.same_origin(F.lit("mailto:a@b")))
    assert yes(P.same_origin(F.lit("https://a.io:80/x"), F.lit("https://A.io:80")))
    assert yes(P.fetchable(F.lit("/a"))) and not yes(P.fetchable(F.lit("/" + "a" * 300))) and not yes(P.fetchable(F.lit("/${x}")))
    assert yes(P.page_route(F.lit("/a/b.htm"))) and not yes(P.page_route(F.lit("/a.png"))) and not yes(P.page_route(F.lit("/")))
    assert yes(P.asset_path(F.lit("/et."))) and not yes(P.asset_path(F.lit("/.well")))
    assert yes(P.impostor(F.lit("\n\t <!DOCTYPE html>")))
    assert yes(P.keep_absolute(F.lit("next-turbopack"), F.lit("script"), F.lit("src"), F.lit("/_next/x.js")))
    assert not yes(P.keep_absolute(F.lit("next-webpack"), F.lit("script"), F.lit("src"), F.lit("/_next/x.js")))


def test_attributes_and_assets(spark):
    page = '<!-- <a href="/no"> --><script>var t="<a href=\'/no\'>"</script><img src=/a.png src="/b.png" srcset="/s 1.png 1x, /t.png 1.5x"><a href="/r#f">x</a><div data-hero="/h.avif"></div><img src="/_next/image?url=%2Fi.png&amp;w=1">'
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<a href")], "page_id long, html string")
    got = {(r.bucket, r.ref) for r in html.assets(rows).collect()}
    assert got == {
        ("images", "/a.png"), ("images", "/s 1.png"), ("images", "/t.png"), ("routes", "/r"), ("data_attrs", "/h.avif"),
        ("images", "/_next/image?url=%2Fi.png&w=1"), ("next_images", "/_next/image?url=%2Fi.png&w=1"), ("images", "/i.png"),
    }
    assert [r.route for r in html.routes(html.anchors(rows)).collect()] == ["/r"]


PAGE = '<a href="/about">x</a><a href="/gone?q">y</a><img src="/a.png" srcset="/b.png 1x, /c.png 2x"><script src="/_next/x.js">var a="/keep"</script><!-- href="/c" --><div data-x="/d.png" style="background:url(/e.png)"></div><a href="https://o.io/z">z</a><img src="/_next/image?url=%2Fi%2Fj.png&amp;w=1">'


def rewrite(spark, page, depth=0, framework="static"):
    rows = spark.createDataFrame([(1, page, depth, framework)], "page_id long, html string, depth int, framework string")
    return site.rewrite_pages(rows, {"/about": "about.html"}).first()


def test_rewrite(spark):
    got = rewrite(spark, PAGE)
    for part in ('href="./about.html"', 'href="./gone.html?q"', 'src="./a.png"', "./b.png 1x, ./c.png 2x", 'src="./_next/x.js"', '"/keep"', '<!-- href="/c" -->', 'data-x="/d.png"', "url(./e.png)", 'href="https://o.io/z"', 'src="./i/j.png"'):
        assert part in got.html, part
    assert got.missing == ["/gone"]
    assert rewrite(spark, got.html).html == got.html
    deep = rewrite(spark, PAGE, 1, "next-turbopack").html
    assert 'href="../about.html"' in deep and 'src="/_next/x.js"' in deep


def test_css_and_origin(spark):
    assert value(spark, site.rewrite_css(F.lit("a{b:url(/x.png) url('//c/y') url(z)}"))) == "a{b:url(../../x.png) url('//c/y') url(z)}"
    text, n = site.strip_origin(F.lit("https://a.io/x https://a.io/y"), "https://a.io")
    assert (value(spark, text), value(spark, n)) == ("/x /y", 2)


def test_frames_and_templates(spark):
    specs = spark.createDataFrame([("/f{}.webp", 9, 11, 2), ("/g{}.png", 0, 5001, 0), ("/h{}.png", 3, 2, 0), ("/i", 1, 2, 0)], "template string, first long, last long, pad int")
    assert sorted(r.frame_url for r in bundles.expand_frames(specs).collect()) == ["/f09.webp", "/f10.webp", "/f11.webp"]
    one = spark.createDataFrame([("u", 'f("/frames/v/a7.webp")')], "url string, text string")
    assert bundles.frame_clusters(one).first().pad == 0
    assert value(spark, bundles.zero_filled(F.lit(12345), F.lit(4))) == "12345"


def test_closure_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(edges, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.crawl(edges, spark.createDataFrame([("a",)], "node string"), 3).count() == 3


def test_serving(spark):
    files = spark.createDataFrame([("index.html",), ("a.html",), ("b/index.html",), ("i/J.PNG",)], "path string")
    asked = spark.createDataFrame([("/",), ("/a",), ("/b/",), ("/none",), ("/i/J.PNG?v",), ("/i",)], "path string")
    assert {r.path: r.file for r in site.serve(asked, files).collect()} == {"/": "index.html", "/a": "a.html", "/b/": "b/index.html", "/none": None, "/i/J.PNG?v": "i/J.PNG", "/i": None}
    both = spark.createDataFrame([("c/c.html",), ("c.html",)], "path string")
    assert site.serve(spark.createDataFrame([("/c",)], "path string"), both).first().file == "c/c.html"
    refs = spark.createDataFrame([("/_next/image?url=%2Fx%2Fj.png&w=1",)], "ref string")
    assert site.optimizer_files(refs, files).first().file == "i/J.PNG"


def test_sources(spark, tmp_path):
    import gzip
    import struct

    body = json.dumps({"buffers": [{"uri": "b.bin"}, {"uri": "data:x"}]}).encode()
    body += b" " * (200 - len(body))
    glb = struct.pack("<4sIIII", b"glTF", 2, 20 + len(body), len(body), 0x4E4F534A) + body
    rows = spark.createDataFrame([("u", bytearray(glb)), ("v", bytearray(gzip.compress(b"hi"))), ("w", bytearray(b"\xff\xfeok"))], "url string, content binary")
    text = rows.select("url", resources.glb_json(F.col("content")).alias("text"))
    assert [r.ref for r in bundles.gltf_refs(text.filter("text is not null")).collect()] == ["b.bin"]
    assert bytes(rows.filter("url='v'").select(resources.gunzipped("content")).first()[0]) == b"hi"
    assert rows.filter("url='w'").select(resources.decoded(F.col("content"))).first()[0].endswith("ok")
    log = logs.request_log(spark.createDataFrame([("a", "GET", None, 1), ("a", "POST", 200, 2), ("a", "GET", None, 3)], "url string, method string, status int, seq long"))
    assert tuple(log.first()) == ("a", "GET", 200, 3)
    resources.write_trace(log, f"{tmp_path}/trace")
    assert resources.read_trace(spark, f"{tmp_path}/trace").count() == 1


def test_site_sources(spark):
    maps = spark.createDataFrame([("https://a.io/sitemap.xml", "<loc> https://a.io/x </loc><loc>https://b.io/y</loc><loc>https://a.io</loc>")], "url string, text string")
    assert sorted(r.route for r in site.sitemap_routes(maps).collect()) == ["/", "/x"]
    lists = spark.createDataFrame([("https://a.io/v/p.m3u8", "#EXTM3U\nseg1.ts\n\nhttps://b.io/s.ts\n/abs.ts")], "url string, text string")
    assert sorted(r.segment for r in site.playlist_refs(lists).collect()) == ["https://a.io/abs.ts", "https://a.io/v/seg1.ts"]


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 2}", "GET", 200 if i % 3 else None, "p") for i in range(10)], "s long, url string, method string, status int, page string").withColumn("ts", F.timestamp_seconds("s"))
    rows.drop("s").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, method string, status int, page string, ts timestamp").parquet(f"{tmp_path}/in")
    q = requests.request_log(stream).writeStream.outputMode("complete").format("memory").queryName("log").start()
    q.processAllAvailable()
    q.stop()
    assert {r.url: r.n for r in spark.table("log").collect()} == {"u0": 5, "u1": 5}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["/a", "/b/c", "//x", "https://o/z", "#", "/p.png", "q"]), st.sampled_from(["href", "src"])), max_size=6))
def test_rewrite_is_idempotent(spark, parts):
    page = "".join(f'<a {attr}="{ref}">' for ref, attr in parts)
    once = rewrite(spark, page).html
    assert rewrite(spark, once).html == once


def test_bundle_literals(spark):
    text = "sequence:{folder:'v',prefix:'a',startIndex:1,endIndex:1e1,padLength:3} l(`/m/${i}.glb`) l(`/m/${a?'hi':\"lo\"}/p_${n}.drc`)"
    one = spark.createDataFrame([("u", text)], "url string, text string")
    assert [tuple(r)[1:] for r in bundles.frame_sequences(one).collect()] == [("/frames/v/a{}.webp", 1, 10, 3)]
    assert {(r.prefix, r.variable, r.suffix) for r in bundles.template_specs(one).collect()} == {("/m/", "i", ".glb"), ("/m/hi/p_", "n", ".drc"), ("/m/lo/p_", "n", ".drc")}
    ids = value(spark, bundles.probe_ids(F.array(*[F.lit(f"i{k}") for k in range(60)])))
    assert ids[:2] == ["i0", "i1"] and ids[-1] == "i59" and len(ids) == 27
    lottie = spark.createDataFrame([("u", '{"assets":[{"u":"i/","p":"a.png"},{"p":"data:x"}]}')], "url string, text string")
    assert [r.ref for r in bundles.lottie_refs(lottie).collect()] == ["i/a.png"]
    assert [r.ref for r in bundles.embedded_urls(spark.createDataFrame([("u", '"https://a.io/assets/q.png" x')], "url string, text string")).collect()] == ["https://a.io/assets/q.png"]
    assert bundles.deep_files(spark.createDataFrame([("a.GLB", 9), ("b.json", 3_000_000), ("c.json", 5)], "path string, size long")).count() == 2
    assert [r.ref for r in bundles.api_hints(spark.createDataFrame([("u", '{"a":"/m/x.glb","b":"no"}')], "url string, text string")).collect()] == ["/m/x.glb"]


def test_text_refs_and_payloads(spark):
    page = spark.createDataFrame([(1, 'x="\\/a\\/b.js" y=\'./c.png\' z="//cdn/d.js"')], "page_id long, html string")
    assert {r.ref for r in html.text_refs(page).collect()} == {"/a/b.js", "./c.png"}
    made = site.api_payloads(spark.createDataFrame([("api/x?q", '{"a":1}'), ("/bad", "{")], "path string, body string"))
    asked = spark.createDataFrame([("/api/x",), ("/api/x/",), ("/none",)], "path string")
    assert {r.path: r.body for r in site.api_answers(asked, made).collect()} == {"/api/x": '{"a":1}', "/api/x/": '{"a":1}', "/none": "{}"}
    assert value(spark, urls.optimizer_target(F.lit("./_next/image?w=1&amp;url=https%3A%2F%2Fo.io%2Fp%2Fq.png"))) == "q.png"
    assert value(spark, urls.route_slug(F.lit("/a/b%20c"))) == "a_b_c" and value(spark, urls.clone_name(F.lit("https://a.io:80"))) == "a.io-80-clone"
    assert value(spark, P.noise(F.lit("data:x"))) and value(spark, P.noise(F.lit("/sw.js"), "serve")) and not value(spark, P.noise(F.lit("/a.js")))
    assert value(spark, P.numeric_variable(F.lit("idx"))) and not value(spark, P.numeric_variable(F.lit("url")))
    assert value(spark, site.dns_failure(F.lit("getaddrinfo failed")))


def test_problem_summary(spark):
    events = spark.createDataFrame([("/a.js", 404), ("/favicon.ico", 404), ("data:x", 500), ("/b.js", 200)], "url string, status int")
    assert tuple(site.problem_summary(events).first()) == (1, False)


def found(spark, text, *parsers):
    rows = bundles.refs(spark.createDataFrame([("u", text), ("v", None), ("w", "")], "url string, text string"), parsers)
    return {(r.parser, r.ref) for r in rows.collect()}


def test_parsers(spark):
    got = found(spark, """setDecoderPath('/d') x={"url":"/sw.json"} i("\\/_next\\/image?url=%2Fo.png&w=1") k("https://c.io/a.wasm.") k("https://c.io/page")""")
    assert {("loaders", "/d/draco_decoder.wasm"), ("loaders", "/d/meshopt_decoder.js"), ("loaders", "/sw.json"), ("generic", "/o.png"), ("absolute", "https://c.io/a.wasm")} <= got
    assert not any("c.io/page" in ref for _, ref in got)
    got = found(spark, 'n({12:"aaaabbbb",34:"ccccdddd"});n({12:"eeeeffff"});m={12:"0123456789abcdef",34:"01234567",56:"0123456789ab"};miniCssF{78:"00ff00ff"}', "webpack")
    assert {r for p, r in got if p == "webpack"} == {"/_next/static/chunks/aaaabbbb.0123456789abcdef.js", "/_next/static/chunks/56.0123456789ab.js", "/_next/static/chunks/78.00ff00ff.css"}
    assert ("turbopack", "/a/t.js") in found(spark, 'parseChunk(x,"/a/t.js")', "turbopack")
    assert ("vite", "m/x.glb") in found(spark, 'l("m/x.glb")', "vite")
    assert ("loaders", "/lib/t.js") in found(spark, """<script type="importmap">{"imports":{"t":"/lib/t.js"}}</script><script type="importmap">{bad</script>""")


def test_chunk_ids_are_read_whole(spark):
    text = 'n({594603:"aaaabbbb"});m={594603:"0123456789abcdef",94603:"0123456789abcdef","1234567890123": "00112233445566",7:"0123456789ab"};miniCssF{123456:"00ff00ff"}'
    got = bundles.chunk_map(spark.createDataFrame([("u", text)], "url string, text string"))
    chunks = {("594603", "aaaabbbb.0123456789abcdef"), ("94603", "94603.0123456789abcdef"), ("1234567890123", "1234567890123.00112233445566")}
    assert {(r.chunk_id, r.ref) for r in got.collect()} == {(i, f"/_next/static/chunks/{name}.js") for i, name in chunks}
    assert ("webpack", "/_next/static/chunks/123456.00ff00ff.css") in found(spark, text, "webpack")


def test_relative_refs(spark):
    text = "setPath('/m');setPath(`${b}/n/`);setPath('rel/');l('p/x.drc');l('../y.glb');l('/abs.glb');u('set/1/part')"
    one = spark.createDataFrame([("u", text), ("v", "l('p/x.drc')"), ("w", None)], "url string, text string")
    assert {r.ref for r in bundles.relative_refs(one).collect()} == {"/m/p/x.drc", "/n/p/x.drc", "/m/y.glb", "/n/y.glb"}
    assert bundles.relative_refs(one, bundles.Limits(relative=3)).count() == 3
    assert [r.id for r in bundles.path_ids(one).filter("url = 'u'").collect()] == ["${b}/n/", "rel/", "set/1/part"]


def test_summary_and_failures(spark):
    files = spark.createDataFrame([("a.HTML", 3), ("shots/b.html", 4), ("c.png", 5)], "path string, size long")
    tokens = spark.createDataFrame([("color", "#fff"), ("font", "x"), ("font", "y")], "kind string, token string")
    assert tuple(logs.clone_summary(files, tokens).first()) == (3, 12, 1, 1, 2)
    assert tuple(logs.clone_summary(files.limit(0), tokens.limit(0)).first()) == (0, 0, 0, 0, 0)
    asked = spark.createDataFrame([("https://a.io/c.png",), ("/gone%20x.js",), ("/v.mp4",), ("/favicon.ico",), ("/p?_rsc=1",)], "url string")
    assert [r.url for r in site.failed_requests(asked, files).collect()] == ["/gone%20x.js"]
    assert value(spark, urls.site_path(F.lit("https://A.io/x//y?q=1"), F.lit("https://a.io"))) == "/x/y?q=1"
    assert value(spark, urls.site_path(F.lit("https://a.io"), F.lit("https://a.io"))) == "/"
    assert value(spark, urls.site_path(F.lit("https://b.io/x"), F.lit("https://a.io"))) == "https://b.io/x"


def test_route_map_bound(spark):
    pages = spark.createDataFrame([(1, "", 0, "static")], "page_id long, html string, depth int, framework string")
    with pytest.raises(ValueError):
        site.rewrite_pages(pages, {f"/{i}": "x" for i in range(site.MOST_ROUTES + 1)})


def test_former_limits(spark):
    """Nothing vanishes beyond a cap: what is kept is the first part."""
    many = lambda n: "x=[" + ",".join(f'"id{k}"' for k in range(n)) + "]"
    rows = spark.createDataFrame([(str(n), many(n)) for n in (2, 300, 301, 5000)], "url string, text string")
    assert {r.url: len(r.ids) for r in bundles.id_pools(rows).collect()} == {"2": 2, "300": 300, "301": 300, "5000": 300}
    body = "sequence:{folder:'v',prefix:'a',startIndex:1E1,endIndex:1e+2," + "pad:0," * 200
    seqs = spark.createDataFrame([("long", body), ("short", body[:80] + "}"), ("bare", "sequence:{folder:'v',startIndex:1,endIndex:2}"), ("var", "sequence:{folder:'${v}',prefix:'a',startIndex:1,endIndex:2}")], "url string, text string")
    assert {(r.url, r.template, r.first, r.last) for r in bundles.frame_sequences(seqs).collect()} == {("long", "/frames/v/a{}.webp", 10, 100), ("short", "/frames/v/a{}.webp", 10, 100)}
    long = spark.createDataFrame([("u", "l(`/" + "a" * 150 + "/${i" + "i" * 100 + "}" + "b" * 100 + ".glb`)")], "url string, text string")
    assert bundles.template_specs(long).count() == 1
    parts = spark.createDataFrame([("r", "t", n) for n in (1, 3, 10**9, 10**9 + 2)] + [("s", "t", 5)], "root string, tail string, num long")
    assert [r.n for r in bundles.lod_gaps(parts).orderBy("n").collect()] == [2, *range(4, 11)]


def test_case_and_tails(spark):
    got = found(spark, 'x="/_NEXT/static/chunks/a-0123456789.js?dpl=1" w("a/Worker.JS")', "turbopack", "scene")
    assert {r for p, r in got if p in ("turbopack", "scene")} == {"/_NEXT/static/chunks/a-0123456789.js?dpl=1", "a/Worker.JS"}


def test_verification_against_folders(spark):
    files = spark.createDataFrame([("about.html",), ("a.png",), ("p/in.html",), ("img/x y.png",)], "path string")
    page = '<a href="./about.html">a</a><img src="a.png"><img src="gone.png"><a href="/left">l</a><a href="https://o.io/x">o</a><a href="#t">t</a><div data-x="/keep"></div>'
    deep = '<a href="in.html">a</a><img src="../img/x%20y.png?v=1" srcset="../a.png 1x, ../../a.png 2x"><i style="background:url(\'../img/no.png\')"></i><script src="/_next/a.js"></script>'
    rows = spark.createDataFrame([(1, page, "index.html", "static"), (2, deep, "p/in.html", "next-turbopack"), (3, deep, "p/in.html", "next-webpack"), (4, None, None, None)], "page_id long, html string, page_file string, framework string")
    got = {(r.page_id, r.ref) for r in site.verify_pages(rows, files).collect()}
    assert got == {(1, "gone.png"), (1, "/left"), (2, "../../a.png"), (2, "../img/no.png"), (3, "../../a.png"), (3, "../img/no.png"), (3, "/_next/a.js")}
    assert value(spark, urls.normal_path(F.lit("a/./b/../../c//d/.."))) == "c" and value(spark, urls.normal_path(F.lit("../../x"))) == "../../x"


def test_rewrite_with_origin(spark):
    page = '<a href="https://a.io/about">x</a><a href="https://A.IO">h</a><a href="https://a.io.evil/x">y</a><img src="/_next/image?w=1&amp;url=%2Fi.png%3Fv%3D1">'
    rows = spark.createDataFrame([(1, page, 0, "static")], "page_id long, html string, depth int, framework string")
    got = site.rewrite_pages(rows, {"/about": "about.html", "/": "index.html"}, "https://a.io").first().html
    assert got == '<a href="./about.html">x</a><a href="./index.html">h</a><a href="https://a.io.evil/x">y</a><img src="./i.png">'
    refs = spark.createDataFrame([("a", "href", u, "static", 0) for u in ("https://a.io/about", "https://o.io/x", "/_next/image?w=1&amp;url=%2Fi.png%3Fv%3D1")], "tag string, attr string, url string, framework string, depth int")
    routes = spark.createDataFrame([("/about", "about.html")], "route string, target string")
    assert {r.new_url for r in site.rewritten(refs, routes, "https://a.io").collect()} == {"./about.html", "https://o.io/x", "./i.png"}


def test_downloads_and_reports(spark):
    origin = "https://a.io"
    one = lambda r: value(spark, urls.downloadable(F.lit(r), F.lit(origin)))
    assert [one(r) for r in ("", " #x", "data:x", "mailto:a", "//b.io/x", "x/y", "/z")] == [None, None, None, None, "https://b.io/x", "https://a.io/x/y", "https://a.io/z"]
    report = site.verification(spark.createDataFrame([("x.png",)], "ref string"), spark.createDataFrame([("/a",)], "url string"), spark.createDataFrame([("p",)], "problem string"))
    assert {tuple(r) for r in report.collect()} == {("path", "x.png"), ("request", "/a"), ("error", "p")}


def test_busy_periods(spark, tmp_path):
    rows = spark.createDataFrame([("p", s) for s in (0, 1, 2, 10, 11)] + [("q", 5)], "page string, s long").select("page", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    assert {(r.page, r.n) for r in requests.busy_periods(spark.read.parquet(f"{tmp_path}/in")).collect()} == {("p", 3), ("p", 2), ("q", 1)}
    assert {r.ext: (r.files, r.bytes) for r in logs.inventory(spark.createDataFrame([("a.PNG", 1), ("b.png", 2), ("c", 3)], "path string, size long")).collect()} == {"png": (2, 3), "": (1, 3)}
    resources.write_lines(spark.createDataFrame([("b",), ("a",), ("b",)], "ref string"), "ref", f"{tmp_path}/lines")
    assert [r.value for r in spark.read.text(f"{tmp_path}/lines").collect()] == ["a", "b"]
