import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import charset, cookies, robots, site, text, url
from folio.functions.modules import ImportMap


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_hosts(spark):
    rows = [("api.example.co.uk",), ("www.Example.com.",), ("10.0.0.1",), ("localhost",), ("me.github.io",), ("a.b.c.example.org",), (None,)]
    assert [r[0] for r in one(spark, rows, "h string", site.registrable_domain(F.col("h")))] == ["example.co.uk", "example.com", "10.0.0.1", "localhost", "me.github.io", "example.org", None]
    for h, want in (("stats.hotjar.com", True), ("nothotjar.com", False), ("twitter.com", True)):
        assert site.is_tracker_host(h) is want


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"\A[a-z]{1,3}(\.[a-z]{1,3}){0,4}\Z"))
def test_registrable_domain_is_a_tail(h):
    d = site._registrable_text(h)
    assert h == d or h.endswith("." + d)
    assert site._registrable_text(d) == d


def test_policy(spark):
    rows = [("http://127.0.0.1/",), ("http://[::1]/",), ("http://[::ffff:10.0.0.1]/",), ("http://[2001:db8::1]/",), ("ftp://x.example/",), ("https://x.example/",), ("https://sub.bad.example/",), ("http://localhost/",)]
    got = one(spark, rows, "u string", site.policy_error(F.col("u"), deny=[".bad.example"]))
    assert [g[0] for g in got] == ["private address", "private address", "private address", None, "scheme", None, "host", "host"]
    assert one(spark, [("https://a.ok.example/",), ("https://no.example/",)], "u string", site.policy_error(F.col("u"), allow=["ok.example"])) == [(None,), ("host",)]


JOINS = [
    ("https://News.example/2026/story", "/für?q=ö#x y", "https://news.example/f%C3%BCr?q=%C3%B6#x%20y"), ("https://a.b/c/d", "../e/./f", "https://a.b/e/f"), ("https://a.b/c/d", "?q", "https://a.b/c/d?q"),
    ("https://a.b/c/d?x", "#f", "https://a.b/c/d?x#f"), ("https://a.b/", "//C.d:443/x", "https://c.d/x"), ("http://a.b/c", "mailto:x@y", "mailto:x@y"), ("http://a/b", "http://exa mple/", None), ("http://a.b/c/", "x\\y", "http://a.b/c/x/y"),
    ("http://a/b", "http://0x7f.1/", "http://127.0.0.1/"), ("http://a/", " \thttp://b\n/c ", "http://b/c"), ("http://a/b/c", "..", "http://a/"), ("http://a/b/c", "%2e%2e/d", "http://a/d"), (None, "/x", None), ("http://a/", "http://b:99999/", None),
]


@pytest.mark.parametrize("base,text_,want", JOINS)
def test_join(base, text_, want):
    assert url.join(base, text_) == want


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_join_never_fails_and_is_stable(s):
    out = url.join("https://a.example/b/c?d#e", s)
    assert out is None or url.join(None, out) == out


def test_text(spark):
    assert one(spark, [("Head line here — Site",), (" x ",), ("a - b",)], "t string", text.strip_site_suffix(F.col("t"))) == [("Head line here",), ("x",), ("a - b",)]
    assert one(spark, [("aaaa bbbb cccc",), ("abc",), ("ééééé fffff ggg",)], "t string", text.truncate_chars(F.col("t"), 12)) == [("aaaa bbbb…",), ("abc",), ("ééééé fffff…",)]
    assert one(spark, [("TypeError: x 12 at https://a.b/c",), ("plain https://a/b\nmore",)], "t string", text.error_signature(F.col("t"))) == [("TypeError: x N at <url>",), ("plain <url>",)]
    globs = [("https://a/b", "*"), ("abc", "a?c"), ("ac", "a?c"), ("a.b", "a.b"), ("axb", "a.b"), ("x/api/y", "*/api/*"), ("", "*"), ("a+b(c)", "a+b(*)")]
    assert [g[0] for g in one(spark, globs, "t string, p string", text.glob_matches(F.col("t"), F.col("p")))] == [True, True, False, True, False, True, True, True]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /p\nAllow: /p/q$\n\nUser-Agent: FooBot\nDisallow: /x*y\nDisallow:\n"
    rules = robots.robots_rules(spark.createDataFrame([("o", body), ("empty", ""), ("html", "<html>not: rules"), ("none", None)], "origin string, body string"))
    assert {(r.origin, r.agent, r.pattern, r.allowed) for r in rules.collect()} == {("o", "*", "/p", False), ("o", "*", "/p/q$", True), ("o", "foobot", "/x*y", False)}
    requests = spark.createDataFrame([("o", "/p/q"), ("o", "/p/qq"), ("o", "/z"), ("other", "/p"), ("o", None)], "origin string, path string")
    assert [r.allowed for r in robots.robots_allows(requests, rules, "SomeBot").orderBy("origin", "path").collect()] == [True, True, False, True, True]
    assert {r.path: r.allowed for r in robots.robots_allows(spark.createDataFrame([("o", "/xay"), ("o", "/p")], "origin string, path string"), rules, "foobot/1").collect()} == {"/xay": False, "/p": True}


@given(st.text(alphabet="ab*$/", max_size=8), st.text(alphabet="ab/", max_size=8))
def test_path_patterns_without_marks_are_prefixes(pattern, path):
    got = robots._match(pattern, path)
    if "*" not in pattern and not pattern.endswith("$"):
        assert got == path.startswith(pattern)


def test_cookies(spark):
    jar = spark.createDataFrame([("a=1; b=2; bad",)], "j string")
    assert [tuple(p) for p in jar.select(cookies.cookie_pairs(F.col("j")).alias("p")).first().p] == [("a", "1"), ("b", "2")]
    rows = [("a=1; b=2", ["a=3; Path=/", "c = 4"]), ("", ["=x", "nothing"]), (None, ["k=v"])]
    assert [r[0] for r in one(spark, rows, "j string, w array<string>", cookies.set_cookie(F.col("j"), F.col("w")))] == ["a=3; b=2; c=4", "", "k=v"]
    assert one(spark, [("b=2; a=1",)], "j string", cookies.cookie_fingerprint(F.col("j"))) == [("a=1; b=2",)]
    assert one(spark, [("www.Deep.Example.com",), ("example.com",), ("localhost",)], "h string", cookies.domain_candidates(F.col("h"))) == [(["www.deep.example.com", "deep.example.com", "example.com"],), (["example.com"],), (["localhost"],)]
    assert one(spark, [("/a/b",), ("/",), ("",), ("a/b",)], "p string", cookies.path_candidates(F.col("p"))) == [(["/a/b", "/a", "/"],), (["/"],), (["/"],), (["a/b", "a", "/"],)]
    gone = jar.select(cookies.delete_cookie(cookies.cookie_pairs(F.col("j")), F.lit("a")).alias("p"), cookies.describe_cookies(cookies.cookie_pairs(F.col("j")), F.lit("https://h.example/x")).alias("d")).first()
    assert len(gone.p) == 1 and gone.d[0].domain == "h.example" and gone.d[0].secure and gone.d[0].size == 2


BODIES = [
    (b"\xef\xbb\xbfh\xc3\xa9", "text/html; charset=koi8-r", "utf-8", "hé"), ("привет".encode("cp1251"), "text/html; charset=windows-1251", "windows-1251", "привет"), (b'<meta charset="koi8-r">' + "да".encode("koi8-r"), "", "koi8-r", '<meta charset="koi8-r">да'),
    (b'<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">\xcf\xf0', None, "windows-1251", '<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">Пр'), (b'<meta data-charset="koi8-r">\xc3\xa9', "", "utf-8", '<meta data-charset="koi8-r">é'),
    (b"\xe9t\xe9 \x81", "", "windows-1252", "été \x81"), (b"x", "text/html; charset=bogus", "utf-8", "x"), (b"h\xe9", 'text/plain; charset="latin1"', "windows-1252", "hé"),
]


@pytest.mark.parametrize("raw,ct,name,want", BODIES)
def test_decode(raw, ct, name, want):
    assert charset.decode_one(raw, ct) == (want, name)


def test_kinds(spark):
    rows = [("text/html; charset=x", b""), ("application/octet-stream", b"%PDF-1.4"), ("", b"  <!DOCTYPE html>"), ("", b"plain"), ("image/png", b""), ("application/ld+json", b""), ("video/mp4", b""), (None, b"<div><body>"), ("text/csv", None)]
    assert [r[0] for r in one(spark, rows, "c string, r binary", charset.content_kind(F.col("c"), F.col("r")))] == ["html", "pdf", "html", "other", "image", "json", "media", "html", "text"]
    assert [r[0] for r in one(spark, [(403, 1), (503, 20_000), (503, 19_999), (200, 1), (439, 1)], "s int, n int", charset.block_reason(F.col("s"), F.col("n")).isNotNull())] == [True, False, True, False, True]


def test_import_maps():
    base = "https://a.example/blog/"
    m = ImportMap.parse('{"imports": {"kit": "/k.js", "lib/": "https://c.example/lib/", "./l.js": "./m.js", "bad/": "/nofolder"}, "scopes": {"/admin/": {"kit": "/admin-k.js"}}}', base)
    assert m.resolve("kit", base) == "https://a.example/k.js" and m.resolve("lib/x/y.js", base) == "https://c.example/lib/x/y.js"
    assert m.resolve("./l.js", base) == "https://a.example/blog/m.js" and m.resolve("kit", "https://a.example/admin/p.js") == "https://a.example/admin-k.js"
    assert m.resolve("none", base) is None and m.resolve("bad/x", base) is None and ImportMap.parse("[", base) is None
    assert m.merge(ImportMap({"kit": "https://z/", "q": "https://q/"})).resolve("q", base) == "https://q/"
