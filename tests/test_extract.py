from hypothesis import given
from hypothesis import strategies as st

from folio.extract.markdown import escape_inline, to_markdown
from folio.extract.metadata import metadata, strip_site_suffix, truncate_chars
from folio.extract.readability import WHITE, _piece, article, candidates, text_sizes
from folio.html.tree import parse
from folio.operators.reading import _links, _prefetch, _refresh, import_specifiers, read_one

BASE = "https://daily.example/2024/05/piece"
PROSE = "The harbour office counted the boats again, slowly and with care, before the winter storms reached the northern quay and closed it. "
PAGE = f"""<!doctype html><html lang="en"><head><title>Boats counted | The Daily</title><link rel=canonical href="/2024/05/piece">
<link rel="alternate" type="application/atom+xml" title=All href="/feed.atom"><meta property="og:image" content="/pic.png"><meta name=description content=" A   count. ">
<script type="application/ld+json">[{{"@type":"Organization","name":"The Daily"}},{{"@graph":[{{"@type":"NewsArticle","headline":"Boats counted","author":[{{"name":"A. Writer"}},"B. Editor"],"datePublished":"2024-05-01","image":{{"url":"/ld.png"}},"publisher":{{"name":"Daily"}}}}]}}]</script>
<script type="application/ld+json">{{broken</script></head><body><nav><a href=/>Home</a> <a href=/w>World</a></nav><div class=post><h1>Boats counted</h1><p>{PROSE}</p><p>{PROSE}{PROSE}</p>
<h2>After that</h2><ul><li>First thing, counted twice</li><li>Second<ol><li>inner</li></ol></li></ul><blockquote><p>Quiet water.</p></blockquote><pre><code class="language-py">a = `b`</code></pre>
<table><tr><th>Quay<th>Boats<tr><td>North|East<td>7</table><p>{PROSE}<img src="/i (1).png" alt="a_b"></p></div><aside class="related"><ul><li><a href=/r>Other news</a></ul></aside><footer>Imprint and more</footer></body></html>"""


def test_metadata():
    m = metadata(parse(PAGE), BASE)
    assert m["title"] == "Boats counted" and m["author"] == "A. Writer, B. Editor" and m["site_name"] == "Daily" and m["published"] == "2024-05-01"
    assert m["canonical_url"] == BASE and m["image"] == "https://daily.example/ld.png" and m["language"] == "en" and m["description"] == "A count."
    assert m["feeds"] == [{"url": "https://daily.example/feed.atom", "title": "All", "kind": "atom"}]
    assert m["schema_types"] == ["Organization", "NewsArticle"]


def test_order_of_structured_data_decides():
    ld = '<script type="application/ld+json">{"@type":"%s","headline":"H1"}</script><script type="application/ld+json">{"@type":"Thing","name":"N"}</script>'
    assert metadata(parse(ld % "Article"))["title"] == "H1"
    assert metadata(parse(ld % "Person"))["title"] is None


def test_first_tag_wins_and_description_falls_back():
    m = metadata(parse(f"<meta name=author content='  '><meta name=Author content=A><meta name=author content=B><body><p>short<p>{PROSE * 4}"))
    assert m["author"] == "A" and m["description"].endswith("…") and len(m["description"]) <= 301


def test_titles_and_cuts():
    assert strip_site_suffix("A long headline - Site") == "A long headline"
    assert strip_site_suffix("Ab - A much longer tail") == "Ab - A much longer tail"
    assert truncate_chars("aaaaaa bbbb cccc", 9) == "aaaaaa…" and truncate_chars("aaa bbbbbbbb", 9) == "aaa bbbbb…"
    assert truncate_chars("abc", 3) == "abc" and truncate_chars("abcdefgh", 4) == "abcd…"


def test_article_and_markdown():
    r = read_one(PAGE, BASE)
    md = r["content"]
    assert not r["low_confidence"] and r["error"] is None
    for part in ("# Boats counted\n", "## After that\n", "- First thing, counted twice\n", "  1. inner\n", "> Quiet water.\n", "```py\na = `b`\n```", "| Quay | Boats |\n| --- | --- |\n| North\\|East | 7 |", "![a\\_b](https://daily.example/i%20%281%29.png)"):
        assert part in md, part
    for chrome in ("Other news", "Imprint", "World"):
        assert chrome not in md
    plain = read_one(PAGE, BASE, images=False, with_links=False, max_chars=300)["content"]
    assert "![" not in plain and len(plain) < 700


def test_link_farm_falls_back():
    r = read_one("<body><nav><a href=/1>One</a></nav><div><a href=/3>Three</a><a href=/4>Four</a></div>", None)
    assert r["low_confidence"] and "One" in r["content"]
    assert read_one(None, None)["error"] == "no html" and read_one("", None)["low_confidence"]


def test_siblings_are_grown_and_leftovers_dropped():
    part = f"<div class=part><h2>Head</h2><p>{PROSE * 2}</p></div>"
    t = parse(f"<body><div id=all>{part}{part}<div class=newsletter>Sign up for it now</div></div>")
    a = article(t)
    text = to_markdown(t, a.roots if a.grown else t.kids[a.roots[0]], gone=a.gone)
    assert text.count("## Head") == 2 and "Sign up" not in text
    assert a.text_len == len(" ".join((("Head" + PROSE * 2) * 2).split()))


def test_equal_scores_go_to_the_first():
    t = parse(f"<body><section><div id=a><p>{PROSE}{PROSE}</p></div></section><section><div id=b><p>{PROSE}{PROSE}</p></div></section>")
    c = [x for x in candidates(t) if t.attr(x.node, "id")]
    assert c[0].score == c[1].score


def test_quirks_of_items_and_escapes():
    md = lambda h: to_markdown(parse(h), parse(h).kids[parse(h).body])
    assert md("<ul><li><p>x</p></li></ul>") == "-\nx\n"
    assert md("<p># a *b* [c] `d`\n# e") == "\\# a \\*b\\* \\[c\\] \\`d\\` # e\n"
    assert md("<p><b> </b>x<a href='#f'>y</a><a href='javascript:z'>w</a>") == "xyw\n"
    assert md("<p><code>a``b</code> <code>`c</code>") == "```a``b``` `` `c ``\n"
    assert md("<dl><dt>t<dd>d</dl>") == "**t**\n: d\n"
    assert md("<table><tr><td>only<tr><td>one</table>") == "only\none\n"


@given(st.text(alphabet="ab \n\t  ,", max_size=30))
def test_sizes_of_pieces(s):
    n, lead, trail = _piece(s)
    words = "".join(" " if c in WHITE else c for c in s).split()
    assert n == len(" ".join(words))
    if words:
        assert lead == (s[0] in WHITE) and trail == (s[-1] in WHITE)


@given(st.lists(st.sampled_from(["<b>", "</b>", "a", " ", "b ", "<i> </i>", "<p>", "\n"]), max_size=20))
def test_sizes_of_subtrees(parts):
    t = parse("".join(parts))
    sizes = text_sizes(t, t.body)
    for n, size in sizes.items():
        assert size == len(" ".join(t.text_of(n).split()))


@given(st.text(max_size=40))
def test_escapes_only_add(s):
    assert escape_inline(s).replace("\\", "") == s.replace("\\", "")


def test_links_and_loading():
    html = "<a href='/x'>A</a><a href='/x'>again</a><a href='#t'>t</a><a href=' javascript:1'>j</a><a href=''>e</a><a name=n>n</a>"
    assert [x["href"] for x in _links(html, "https://a.example/p")] == ["https://a.example/x", "https://a.example/p#t", "javascript:1", "https://a.example/p"]
    assert [x["href"] for x in _links(html, "https://a.example/p", strict=True)] == ["https://a.example/x"]
    scripts = "<script src=/a.js></script><script src=https://www.googletagmanager.com/x.js></script><link rel=modulepreload href=/m.js><link rel=preload as=script href=/p.js><link rel=preload as=font href=/f>"
    assert _prefetch(scripts, "https://a.example/") == ["https://a.example/a.js", "https://a.example/m.js", "https://a.example/p.js"]


def test_refresh():
    r = lambda c: _refresh(f'<meta http-equiv=Refresh content="{c}">', "https://a.example/p/")
    assert r("0; url=next") == "https://a.example/p/next" and r("5;URL='/q'") == "https://a.example/q"
    assert r("6; url=x") is None and r("0") is None and r("0; Url=x") is None


def test_import_scan():
    found = import_specifiers("import a from './a.js'; import {b} from \"/b.js\"; reimport('./no'); x.import('./no2'); import('./c.js'); import d from 'bare'; import /*x*/ './e.js'")
    assert found == ["./a.js", "/b.js", "./c.js"]
    assert import_specifiers("import x from './a.js';" + "十" * 300) == ["./a.js"] and import_specifiers(None) == []
