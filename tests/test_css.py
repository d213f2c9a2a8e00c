import pytest

from folio.css.match import Matcher
from folio.css.parse import SelectorError
from folio.css.plan import select_nodes
from folio.html.nodes import html_nodes
from folio.html.tree import parse

PAGE = """<!doctype html><main id=m class="x y" data-k="v-1" lang=en-GB><h1 id=h>T</h1><p id=p1 class=lead>one</p><p id=p2>two <a id=l href=/x>l</a></p>
<ul id=u><li id=i1>1<li id=i2>2<li id=i3>3</ul><figure id=f><img id=g></figure><div id=e></div><form id=q><input id=n1 disabled><input id=n2 required placeholder=z><textarea id=n3></textarea></form></main>"""
CASES = {
    "main > p": "p1 p2", "h1 + p": "p1", "h1 ~ p": "p1 p2", "li:nth-child(odd)": "i1 i3", "li:nth-last-child(1)": "i3", "li:nth-child(-n+2)": "i1 i2", "p:not(.lead)": "p2", ":is(h1, figure)": "h f", "main:has(> ul)": "m",
    "p:has(a)": "p2", "h1:has(+ p)": "h", "h1:has(~ figure)": "h", "div:empty": "e", "[data-k^=v]": "m", "[lang|=en]": "m", "[class~=y]": "m", "[data-k$='1']": "m", "[data-k*='-']": "m", "[class='X Y' i]": "m", "li:nth-child(2 of li)": "i2", "a:any-link": "l",
    "p:first-of-type": "p1", "p:last-of-type": "p2", "p:hover": "", "p::before": "", "ul li": "i1 i2 i3", "#u > li:last-child": "i3", ":where(p, ::bad, li)": "p1 p2 i1 i2 i3", "p:foo": "", "input:disabled": "n1", "input:enabled": "n2",
    ":required": "n2", "input:optional": "n1", ":read-write": "n2 n3", ":placeholder-shown": "n2", "img:only-child": "g", "figure:only-of-type": "f", "[data-k^='']": "", "*|li": "i1 i2 i3", "main p, li#i1": "p1 p2 i1", "p:not(.lead, #p2)": "", "main:not(:has(> ul))": "",
}


@pytest.mark.parametrize("selector", CASES)
def test_matcher(selector):
    t = parse(PAGE)
    assert [t.attr(n, "id") for n in Matcher(selector).all(t)] == CASES[selector].split()


def test_first_closest_and_scope():
    t = parse(PAGE)
    link = Matcher("a").first(t)
    assert t.attr(Matcher("main").closest(t, link), "id") == "m"
    assert Matcher("a").closest(t, link) == link and Matcher("li").closest(t, link) is None
    assert t.tag[Matcher(":root").first(t)] == "html"


@pytest.mark.parametrize("bad", ["p >", "[", "p:nth-child(x)", "..", "p,,q", "", "a:has()", "p:not()", "#", "a b >", "[=x]"])
def test_bad_selectors_are_errors(bad):
    with pytest.raises(SelectorError):
        Matcher(bad)


def test_old_documents_match_ids_without_case():
    assert len(Matcher("#ABC").all(parse("<p id=abc>"))) == 1
    assert len(Matcher("#ABC").all(parse("<!doctype html><p id=abc>"))) == 0


def test_plan_agrees_with_matcher(spark):
    pages = [(1, PAGE), (2, "<ul><li>a<li>b</ul><main><p>x</p></main>"), (3, ""), (4, None)]
    nodes = html_nodes(spark.createDataFrame(pages, "page_id bigint, html string")).persist()
    for selector in ["main > p", "h1 + p", "h1 ~ p", "li:nth-child(odd)", "li:nth-last-child(1)", "p:not(.lead)", ":is(h1, figure)", "main:has(> ul)", "h1:has(+ p)", "h1:has(~ figure)", "div:empty", "[data-k^=v]", "li:nth-child(2 of li)",
                     "p:first-of-type", "img:only-child", "ul li", "main p, li", "p:hover", ":root", "main:has(li:last-child)", "[class='X Y' i]"]:
        want = {(i, n) for i, h in pages for n in Matcher(selector).all(parse(h))}
        got = {(r.page_id, r.node_id) for r in select_nodes(nodes, selector).collect()}
        assert got == want, selector
    nodes.unpersist()


def test_navigation_over_nodes(spark):
    from pyspark.sql import functions as F

    from folio.operators import dom

    n = html_nodes(spark.createDataFrame([(1, "<meta name=A content=''><meta name=a content=x><meta property=a content=y><div><p>a<b>c</b></p><script>s</script><p></p></div>"), (2, None)], "page_id bigint, html string")).persist()
    div = n.where("tag = 'div'")
    assert [r.tag for r in dom.children(n, div).orderBy("sib_idx").collect()] == ["p", "script", "p"]
    assert dom.descendants(n.where("node_type = 1"), div).count() == 4
    assert dom.text_content(n, div).first().text == "acs" and dom.rendered_text(n, div).first().text == "ac"
    assert [r.tag for r in dom.ancestors(n.where("tag = 'b'")).orderBy("n").collect()][:4] == ["p", "div", "body", "html"]
    b = n.where("tag = 'b'").select(dom.closest(["div"]).alias("c")).first().c
    assert b == div.first().node_id
    pairs = n.where("tag = 'div'").alias("a").join(n.where("tag = 'b'").alias("b"), F.expr("a.page_id = b.page_id")).where(dom.contains())
    assert pairs.count() == 1
    assert [(r.key, r.content) for r in dom.meta_tags(n).collect()] == [("a", "x")]
    n.unpersist()
