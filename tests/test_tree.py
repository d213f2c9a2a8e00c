from hypothesis import given, settings
from hypothesis import strategies as st

from folio.html.layout import render, render_text, visible_lines
from folio.html.nodes import node_rows
from folio.html.serialize import document_html, inner_html, outer_html
from folio.html.tree import ELEMENT, parse, parse_fragment


def body(markup):
    t = parse(markup)
    return inner_html(t, t.body)


def test_text_is_merged_and_implied_elements_appear():
    t = parse("one &amp; two")
    assert document_html(t) == "<html><head></head><body>one &amp; two</body></html>"
    assert [t.tag[n] for n in t.walk() if t.kind[n] == ELEMENT] == ["html", "head", "body"]


def test_formatting_is_reconstructed_and_adopted():
    assert body("<p>1<b>2<i>3</b>4</i>5</p>") == "<p>1<b>2<i>3</i></b><i>4</i>5</p>"
    assert body("<b>1<p>2</b>3</p>") == "<b>1</b><p><b>2</b>3</p>"
    assert body("<p><b>x<p>y") == "<p><b>x</b></p><p><b>y</b></p>"
    assert body("<a href=1>x<a href=2>y") == '<a href="1">x</a><a href="2">y</a>'


def test_tables_foster_what_does_not_belong():
    assert body("<!doctype html><table><tr><td>x</td>foo<b>bar</table>baz") == "foo<b>bar</b><table><tbody><tr><td>x</td></tr></tbody></table><b>baz</b>"


def test_lists_cells_and_options_close_themselves():
    assert body("<ul><li>a<li>b<ul><li>c</ul></ul>") == "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"
    assert body("<table><tr><td>a<td>b<tr><th>c") == "<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></tbody></table>"
    assert body("<select><option>a<option>b</select>c") == "<select><option>a</option><option>b</option></select>c"


def test_raw_text_templates_and_svg():
    assert body("<p><script>var t='</p>';</script>x") == "<p><script>var t='</p>';</script>x</p>"
    assert body("<textarea>\n<b>&lt;</textarea>") == "<textarea>&lt;b&gt;&lt;</textarea>"
    t = parse("<template><p>in</p></template><p>out</p>")
    assert t.text_of(0) == "out" and "<template><p>in</p></template>" in document_html(t)
    assert body("<svg><path d=x /><g>t</g></svg><p>y") == '<svg><path d="x"></path><g>t</g></svg><p>y</p>'


def test_escapes_in_serialization():
    assert body('<p title="a&quot;b&nbsp;&amp;">x &lt; y&nbsp;</p>') == '<p title="a&quot;b&nbsp;&amp;">x &lt; y&nbsp;</p>'
    assert document_html(parse("<!DOCTYPE html><!-- c --><p>x<br>")) == "<!DOCTYPE html><!-- c --><html><head></head><body><p>x<br></p></body></html>"


def test_fragments():
    t, root = parse_fragment("<tr><td>x", "tbody")
    assert inner_html(t, root) == "<tr><td>x</td></tr>"
    t, root = parse_fragment("<p>a<p>b")
    assert inner_html(t, root) == "<p>a</p><p>b</p>"
    t, root = parse_fragment("<b>x", "textarea")
    assert t.text_of(root) == "<b>x"


def test_intervals_and_paths():
    rows = node_rows(7, parse("<div><p>a</p><p>b<i>c</i></p></div>"))
    by = {r[1]: r for r in rows}
    for r in rows:
        for up in r[14]:
            assert by[up][6] < r[6] and r[7] < by[up][7]
    div = next(r for r in rows if r[10] == "div")
    assert [r[10] for r in rows if div[6] < r[6] and r[7] < div[7] and r[8] == 1] == ["p", "p", "i"]


def test_deep_nesting_is_no_recursion():
    t = parse("<div>" * 20_000 + "x")
    assert t.text_of(0) == "x"
    assert outer_html(t, t.html).endswith("</html>")
    assert visible_lines("<div>" * 20_000 + "x") == ["x"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "x", " ", "<div>", "</div>", "<h1>", "</h2>", "<!--", "-->", "<br>", "&amp;", "<svg>", "</svg>", "<select>", "<option>", "<template>", "</template>", "<"]), max_size=25))
def test_any_markup_has_a_sound_tree(parts):
    t = parse("".join(parts))
    for n in range(1, len(t.parent)):
        if t.parent[n] >= 0:
            assert n in t.kids[t.parent[n]]
    document_html(t)
    render("".join(parts))


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_any_text_parses(s):
    document_html(parse(s))
    render(s)


def test_visible_lines():
    page = """<head><title>no</title></head><body><h1>A&nbsp;<b>b</b></h1><p>one<br>two <span hidden>x</span> three</p><div style="color:red; DISPLAY : none">gone</div>
      <ul><li>i<li>j</ul><!-- c --><noscript>n</noscript><td>cell<div>in</div>out<p hidden>never<p>last"""
    assert visible_lines(page) == ["A b", "one", "two three", "i", "j", "cell", "in", "out", "last"]
    assert visible_lines(None) == [] and visible_lines("") == [] and visible_lines("<p> &nbsp; </p>") == []
    assert visible_lines('<p data-x="hidden">seen</p><P HIDDEN>not</P>') == ["seen"]


def test_layout_keeps_lists_and_cells():
    text = render_text(render("<h1>T</h1><ol><li>a<li>b</ol><table><tr><td>x</td><td>1</td></tr><tr><td>long</td><td>22</td></tr></table><p>end</p>"))
    assert text == "T\n\n1. a\n\n2. b\n\nx    | 1\nlong | 22\n\nend"
