"""Repeated lines, main bodies, residue: fixtures, brute force, and awkward tables."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.html.layout import render, visible_lines
from folio.llm import mainbody, repeated_lines, residue

PAGE_SQL = "page_id bigint, url string, html string, source_html string"
LONG = "A long sentence about boats and harbours, with a comma or two, that no other page has ever printed before number {}."


def shell(body, k=0):
    return f"""<html><head><title>T</title></head><body><div><ul><li>Home<li>Latest<li>Sign in</ul></div>
<div><h1>Headline {k}</h1><div>By Ann Writer | 3 May 2024</div><div>5 min read</div><p>Updated: 03.05.2024 10:00</p>{body}<div>Advertisement</div><p>Share this story with a friend</p><p>Tags: a, b</p></div>
<div><h3>Read next</h3><ul><li>Other headline {k}<li>And one more {k}</ul><p>Sign up for the Daily letter</p></div><div><h4>2 comments</h4><p>{LONG.format(k)} I say.</p><div>Reply</div></div>
<div><p>© 2024 Daily. All rights reserved.</p><p>A standing sentence that the owner prints below each page of the site.</p></div><div>We use cookies to keep Daily running.</div></body></html>"""


def test_main_body_keeps_the_article_alone():
    body = f"<p>{LONG.format(1)}</p><h2>Part</h2><ul><li>First thing is long enough to be prose.<li>Second.</ul><table><tr><td>Name<td>4</table><pre>code()</pre><figure><img src=x><figcaption>Caption</figcaption></figure><blockquote><p>Quoted.</p></blockquote>"
    got = mainbody.main_lines(shell(body))
    assert got == ["Headline 0", LONG.format(1), "Part", "First thing is long enough to be prose.", "Second.", "Name", "4", "code()", "Caption", "Quoted."]


def test_main_body_in_other_layouts():
    p = f"<p>{LONG.format(2)}</p>"
    table = f"<table><tr><td><ul><li>Home<li>Help</ul></td><td><h1>H</h1>{p}</td><td><div><h3>More from Daily</h3><ul><li>x y z</ul></div></td></tr></table><div><p>Privacy · Terms · Imprint</p></div>"
    assert mainbody.main_lines(table) == ["H", LONG.format(2)]
    masthead = f"<header><nav><ul><li>Home<li>Help</ul></nav><h1>H</h1></header><section>{p}</section><section><h3>Read next</h3><ul><li>x y z</ul></section><section>{p}</section><footer><p>{LONG.format(3)}</p></footer>"
    assert mainbody.main_lines(masthead) == ["H", LONG.format(2), LONG.format(2)]
    flat = f"<div><p>Home | Opinion | Latest | Contact</p></div><h1>H</h1>{p}<h3>Read next</h3><ul><li>x y z</ul><p>{LONG.format(4)}</p><div><p>© 2020 D</p></div>"
    assert mainbody.main_lines(flat) == ["H", LONG.format(2), LONG.format(4)]


def test_main_body_of_source_where_scripts_left_nothing():
    assert mainbody.main_lines("<div id=root></div>", f"<h1>H</h1><p>{LONG.format(1)}") == ["H", LONG.format(1)]
    assert mainbody.main_lines(None, None) == [] and mainbody.main_lines("", "") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<h1>", "</h1>", "<td>", "text here. ", "Home", "<br>", "<footer>", "</footer>", "Reply", "© 2020 X"]), max_size=25))
def test_main_body_is_part_of_the_visible_lines(parts):
    markup = "".join(parts)
    seen = Counter(visible_lines(markup))
    assert not Counter(mainbody.main_lines(markup)) - seen


def pages(spark, rows):
    """A table with clashing extra columns, a null id, nulls in every column, empty and repeated rows, and one very long text."""
    rows = [*rows, (None, "https://a.example/n", "<p>x", None), (9001, None, None, None), (9002, "", "", ""), (9003, "https://a.example/l", "<p>" + "word " * 200_000, None), rows[0] if rows else (9004, "u", "", "")]
    return spark.createDataFrame(rows, PAGE_SQL).withColumn("site", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("text", F.lit("t"))


def test_chunks_do_not_depend_on_neighbours():
    line = repeated_lines.letters_of("No part of this page may be reproduced without the written permission of its owner, ever, in whole or in part.")
    alone = repeated_lines.chunk_letters([line])[0]
    assert len(alone) > 1
    for other in ("", "ab", "Something else entirely stood before it on another page"):
        assert repeated_lines.chunk_letters([repeated_lines.letters_of(other), line, "z"])[1] == alone
    edited = repeated_lines.chunk_letters([line + "andonemorewordattheend"])[0]
    assert set(alone[:-1]) <= set(edited)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdé", max_size=80), max_size=6))
def test_every_letter_is_in_a_chunk(lines):
    chunks = repeated_lines.chunk_letters(lines)
    assert [bool(c) for c in chunks] == [bool(x) for x in lines]
    assert chunks == [repeated_lines.chunk_letters([x])[0] for x in lines]


def brute_repeated(rows, site_of, least=3, share=0.1):
    n = Counter(site_of.values())
    count: Counter = Counter()
    lines = []
    for i, html in rows:
        if i not in site_of:
            continue
        keys = set()
        for text in visible_lines(html):
            k = repeated_lines.letters_of(text)
            if k:
                keys.add(k)
                lines.append((i, text[:60], k))
        for k in keys:
            count[site_of[i], k] += 1
    return {(i, head) for i, head, k in lines if count[site_of[i], k] >= max(least, share * n[site_of[i]])}


def test_repeated_lines_agree_with_brute_force(spark):
    rows, site_of = [], {}
    for k in range(60):
        site = "big" if k < 40 else f"s{k % 4}"
        body = "".join(f"<p>{LONG.format(j)}</p>" for j in (k % 7, k % 13 + 100)) + ("<p>Only letters count 12" + "3" * (k % 3) + "</p>" if k % 2 else "") + "<p>12 34</p><p>twice</p><p>TWICE</p>"
        rows.append((k, "u", body, None))
        site_of[k] = site
    table = pages(spark, rows)
    sites = spark.createDataFrame(list(site_of.items()), "page_id bigint, site string")
    own = repeated_lines.with_sources(repeated_lines.line_table(table), sites)
    often = repeated_lines.excessive_chunks(own)
    want = brute_repeated([(r[0], r[2]) for r in rows], site_of)
    for bound in (500_000, 0):  # chunks broadcast, chunks joined one by one
        assert {(r.page_id, r["head"]) for r in repeated_lines.repeated_lines(own, often, bound).collect()} == want
    cleaned = {r.page_id: r for r in repeated_lines.cut_repeated(table.where("page_id < 60"), own, often).collect()}
    assert cleaned[1].text == "\n".join(x for x in visible_lines(rows[1][2]) if (1, x[:60]) not in want) and len(cleaned) == 60
    empty = repeated_lines.with_sources(repeated_lines.line_table(spark.createDataFrame([], PAGE_SQL)), sites)
    assert repeated_lines.repeated_lines(empty, repeated_lines.excessive_chunks(empty)).count() == 0
    none = repeated_lines.with_sources(repeated_lines.line_table(table), sites.where("false"))
    assert repeated_lines.repeated_lines(none, repeated_lines.excessive_chunks(none)).count() == 0


NOTICE = "No part of this page may be reproduced without the written permission of its owner, ever, in whole or in part, whatever the purpose of the copy may be. Requests are answered in writing within thirty days by the office that keeps the register of works, and only to those who state their name and the edition they have in mind."


def test_chunks_are_cut_where_no_line_repeats(spark):
    """A notice glued to paragraphs, and one broken into other lines on each page: an exact count of lines finds neither, the chunks decide."""
    words = NOTICE.split()
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(30)) for _ in range(12)]
    own_text = lambda k: texts[k]
    rows = [(k, "u", f"<p>{texts[k]}. {NOTICE}</p>", None) for k in range(6)]
    rows += [(k, "u", f"<p>{texts[k]}</p><p>{' '.join(words[: 3 * k - 8])}<br>{' '.join(words[3 * k - 8 :])}</p>", None) for k in range(6, 12)]
    table = pages(spark, rows)
    sites = spark.createDataFrame([(k, "glued" if k < 6 else "broken") for k in range(12)], "page_id bigint, site string")
    own = repeated_lines.with_sources(repeated_lines.line_table(table), sites)
    often = repeated_lines.excessive_chunks(own)
    whole = repeated_lines.letters_of(NOTICE)
    assert brute_repeated([(r[0], r[2]) for r in rows], {k: "glued" if k < 6 else "broken" for k in range(12)}) == set() and repeated_lines.repeated_lines(own, often).count() == 0
    for r in repeated_lines.cut_repeated(table.where("page_id < 12"), own, often).collect():
        left = repeated_lines.letters_of(r.text)
        assert whole not in left and r.removed > 0.5 * len(whole), r
        assert own_text(r.page_id) in r.text  # the page's own text stays whole


def test_plain_text_sources(spark):
    docs = spark.createDataFrame([(k, f"Legal notice of this source\n{LONG.format(k)}") for k in range(6)], "page_id bigint, html string")
    sites = spark.createDataFrame([(k, "s") for k in range(6)], "page_id bigint, site string")
    own = repeated_lines.with_sources(repeated_lines.line_table(docs, markup=False), sites)
    got = repeated_lines.repeated_lines(own, repeated_lines.excessive_chunks(own))
    assert {r["head"] for r in got.collect()} >= {"Legal notice of this source"}


CASES = {
    "{{ title }}": "slot", "text with ${user.name} in it": "slot", "<%= body %>": "slot", "undefined": "empty", "(no title) · undefined": "empty", "[object object] · undefined": "empty", "lorem ipsum dolor sit amet": "filler", "asdf asdf": "filler", "todo write intro, # words": "filler",
    "insert body copy here. insert body copy here.": "filler", "please enable javascript to view this page.": "scripts", "your browser does not run scripts, so nothing can be shown here.": "scripts", "access denied": "error", "error #": "error", "страница не найдена.": "error",
    "something went wrong": "error", "sqlstate[#] server has gone away": "error", "a harbour office counted the boats": None, "the error of his ways was plain to all who knew him well": None, "readers were told to enable the lamp": None, "title": None,
}


@pytest.mark.parametrize("message", CASES)
def test_messages(message):
    assert residue.classify_message(message) == CASES[message]


def test_masks():
    assert residue.mask_message("Error 404 at https://x.example/a?b=1 on 2024-05-03 10:00, Ray 7f3a9c2b") == "error # at @ on #, ray #"


def test_residue(spark):
    sound = f"<p>{LONG.format(1)}</p><p>{LONG.format(2)}</p>"
    rows = {
        1: shell(sound), 2: shell(sound.replace("boats", "{{ item.text }}")), 3: shell(sound + "<pre><code>{{ title }}</code></pre>"), 4: shell(sound + "<p>Write <code>${name}</code> for it, says a reader.</p>"), 5: "<h1>Access denied</h1><p>You do not have permission to open this address on this server.</p>",
        6: "<p>Please enable JavaScript to view this page.</p>", 7: "<div id=root></div>", 8: shell("<p>Lorem ipsum dolor sit amet magna elit.</p><p>Dolor sit amet elit sed do magna.</p>"), 9: shell(sound + "<p>Comments could not be loaded. Something went wrong.</p>"),
        10: "<h1>undefined</h1><p>undefined · undefined</p>", 11: shell(f"<p>Readers were told to enable JavaScript, which was the wrong answer to a slow page, says one. {LONG.format(3)}</p>"), 12: "<h1>Title</h1><p>xxx xxx xxx</p>", 13: "<noscript>Please enable JavaScript</noscript>" + shell(sound),
    }
    got = residue.find_residue(pages(spark, [(k, f"https://s{k}.example/", h, None) for k, h in rows.items()]))
    assert sorted(r.page_id for r in got.collect()) == [2, 5, 6, 8, 10, 12]
    assert residue.find_residue(spark.createDataFrame([], PAGE_SQL)).count() == 0


def test_residue_in_larger_pages(spark):
    sound = f"<p>{LONG.format(1)}</p><p>{LONG.format(2)}</p>"
    frames = "".join(f"<p>at com.example.Page.render{k}(Page.java:{k})</p>" for k in range(20))
    rows = {
        1: shell(sound + "<p>undefined</p>"), 2: shell(sound + "<p>[object Object] · NaN</p>"), 3: shell(sound + "<p>Place: null</p>"), 4: shell(sound.replace("boats", "{{ " + "item.text | default " * 6 + "}}")),
        5: shell("<h1>Something went wrong</h1><p>An unexpected error occurred.</p>" + frames), 6: shell("<p>Insert body copy here.</p>" * 12), 7: shell("<h1>Application error</h1><p>" + "Something went wrong. " + " ".join(f"at com.example.Page.render{k}(Page.java:{k})" for k in range(20)) + "</p>"),
        11: shell(sound + "<p><code>undefined</code> stands where the name was, says one.</p>"), 12: shell(sound + "<pre>undefined</pre>"), 13: shell(sound + "<p>The value is undefined, and null, in such a case.</p>"), 14: shell("<p>Nobody on the quay had seen so many gulls as on that grey morning, and the baker gave them what was left of the bread from the day before.</p>" * 2 + "<p>n/a</p><p>None</p>"),
        15: shell(sound * 3 + "<p>Something went wrong.</p><p>Access denied</p><p>Error 404</p>"),
    }
    got = residue.find_residue(pages(spark, [(k, f"https://s{k}.example/", h, None) for k, h in rows.items()]))
    assert sorted(r.page_id for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_unknown_messages_count_where_they_recur(spark):
    rows = [(k, f"https://s{k}.example/", "<h1>Zzz brk 0x77 flarn</h1>", None) for k in range(5)] + [(10, "https://one.example/", "<h1>Brief note</h1>", None)]
    rows += [(20 + k, f"https://c{k}.example/", shell(f"<p>{LONG.format(7)}</p><p>{LONG.format(8)}</p>"), None) for k in range(6)]  # copies of a sound article
    found = residue.find_residue(pages(spark, rows))
    assert sorted(r.page_id for r in found.collect()) == [0, 1, 2, 3, 4]


def test_queries(spark, data):
    from folio.llm.queries import queries

    q = queries()
    for name in ("p1_found", "p2_found", "p6_found"):
        df = q[name](spark, data)
        rows = df.collect()
        assert len(rows) == len(set(rows)) > 0
    residues = {r.page_id for r in q["p6_found"](spark, data).collect()}
    assert not residues & {r.page_id for r in q["p2_found"](spark, data).select("page_id").distinct().collect()}
    bodies = q["p2_bodies"](spark, data).collect()
    assert sum(bool(b.text) for b in bodies) > 0.9 * len(bodies)


def test_layout_lines_hold_all_visible_text(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").select("html").collect():
        page = render(r.html)
        assert all(t and t == " ".join(t.split()) for t, *_ in page.lines)
