"""Small case tables for what the driver's tables do not hold or SQL cannot parse: inputs and the values that the contract demands.

Each query applies an operator to its cases; its SQL lists the expected rows, which were written by hand from the contract.
"""

from __future__ import annotations

__all__ = ["BODIES", "JOINS", "KINDS", "LINKS", "MARKDOWN", "METADATA", "MODULES", "NODES", "PARTS", "REFRESH", "SELECTOR_PAGE", "SELECTORS", "SELECTORS_JOINED", "values"]

SELECTOR_PAGE = """<!doctype html><main id="m" class="x y" data-k="v-1" lang="en-GB"><h1 id="h">T</h1><p id="p1" class="lead">one</p><p id="p2">two <a id="l" href="/x">l</a><a id="l0">none</a></p>
<ul id="u"><li id="i1">1<li id="i2">2<li id="i3">3</ul><figure id="f"><img id="g"></figure><div id="e"></div><form id="q"><input id="n1" disabled><input id="n2" required placeholder="z"><textarea id="n3"></textarea><input id="n4" type="checkbox" checked>
<input id="n5" readonly><select id="s"><option id="o1"><option id="o2" selected></select><fieldset id="fs" disabled><button id="b"></button></fieldset></form><x-thing id="xt"></x-thing></main>"""
#: Selector -> ids of the elements that match, in document order.
SELECTORS = {
    "li": "i1 i2 i3", "main > *": "m", "#p2": "p2", ".lead": "p1", ".x.y": "m", "[data-k]": "m", "[data-k='v-1']": "m", "[class~=y]": "m", "[lang|=en]": "m", "[data-k^=v]": "m", "[data-k$='1']": "m", "[data-k*='-']": "m", "[data-k^='']": "", "[class='X Y' i]": "m",
    "main p": "p1 p2", "ul li": "i1 i2 i3", "main > p": "p1 p2", "h1 + p": "p1", "h1 ~ p": "p1 p2", "h1, a": "h l l0", "li:nth-child(odd)": "i1 i3", "li:nth-child(-n+2)": "i1 i2", "li:nth-last-child(1)": "i3", "li:nth-child(2 of li)": "i2", "li:first-child": "i1", "#u > li:last-child": "i3",
    "p:first-of-type": "p1", "p:last-of-type": "p2", "img:only-child": "g", "figure:only-of-type": "f", "p:not(.lead)": "p2", "p:not(.lead, #p2)": "", ":is(h1, figure)": "h f", ":where(p, li)": "p1 p2 i1 i2 i3", "main:has(> ul)": "m", "p:has(a)": "p2", "h1:has(+ p)": "h", "h1:has(~ figure)": "h",
    "div:empty": "e", "a:any-link": "l", "a:link": "l", "a:visited": "", "p:hover": "", "input:focus": "", "input:disabled": "n1", "button:disabled": "", "input:enabled": "n2 n4 n5", "input:checked": "n4", "option:checked": "o2", ":required": "n2", "textarea:optional": "n3",
    "textarea:read-write": "n3", "#n5:read-only": "n5", ":placeholder-shown": "n2", "p:defined": "p1 p2", "x-thing:defined": "xt", "input:indeterminate": "", "input:valid": "", "p:unknown-state": "", "p::before": "",
}
SELECTORS["main > *"] = "h p1 p2 u f e q xt"
#: Those that are also evaluated as joins over the node table.
SELECTORS_JOINED = ("main p", "main > p", "h1 + p", "h1 ~ p", "li:nth-child(odd)", "li:nth-last-child(1)", "p:last-of-type", "p:not(.lead)", ":is(h1, figure)", "main:has(> ul)", "h1:has(+ p)", "div:empty", "a:any-link", "h1, a", "p:hover")

#: (case, HTML of a body, Markdown)
MARKDOWN = [
    ("heading", "<h1>A</h1><h3>B <em>c</em></h3>", "# A\n\n### B *c*\n"),
    ("paragraphs", "<p>one\n  two</p><p>three</p>", "one two\n\nthree\n"),
    ("break", "<p>a<br>b</p>", "a\nb\n"),  # lines are trimmed at the right
    ("rule", "<p>a</p><hr><p>b</p>", "a\n\n---\n\nb\n"),
    ("emphasis", "<p><b>s</b> <i>e</i> <del>d</del></p>", "**s** *e* ~~d~~\n"),
    ("empty emphasis", "<p><b> </b>x</p>", "x\n"),
    ("code", "<p>say <code>x = 1</code></p>", "say `x = 1`\n"),
    ("code with marks", "<p><code>a``b</code> <code>`c</code></p>", "```a``b``` `` `c ``\n"),
    ("pre", '<pre><code class="language-py">a = 1\n  b</code></pre>', "```py\na = 1\n  b\n```\n"),
    ("quote", "<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b\n"),
    ("link", '<p><a href="/x y">t</a></p>', "[t](https://d.example/x%20y)\n"),
    ("no link", "<p>x<a href='#f'>y</a><a href='javascript:z'>w</a></p>", "xyw\n"),
    ("image", '<p><img src="/i (1).png" alt="a_b"></p>', "![a\\_b](https://d.example/i%20%281%29.png)\n"),
    ("list", "<ul><li>a<li>b</ul>", "- a\n- b\n"),
    ("numbers", "<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n\n    - c\n"),
    ("table", "<table><tr><th>Q<th>B<tr><td>N|E<td>7</table>", "| Q | B |\n| --- | --- |\n| N\\|E | 7 |\n"),
    ("one column", "<table><tr><td>only<tr><td>one</table>", "only\none\n"),
    ("terms", "<dl><dt>t<dd>d</dl>", "**t**\n: d\n"),
    ("caption", "<figure><img src='/a.png'><figcaption>C</figcaption></figure>", "![](https://d.example/a.png)\n*C*\n"),
    ("containers", "<div><section>a</section><span>b</span> <custom-x>c</custom-x></div>", "a\n\nb c\n"),
    ("escapes", "<p># a *b* [c] `d`</p>", "\\# a \\*b\\* \\[c\\] \\`d\\`\n"),
    ("stray item", "<div><li>x</div>", "- x\n"),
    ("nothing", "", "\n"),
]

#: (base, text, address)
JOINS = [
    ("https://News.example/2026/story", "/für?q=ö#x y", "https://news.example/f%C3%BCr?q=%C3%B6#x%20y"), ("https://a.b/c/d", "../e/./f", "https://a.b/e/f"), ("https://a.b/c/d", "?q", "https://a.b/c/d?q"), ("https://a.b/c/d?x", "#f", "https://a.b/c/d?x#f"),
    ("https://a.b/", "//C.d:443/x", "https://c.d/x"), ("http://a.b/c", "mailto:x@y", "mailto:x@y"), ("http://a/b", "http://exa mple/", None), ("http://a.b/c/", "x\\y", "http://a.b/c/x/y"), ("http://a/b", "http://0x7f.1/", "http://127.0.0.1/"), ("http://a/b/c", "..", "http://a/"), ("http://a/b/c", "%2e%2e/d", "http://a/d"),
    ("http://a/", "http://b:99999/", None), (None, "/x", None), ("http://a/b", "", "http://a/b"),
]
#: (address, scheme, host, path, query, fragment)
PARTS = [("HTTPS://U:p@Ex.example:8443/a/../b?c=d#e", "https", "ex.example", "/b", "c=d", "e"), ("http://[2001:DB8::1]/", "http", "[2001:db8::1]", "/", None, None), ("mailto:a@b", "mailto", None, "a@b", None, None), ("no address", None, None, None, None, None)]

_LATIN = "Le marché déplacé, déjà très fêté à Nîmes".encode("cp1252")
_CYRILLIC = "Привет, мир".encode("cp1251")
#: (case, bytes, content type, charset, text)
BODIES = [
    ("mark", b"\xef\xbb\xbf" + "é".encode(), "text/html; charset=iso-8859-1", "utf-8", "é"),
    ("header", _CYRILLIC, "text/html; charset=windows-1251", "windows-1251", "Привет, мир"),
    ("meta", b'<meta charset="windows-1251"><p>' + _CYRILLIC, "text/html", "windows-1251", '<meta charset="windows-1251"><p>Привет, мир'),
    ("http-equiv", b'<meta http-equiv="Content-Type" content="text/html; charset=koi8-r"><p>' + "мир".encode("koi8-r"), None, "koi8-r", '<meta http-equiv="Content-Type" content="text/html; charset=koi8-r"><p>мир'),
    ("data attribute is none", b'<meta data-charset="koi8-r"><p>\xc3\xa9', "text/html", "utf-8", '<meta data-charset="koi8-r"><p>é'),
    ("undeclared utf-8", "déjà".encode(), None, "utf-8", "déjà"),
    ("undeclared latin", _LATIN, None, "windows-1252", "Le marché déplacé, déjà très fêté à Nîmes"),
    ("wide", "﻿hé".encode("utf-16-le"), None, "utf-16le", "hé"),
]
#: (case, bytes, content type, kind)
KINDS = [
    ("declared", b"x", "text/html; charset=utf-8", "html"), ("xhtml", b"x", "application/xhtml+xml", "html"), ("pdf mark", b"%PDF-1.7", "text/html", "pdf"), ("feed", b"x", "application/atom+xml", "xml"), ("json", b"{}", "application/ld+json", "json"), ("sound", b"x", "audio/ogg", "media"), ("picture", b"x", "image/png", "image"),
    ("sniffed doctype", b" \n<!DOCTYPE html><p>", None, "html"), ("sniffed body", b"<div><body>", None, "html"), ("not sniffed", b"hello <body>", None, "other"), ("unknown", b"<html>", "application/x-thing", "other"),
]
#: (case, HTML, target)
REFRESH = [
    ("prompt", '<meta http-equiv="refresh" content="0; url=/next">', "https://d.example/next"), ("quoted", "<meta http-equiv=Refresh content=\"3;URL='b?c'\">", "https://d.example/a/b?c"), ("slow", '<meta http-equiv="refresh" content="30; url=/next">', None), ("reload", '<meta http-equiv="refresh" content="2">', None),
    ("second", '<meta http-equiv="refresh" content="9; url=/x"><meta http-equiv="refresh" content="1; url=/y">', "https://d.example/y"), ("none", "<p>x</p>", None),
]
_LINKS = '<base href="/ignored/"><a href="/a">A</a><a href="/a">again</a><a href="#top">T</a><a href="javascript:x()">J</a><a href="mailto:a@b">M</a><a>none</a><a href="b.html"> two  words </a>'
#: (what, n, address) of one page at https://d.example/a/p
LINKS = (
    _LINKS + '<link rel="stylesheet" href="/s.css"><script src="/x.js"></script><script src="https://www.google-analytics.com/a.js"></script><img src="i.png"><link rel="modulepreload" href="/m.js">',
    [("strict", 0, "https://d.example/a"), ("strict", 1, "mailto:a@b"), ("strict", 2, "https://d.example/a/b.html"), ("prefetch", 0, "https://d.example/x.js"), ("prefetch", 1, "https://d.example/m.js")],
)
#: (case, source, addresses)
MODULES = [
    ("named", "import { a } from './a.js'; import b from \"/b.js\";", "./a.js /b.js"), ("bare", "import x from 'lib';", ""), ("effect", "import './c.js'", "./c.js"), ("dynamic", "const m = await import('https://c.example/m.js')", "https://c.example/m.js"), ("member", "a.import('./no.js')", ""), ("minified", "import{a as b}from'./d.js'", "./d.js"), ("none", "x = 1", ""),
]
#: (case, HTML of a head, field, value)
METADATA = [
    ("og before title", "<title>T</title><meta property=og:title content=O>", "title", "O"), ("title tag", "<title> A  b </title>", "title", "A b"), ("suffix", "<title>A long headline | Site</title>", "title", "A long headline"), ("first wins", "<meta name=author content=' '><meta name=Author content=A><meta name=author content=B>", "author", "A"),
    ("ld author", '<script type="application/ld+json">{"@type":"Article","author":[{"name":"X"},"Y"]}</script>', "author", "X, Y"), ("ld image", '<script type="application/ld+json">{"@type":"Article","image":{"url":"/i.png"}}</script>', "image", "https://d.example/i.png"), ("canonical", '<link rel=canonical href="/c">', "canonical_url", "https://d.example/c"),
    ("graph", '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","datePublished":"2024-05-01"}]}</script>', "published", "2024-05-01"), ("broken", '<script type="application/ld+json">{x</script><meta name=description content="  D   d ">', "description", "D d"), ("site", "<meta property=og:site_name content=S>", "site_name", "S"),
    ("image", "<meta property=og:image content=/p.png>", "image", "https://d.example/p.png"),
]
#: (case, HTML, serialized body) after the tree builder's rules
NODES = [
    ("implied ends", "<p>a<p>b<ul><li>c<li>d</ul>", "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>"), ("table parts", "<table><tr><td>x", "<table><tbody><tr><td>x</td></tr></tbody></table>"), ("misnested", "<b>a<i>b</b>c</i>", "<b>a<i>b</i></b><i>c</i>"), ("entities", "a &lt; b &amp; &eacute;&nbsp;", "a &lt; b &amp; é&nbsp;"),
    ("void", "<br>a<img src=x>b</br>", "<br>a<img src=\"x\">b<br>"), ("fostered", "<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"), ("comment", "a<!-- b -->c", "a<!-- b -->c"), ("raw", "x<script>a<b</script>", "x<script>a<b</script>"), ("template", "x<template><p>t</template>", "x<template><p>t</p></template>"),
]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """SQL of a constant table; line ends within texts stand as they are."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) v({columns})"
