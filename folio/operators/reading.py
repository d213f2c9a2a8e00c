"""Readings of pages: metadata, article and Markdown in one parse; choice of source; links, assets and scripts."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.extract.markdown import to_markdown
from folio.extract.metadata import clean, metadata
from folio.extract.readability import article, candidates
from folio.functions.site import is_tracker_host, same_site_hosts
from folio.functions.url import join, parse as parse_url
from folio.html.serialize import document_html
from folio.html.tree import ELEMENT, parse
from folio.schema import LINK, READING, READING_SQL

__all__ = ["assets", "import_specifiers", "links", "prefetch", "read_one", "read_page", "refresh_target", "scored_blocks", "serialize", "visible_text"]

#: Selector, attribute and kind of what a page pulls in, in order (fixed values).
ASSETS = (("script", "src", "script"), ("link", "href", "link"), ("img", "src", "image"), ("source", "src", "media"), ("video", "src", "media"), ("audio", "src", "media"), ("iframe", "src", "frame"))
MAX_PREFETCH = 192
MAX_SPECIFIERS = 24


def read_one(html: str | None, url: str | None, images: bool = True, with_links: bool = True, max_chars: int | None = None) -> dict:
    """A reading; a failure of any kind is the field ``error``."""
    out = dict.fromkeys(READING_FIELDS)
    if html is None:
        return out | {"error": "no html"}
    try:
        tree = parse(html)
        out |= metadata(tree, url)
        a = article(tree)
        nodes = a.roots if a.grown else tree.kids[a.roots[0]]
        out |= {"content": to_markdown(tree, nodes, url, images, with_links, max_chars, a.gone), "length": a.text_len, "low_confidence": a.fell_back, "score": float(a.score)}
    except Exception as e:  # noqa: BLE001 - a page that fails is a row, not a failed job
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


READING_FIELDS = [f.name for f in READING]


@cache
def _reader(images: bool, with_links: bool, max_chars: int | None):
    @F.arrow_udf(READING_SQL)
    def read(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([read_one(h, u, images, with_links, max_chars) for h, u in zip(html.to_pylist(), url.to_pylist())], READING)

    return read


def read_page(html: Column, url: Column, images: bool = True, with_links: bool = True, max_chars: int | None = None) -> Column:
    """Struct of a reading; Catalyst keeps filters on other columns below it and drops it where it is not used."""
    return _reader(images, with_links, max_chars)(html, url)


def _links(html: str | None, base: str | None, limit: int | None = None, strict: bool = False) -> list[dict]:
    tree = parse(html)
    b = parse_url(base)
    seen: set[str] = set()
    out = []
    for n in tree.walk():
        if tree.kind[n] != ELEMENT or tree.tag[n] != "a":
            continue
        href = tree.attr(n, "href")
        if href is None:
            continue
        if strict:
            href = href.strip()
            if not href or href.startswith("#"):
                continue
        to = join(b, href) if b is not None else href
        if not to or strict and to.lower().startswith("javascript:") or to in seen:
            continue
        seen.add(to)
        out.append({"text": clean(tree.text_of(n)), "href": to})
        if limit and len(out) >= limit:
            break
    return out


@cache
def _linker(limit: int | None, strict: bool):
    @F.arrow_udf("array<struct<text: string, href: string>>")
    def of(html: pa.Array, base: pa.Array) -> pa.Array:
        return pa.array([_links(h, b, limit, strict) for h, b in zip(html.to_pylist(), base.to_pylist())], pa.list_(LINK))

    return of


def links(html: Column, base: Column, limit: int | None = None, strict: bool = False) -> Column:
    """Absolute links of a page, the first of each address. ``strict`` leaves out blank, fragment and script links; ``limit`` is the caller's."""
    return _linker(None if limit is None else min(max(limit, 1), 2000), strict)(html, base)


_ASSET = pa.struct([("url", pa.string()), ("kind", pa.string()), ("rel", pa.string())])


def _assets(html: str | None, base: str | None) -> list[dict]:
    tree = parse(html)
    b = parse_url(base)
    by_tag: dict[str, list[int]] = {}
    for n in tree.walk():
        if tree.kind[n] == ELEMENT:
            by_tag.setdefault(tree.tag[n], []).append(n)
    seen: set[str] = set()
    out = []
    for tag, name, kind in ASSETS:
        for n in by_tag.get(tag, ()):
            value = tree.attr(n, name)
            to = None if value is None else join(b, value) if b is not None else value
            if to and to not in seen:
                seen.add(to)
                out.append({"url": to, "kind": kind, "rel": tree.attr(n, "rel") or None})
    return out


def _prefetch(html: str | None, base: str | None) -> list[str]:
    tree = parse(html)
    b = parse_url(base)
    out: dict[str, None] = {}
    for n in tree.walk():
        if tree.kind[n] != ELEMENT or b is None:
            continue
        at = None
        if tree.tag[n] == "script":
            at = tree.attr(n, "src")
        elif tree.tag[n] == "link":
            rel = (tree.attr(n, "rel") or "").lower()
            if rel == "modulepreload" or rel == "preload" and (tree.attr(n, "as") or "").lower() == "script":
                at = tree.attr(n, "href")
        u = parse_url(at, b) if at is not None else None
        if u is None or is_tracker_host(u.host or "") and not same_site_hosts(u.host or "", b.host or ""):
            continue
        out[str(u)] = None
        if len(out) >= MAX_PREFETCH:
            break
    return list(out)


def _refresh(html: str | None, base: str | None) -> str | None:
    """Target of the first prompt refresh; one whose target is not ``url=`` ends the search."""
    tree = parse(html)
    for n in tree.walk():
        if tree.tag[n] != "meta" or (tree.attr(n, "http-equiv") or "").lower() != "refresh":
            continue
        content = tree.attr(n, "content")
        if content is None:
            continue
        delay, _, rest = content.partition(";")
        try:
            if float(delay.strip()) > 5.0:
                continue
        except ValueError:
            continue
        rest = rest.strip()
        if rest[:3] not in ("url", "URL") or not rest[3:].lstrip().startswith("="):
            return None
        target = rest[3:].lstrip()[1:].strip().strip("\"'")
        if target:
            return join(base, target)
    return None


_IMPORT = re.compile(r"(?<![A-Za-z0-9_$.])import")
_PLAIN = re.compile(r"[^\W]|[ \t\r\n{},*()_$]")


def import_specifiers(source: str | None) -> list[str]:
    """Addresses that a module imports, by a scan of its text: the first quoted string near each ``import``."""
    out: list[str] = []
    for m in _IMPORT.finditer(source or ""):
        rest = source[m.end() :].encode("utf-8", "surrogatepass")[:512].decode("utf-8", "ignore") if not source.isascii() else source[m.end() : m.end() + 512]
        q = re.search("[\"'`]", rest)
        if q is None or any(not (c.isalnum() or c in " \t\r\n{},*()_$") for c in rest[: q.start()]):
            continue
        spec, found, _ = rest[q.end() :].partition(q[0])
        if found and spec.startswith((".", "/", "http")):
            out.append(spec)
    return out[:MAX_SPECIFIERS]


_BLOCK = pa.struct([("node_id", pa.int32()), ("tag", pa.string()), ("score", pa.float64()), ("text_len", pa.int64()), ("link_density", pa.float64())])


def _scored(html: str | None) -> list[dict]:
    tree = parse(html)
    return [{"node_id": c.node, "tag": tree.tag[c.node], "score": round(c.score, 6), "text_len": c.text_len, "link_density": round(c.link_density, 6)} for c in candidates(tree)]


def _markdown(html: str | None, base: str | None) -> str:
    tree = parse(html)
    return to_markdown(tree, tree.kids[tree.body] if tree.body is not None else [], base)


_SKIPPED = frozenset("script style template noscript".split())


def _visible(html: str | None) -> str:
    """Text of the body without scripts, styles, templates and noscript; white space as it stands, a line end at the end."""
    tree = parse(html)
    root = tree.body if tree.body is not None else 0
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if tree.tag[n] in _SKIPPED and tree.kind[n] == ELEMENT:
            continue
        if tree.text[n] is not None and tree.kind[n] == 3:
            out.append(tree.text[n])
        stack.extend(reversed(tree.kids[n]))
    return "".join(out) + "\n"


@cache
def _udf(name: str):
    two = {"assets": (_assets, pa.list_(_ASSET), "array<struct<url: string, kind: string, rel: string>>"), "prefetch": (_prefetch, pa.list_(pa.string()), "array<string>"), "refresh": (_refresh, pa.string(), "string"), "markdown": (_markdown, pa.string(), "string")}
    one = {"serialize": (lambda h: document_html(parse(h)), pa.string(), "string"), "visible": (_visible, pa.string(), "string"), "imports": (import_specifiers, pa.list_(pa.string()), "array<string>"),
           "scored": (_scored, pa.list_(_BLOCK), "array<struct<node_id: int, tag: string, score: double, text_len: bigint, link_density: double>>")}
    if name in two:
        f, kind, sql = two[name]

        @F.arrow_udf(sql)
        def of(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], kind)

        return of
    g, kind, sql = one[name]

    @F.arrow_udf(sql)
    def of_one(a: pa.Array) -> pa.Array:
        return pa.array([g(x) for x in a.to_pylist()], kind)

    return of_one


def assets(html: Column, base: Column) -> Column:
    """What a page pulls in: (url, kind, rel), each address once, by kind of element."""
    return _udf("assets")(html, base)


def prefetch(html: Column, base: Column) -> Column:
    """Scripts and preloads worth fetching early; trackers of other sites left out."""
    return _udf("prefetch")(html, base)


def refresh_target(html: Column, base: Column) -> Column:
    return _udf("refresh")(html, base)


def markdown(html: Column, base: Column) -> Column:
    """The whole body as Markdown, without the choice of an article."""
    return _udf("markdown")(html, base)


def serialize(html: Column) -> Column:
    """The page as its tree writes it."""
    return _udf("serialize")(html)


def visible_text(html: Column) -> Column:
    return _udf("visible")(html)


def imports(source: Column) -> Column:
    return _udf("imports")(source)


def scored_blocks(html: Column) -> Column:
    """Blocks scored for the article, in document order."""
    return _udf("scored")(html)
