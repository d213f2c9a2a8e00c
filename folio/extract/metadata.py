"""Metadata of a page: structured data first, then social cards, plain tags, and the document itself."""

from __future__ import annotations

import json

from folio.extract.readability import WHITE
from folio.functions.url import join
from folio.html.tree import ELEMENT, Tree

__all__ = ["FIELDS", "clean", "json_ld", "metadata", "strip_site_suffix", "truncate_chars"]

FIELDS = ("title", "description", "author", "site_name", "published", "modified", "canonical_url", "image", "language", "robots")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STRIP = "".join(WHITE)
_SPACES = str.maketrans(dict.fromkeys(WHITE, " "))
#: Keys of meta tags by field, in order of trust; separators of titles (fixed values).
KEYS = {
    "og_title": ("og:title", "twitter:title"),
    "description": ("og:description", "twitter:description", "description"),
    "author": ("author", "article:author", "twitter:creator"),
    "site_name": ("og:site_name", "application-name"),
    "published": ("article:published_time", "datepublished", "publish-date", "date", "dc.date"),
    "modified": ("article:modified_time", "datemodified", "lastmod"),
    "image": ("og:image", "twitter:image", "twitter:image:src"),
    "robots": ("robots",),
}
SEPARATORS = (" — ", " – ", " | ", " - ", " · ", " :: ")


def clean(text: str) -> str:
    return " ".join(w for w in text.translate(_SPACES).split(" ") if w)


def truncate_chars(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    cut = text[:most]
    at = cut.rfind(" ")
    return (cut[:at] if at >= 0 and len(cut[:at].encode("utf-8", "surrogatepass")) > most // 2 else cut) + "…"


def strip_site_suffix(title: str) -> str:
    for sep in SEPARATORS:
        head, found, tail = title.rpartition(sep)
        if found and head.strip(_STRIP) and len(tail) <= 40 and len(head) > len(tail):
            return head.strip(_STRIP)
    return title.strip(_STRIP)


def json_ld(tree: Tree) -> list:
    """Objects of all structured-data scripts, lists and graphs opened; a graph's members come before it."""
    out: list = []
    for n in tree.walk():
        if tree.tag[n] == "script" and tree.kind[n] == ELEMENT and (tree.attr(n, "type") or "").translate(_FOLD) == "application/ld+json":
            try:
                todo = [json.loads(tree.text_of(n).strip(_STRIP))]
            except (ValueError, RecursionError):
                continue
            while todo:
                v = todo.pop()
                if isinstance(v, list):
                    todo.extend(reversed(v))
                elif isinstance(v, tuple):
                    out.append(v[0])
                elif isinstance(v, dict):
                    if "@graph" in v:
                        todo += [(v,), v["@graph"]]
                    else:
                        out.append(v)
    return out


def _is_content(t: str) -> bool:
    return "Article" in t or "BlogPosting" in t or "WebPage" in t or t in ("Recipe", "Product", "Report")


def _author(v):
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        return v.get("name") if isinstance(v.get("name"), str) else None
    if isinstance(v, list):
        return ", ".join(x for x in map(_author, v) if x is not None) if any(_author(x) is not None for x in v) else None
    return None


def _image(v):
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        return v.get("url") if isinstance(v.get("url"), str) else None
    if isinstance(v, list):
        return next((x for x in map(_image, v) if x is not None), None)
    return None


def _structured(entries: list) -> tuple[dict, list[str]]:
    """First values of content entries; an entry counts once any type so far is one of content."""
    got: dict = {}
    types: list[str] = []
    content = False
    for e in entries:
        t = e.get("@type")
        new = [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []
        types += new
        content = content or any(map(_is_content, new))
        if not content:
            continue
        publisher = e.get("publisher")
        found = {k: e.get(k) if isinstance(e.get(k), str) else None for k in ("headline", "name", "description", "datePublished", "dateModified", "url")}
        found |= {"author": _author(e.get("author")), "image": _image(e.get("image")), "site_name": publisher.get("name") if isinstance(publisher, dict) and isinstance(publisher.get("name"), str) else None}
        for k, v in found.items():
            if v is not None and k not in got:
                got[k] = v
    return got, types


def _title(ld: dict, og: str | None, document: str | None) -> str | None:
    reference = document if document is not None else og
    if reference is not None:
        folded = reference.translate(_FOLD)
        for k in ("headline", "name"):
            v = ld.get(k)
            if v is not None and v.strip(_STRIP) and v.translate(_FOLD) in folded:
                return v
    for v in (ld.get("headline"), ld.get("name")):
        if v is not None:
            return v
    for v in (og, document):
        if v is not None:
            return strip_site_suffix(v)
    return None


def metadata(tree: Tree, base_url: str | None = None) -> dict:
    """The ten fields, ``feeds`` (url, title, kind) and ``schema_types``; with a base, addresses are made absolute."""
    tags: dict[str, str] = {}
    feeds: list[dict] = []
    canonical = None
    for n in tree.walk():
        if tree.kind[n] != ELEMENT:
            continue
        tag = tree.tag[n]
        if tag == "meta":
            content = tree.attr(n, "content")
            if content is not None and content.strip(_STRIP):
                for a in ("property", "name", "itemprop"):
                    key = tree.attr(n, a)
                    if key is not None:
                        tags.setdefault(key.translate(_FOLD), content)
        elif tag == "link":
            rel = tree.attr(n, "rel")
            if rel is None:
                continue
            rels = rel.translate(_FOLD).split()
            href = tree.attr(n, "href")
            if canonical is None and href is not None and "canonical" in rels:
                canonical = href
            kind = (tree.attr(n, "type") or "").translate(_FOLD)
            kind = "atom" if "atom" in kind else "rss" if "rss" in kind or "xml" in kind else None
            if kind and href is not None and "alternate" in rels:
                feeds.append({"url": href, "title": tree.attr(n, "title"), "kind": kind})
    first = {f: next((tags[k] for k in keys if k in tags), None) for f, keys in KEYS.items()}
    ld, types = _structured(json_ld(tree))
    head = tree.head
    node = tree.child(head, "title") if head is not None else None
    document = tree.text_of(node).strip(_STRIP) if node is not None else ""
    title = _title(ld, first["og_title"], document or None)
    lang = tree.attr(tree.html, "lang") if tree.html is not None else None
    out = {
        "title": title,
        "description": ld.get("description", first["description"]),
        "author": ld.get("author", first["author"]),
        "site_name": ld.get("site_name", first["site_name"]),
        "published": ld.get("datePublished", first["published"]),
        "modified": ld.get("dateModified", first["modified"]),
        "canonical_url": ld.get("url", canonical if canonical is not None else tags.get("og:url")),
        "image": ld.get("image", first["image"]),
        "language": lang if lang is not None and lang.strip(_STRIP) else tags.get("og:locale"),
        "robots": first["robots"],
    }
    if out["description"] is None and tree.body is not None:
        for n in tree.walk(tree.body):
            if tree.tag[n] == "p" and tree.kind[n] == ELEMENT:
                text = clean(tree.text_of(n))
                if len(text) >= 80:
                    out["description"] = truncate_chars(text, 300)
                    break
    for k in ("title", "description", "author", "site_name"):
        if out[k] is not None:
            out[k] = clean(out[k])
    if base_url:
        for k in ("canonical_url", "image"):
            if out[k] is not None:
                out[k] = join(base_url, out[k]) or out[k]
        for f in feeds:
            f["url"] = join(base_url, f["url"]) or f["url"]
    return {**out, "feeds": feeds, "schema_types": types}
