"""Markup of a tree: escapes, void and raw-text elements, template contents; iterative."""

from __future__ import annotations

from folio.html.tree import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, TEXT, Tree

__all__ = ["document_html", "inner_html", "outer_html"]

#: Elements without an end tag, and elements whose text is written as it is (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext noscript".split())


def _text(s: str) -> str:
    return s.replace("&", "&amp;").replace(" ", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _value(s: str) -> str:
    return s.replace("&", "&amp;").replace(" ", "&nbsp;").replace('"', "&quot;")


def _write(tree: Tree, nodes: list[int]) -> str:
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        kind = tree.kind[node]
        if kind == TEXT:
            parent = tree.parent[node]
            raw = parent >= 0 and tree.kind[parent] == ELEMENT and tree.tag[parent] in RAW
            out.append(tree.text[node] if raw else _text(tree.text[node]))
        elif kind == COMMENT:
            out.append(f"<!--{tree.text[node]}-->")
        elif kind == DOCTYPE:
            out.append(f"<!DOCTYPE {tree.tag[node]}>")
        elif kind == DOCUMENT:
            todo.extend(reversed(tree.kids[node]))
        else:
            tag = tree.tag[node]
            out.append(f"<{tag}" + "".join(f' {k}="{_value(v)}"' for k, v in tree.attrs[node]) + ">")
            if tag not in VOID:
                todo.append(f"</{tag}>")
                todo.extend(reversed(tree.kids[tree.content.get(node, node)]))
    return "".join(out)


def document_html(tree: Tree) -> str:
    return _write(tree, tree.kids[0])


def inner_html(tree: Tree, node: int) -> str:
    return _write(tree, tree.kids[node])


def outer_html(tree: Tree, node: int) -> str:
    return _write(tree, [node])
