"""Selectors over a tree: one page at a time, used inside Arrow stages."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.css.parse import Complex, Compound, Nth, SelectorError, parse_selector
from folio.html.serialize import outer_html
from folio.html.tree import DOCUMENT, ELEMENT, TEXT, Tree, parse

__all__ = ["Matcher", "css_count", "css_select"]

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Elements that can be disabled, and state that no page at rest has.
_CONTROLS = frozenset("button input select textarea optgroup option fieldset".split())
_SPACES = " \t\n\r\f"


class Matcher:
    """A parsed selector, to be used on any number of trees. Raises SelectorError for text that is none."""

    def __init__(self, selector: str):
        self.list = parse_selector(selector)

    def all(self, tree: Tree, root: int = 0) -> list[int]:
        """Matching descendants of ``root`` in document order."""
        cache: dict = {}
        return [n for n in tree.walk(root) if tree.kind[n] == ELEMENT and _any(tree, n, self.list, cache)]

    def first(self, tree: Tree, root: int = 0) -> int | None:
        cache: dict = {}
        return next((n for n in tree.walk(root) if tree.kind[n] == ELEMENT and _any(tree, n, self.list, cache)), None)

    def matches(self, tree: Tree, node: int) -> bool:
        return tree.kind[node] == ELEMENT and _any(tree, node, self.list, {})

    def closest(self, tree: Tree, node: int) -> int | None:
        """The node itself or its nearest matching ancestor."""
        while node >= 0:
            if self.matches(tree, node):
                return node
            node = tree.parent[node]
        return None


def _elements(tree: Tree, parent: int, cache: dict) -> list[int]:
    key = ("kids", parent)
    if key not in cache:
        cache[key] = [k for k in tree.kids[parent] if tree.kind[k] == ELEMENT]
    return cache[key]


def _position(tree: Tree, node: int, cache: dict) -> int:
    parent = tree.parent[node]
    key = ("at", parent)
    if key not in cache:
        cache[key] = {k: i for i, k in enumerate(_elements(tree, parent, cache))}
    return cache[key][node]


def _any(tree: Tree, node: int, members: list[Complex] | tuple, cache: dict, scope: int | None = None) -> bool:
    return any(_complex(tree, node, c.parts, len(c.parts) - 1, cache, scope) for c in members)


def _complex(tree: Tree, node: int, parts: tuple, at: int, cache: dict, scope: int | None) -> bool:
    """Whether ``node`` is the subject of parts[: at + 1]; a relative selector's first combinator leads to ``scope``."""
    key = ("m", node, id(parts), at, scope)
    if key in cache:
        return cache[key]
    comb, compound = parts[at]
    ok = _compound(tree, node, compound, cache)
    if ok and (at or scope is not None):
        parent = tree.parent[node]
        if comb == ">":
            near = [parent]
        elif comb == " ":
            near = tree.ancestors(node)
        elif parent < 0:
            near = []
        else:
            before = _elements(tree, parent, cache)[: _position(tree, node, cache)]
            near = before[-1:] if comb == "+" else reversed(before)
        if at:
            ok = any(tree.kind[x] == ELEMENT and _complex(tree, x, parts, at - 1, cache, scope) for x in near if x >= 0)
        else:
            ok = any(x == scope for x in near)
    cache[key] = ok
    return ok


def _attr_test(value: str | None, op: str, want: str | None, flag: str) -> bool:
    if value is None:
        return False
    if not op:
        return True
    if flag == "i":
        value, want = value.translate(_FOLD), want.translate(_FOLD)
    if op == "=":
        return value == want
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return not any(c in _SPACES for c in want) and want in value.split()
    return value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else want in value


def _nth(index: int, n: Nth) -> bool:
    """``index`` counts from 1."""
    d = index - n.b
    return d == 0 if not n.a else d % n.a == 0 and d // n.a >= 0


def _state(tree: Tree, node: int, name: str, cache: dict) -> bool:
    tag, attr = tree.tag[node], tree.attr
    if name == "root":
        return tree.parent[node] >= 0 and tree.kind[tree.parent[node]] == DOCUMENT
    if name == "empty":
        return not any(tree.kind[k] == ELEMENT or tree.kind[k] == TEXT and tree.text[k] for k in tree.kids[node])
    if name in ("any-link", "link"):
        return tag in ("a", "area", "link") and attr(node, "href") is not None
    if name in ("disabled", "enabled"):
        return tag in _CONTROLS and (attr(node, "disabled") is not None) == (name == "disabled")
    if name == "checked":
        return tag == "input" and attr(node, "checked") is not None or tag == "option" and attr(node, "selected") is not None
    if name == "required":
        return attr(node, "required") is not None
    if name == "optional":
        return tag in ("input", "select", "textarea") and attr(node, "required") is None
    if name in ("read-write", "read-only"):
        writable = tag in ("input", "textarea") and attr(node, "readonly") is None and attr(node, "disabled") is None
        return writable == (name == "read-write")
    if name == "placeholder-shown":
        return attr(node, "placeholder") is not None and not attr(node, "value")
    if name == "scope":
        return tree.parent[node] >= 0 and tree.kind[tree.parent[node]] == DOCUMENT
    return name == "defined"


def _compound(tree: Tree, node: int, compound: Compound, cache: dict) -> bool:
    for test in compound.tests:
        kind = test[0]
        if kind == "tag":
            ok = tree.tag[node] == test[1]
        elif kind == "id":
            value = tree.attr(node, "id")
            ok = value == test[1] or tree.quirks and value is not None and value.translate(_FOLD) == test[1].translate(_FOLD)
        elif kind == "class":
            value = tree.attr(node, "class")
            ok = value is not None and (test[1] in value.split() or tree.quirks and test[1].translate(_FOLD) in value.translate(_FOLD).split())
        elif kind == "attr":
            ok = _attr_test(tree.attr(node, test[1]), *test[2:])
        elif kind == "is":
            ok = _any(tree, node, test[1], cache)
        elif kind == "not":
            ok = not _any(tree, node, test[1], cache)
        elif kind == "has":
            ok = any(_has(tree, node, c, cache) for c in test[1])
        elif kind in ("nth", "only"):
            own = _siblings(tree, node, test, cache)
            if kind == "only":
                ok = len(own) == 1
            else:
                at = own.get(node)
                ok = at is not None and _nth(len(own) - at if test[1] else at + 1, test[3])
        elif kind == "pseudo":
            ok = _state(tree, node, test[1], cache)
        else:
            ok = False
        if not ok:
            return False
    return True


def _siblings(tree: Tree, node: int, test: tuple, cache: dict) -> dict[int, int]:
    """Positions among the siblings that count for a structural test."""
    parent = tree.parent[node]
    of_type = test[1] if test[0] == "only" else test[2]
    of = test[3].of if test[0] == "nth" else ()
    key = ("sib", parent, tree.tag[node] if of_type else None, of)
    if key not in cache:
        own = _elements(tree, parent, cache) if parent >= 0 else [node]
        if of_type:
            own = [k for k in own if tree.tag[k] == tree.tag[node] and tree.ns[k] == tree.ns[node]]
        if of:
            own = [k for k in own if _any(tree, k, of, cache)]
        cache[key] = {k: i for i, k in enumerate(own)}
    return cache[key]


def _has(tree: Tree, node: int, relative: Complex, cache: dict) -> bool:
    first = relative.parts[0][0]
    if first in (" ", ">"):
        pool = tree.walk(node)
    else:
        parent = tree.parent[node]
        if parent < 0:
            return False
        after = _elements(tree, parent, cache)[_position(tree, node, cache) + 1 :]
        pool = (x for s in after for x in (s, *tree.walk(s)))
    return any(tree.kind[x] == ELEMENT and _complex(tree, x, relative.parts, len(relative.parts) - 1, cache, node) for x in pool)


@cache
def _select(selector: str, what: str):
    matcher = Matcher(selector)  # a bad selector fails on the driver

    @F.arrow_udf("int" if what == "count" else "array<string>")
    def of(html: pa.Array) -> pa.Array:
        out = []
        for h in html.to_pylist():
            tree = parse(h)
            found = matcher.all(tree)
            out.append(len(found) if what == "count" else [outer_html(tree, n) if what == "html" else tree.text_of(n) for n in found])
        return pa.array(out, pa.int32() if what == "count" else pa.list_(pa.string()))

    return of


def css_select(html: Column, selector: str, what: str = "text") -> Column:
    """Texts (or ``html``) of the matching elements of a page, in document order; one parse, no shuffle."""
    if what not in ("text", "html"):
        raise SelectorError("what is 'text' or 'html'")
    return _select(selector, what)(html)


def css_count(html: Column, selector: str) -> Column:
    """Number of matching elements."""
    return _select(selector, "count")(html)
