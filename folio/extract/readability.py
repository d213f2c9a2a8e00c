"""The article of a page by text scores.

All subtree figures (visible characters, characters in links, commas) come from one pass from the
leaves up; white space that collapses across element borders is carried by the ends of each
piece, so no text is built more than once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from folio.html.tree import COMMENT, ELEMENT, TEXT, Tree

__all__ = ["Article", "Candidate", "article", "candidates", "noise", "text_sizes"]

# Fixed values of the scoring contract: tag sets and hint words.
STRIPPED = frozenset("script style noscript template svg canvas iframe object embed applet link meta form button input select textarea dialog".split())
CHROME = frozenset("nav header footer aside menu".split())
NEGATIVE = (
    "banner combx comment community cover-wrap disqus extra foot header legend menu modal related remark replies rss shoutbox sidebar skyscraper social sponsor supplemental "
    "ad-break agegate pagination pager popup yom-remote share promo newsletter subscribe cookie breadcrumb widget sitemap toolbar masthead nav- -nav advert "
    "reference reflist citation footnote bibliograph endnote further-reading navbox infobox metadata catlinks portal mw-editsection hatnote"
).split()
POSITIVE = "article body content entry hentry h-entry main page pagination post text blog story column prose markdown".split()
BLOCKS = frozenset("p td pre article section div blockquote li dd figure main body".split())
SEED_WEIGHT = {"p": 1.0, "pre": 1.0, "blockquote": 1.0, "td": 0.6, "figcaption": 0.6, "li": 0.25, "dd": 0.25}
TAG_SCORE = {
    "article": 10.0, "main": 10.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
    "address": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0,
    "h1": -5.0, "h2": -5.0, "h3": -5.0, "h4": -5.0, "h5": -5.0, "h6": -5.0, "th": -5.0,
}
LIST_LIMIT = 25
LEAST_SEED = 25
LEAST_ARTICLE = 200
PASSED_UP = (1.0, 2.0, 6.0)

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Unicode White_Space; ``str.isspace`` also takes the separators 1C to 1F.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


@dataclass
class Candidate:
    node: int
    score: float
    text_len: int
    link_density: float


@dataclass
class Article:
    """``roots``: kept siblings in order if ``grown``, else the one root; ``gone``: nodes dropped with their subtrees."""

    roots: list[int]
    grown: bool
    gone: set[int]
    text_len: int
    score: float
    fell_back: bool
    scored: dict[int, Candidate] = field(default_factory=dict)


def hints(tree: Tree, node: int) -> str:
    attr = tree.attr
    c, i, r = attr(node, "class"), attr(node, "id"), attr(node, "role")
    if c is None and i is None and r is None:
        return ""
    return ((f"{c} " if c is not None else "") + (f"{i} " if i is not None else "") + (r or "")).translate(_FOLD)


def _hint_factor(text: str) -> float:
    if not text:
        return 1.0
    return (0.2 if any(h in text for h in NEGATIVE) else 1.0) * (1.4 if any(h in text for h in POSITIVE) else 1.0) * (1.2 if "main" in text else 1.0)


def noise(tree: Tree, root: int) -> set[int]:
    """Nodes below ``root`` that no reader is meant to see; their subtrees go with them."""
    out = set()
    for n in tree.walk(root):
        if tree.kind[n] == COMMENT:
            out.add(n)
        elif tree.kind[n] == ELEMENT:
            if tree.tag[n] in STRIPPED:
                out.add(n)
                continue
            for k, v in tree.attrs[n]:
                if k == "hidden" or k == "aria-hidden" and v == "true":
                    out.add(n)
                elif k == "style":
                    s = v.replace(" ", "").translate(_FOLD)
                    if "display:none" in s or "visibility:hidden" in s:
                        out.add(n)
    return out


def _piece(text: str) -> tuple[int, bool, bool]:
    """(visible characters, white space before, white space after); (0, True, True) for white space alone."""
    if not text:
        return 0, False, False
    words = "".join(" " if c in WHITE else c for c in text).split(" ") if not text.isascii() else text.translate(_ASCII_WHITE).split(" ")
    body = [w for w in words if w]
    if not body:
        return 0, True, True
    return sum(map(len, body)) + len(body) - 1, not words[0], not words[-1]


_ASCII_WHITE = str.maketrans("\t\n\x0b\x0c\r", "     ")


class _Sizes:
    """Figures of every subtree under a root without the nodes in ``gone``."""

    def __init__(self, tree: Tree, root: int, gone: set[int]):
        self.order = order = [root]
        stack = [root]
        seen_gone = gone
        # pre-order without the dropped subtrees
        order.clear()
        while stack:
            n = stack.pop()
            order.append(n)
            stack.extend(k for k in reversed(tree.kids[n]) if k not in seen_gone)
        self.n: dict[int, int] = {}
        self.lead: dict[int, bool] = {}
        self.trail: dict[int, bool] = {}
        self.links: dict[int, int] = {}
        self.commas: dict[int, int] = {}
        for n in reversed(order):
            if tree.kind[n] == TEXT:
                t = tree.text[n]
                self.n[n], self.lead[n], self.trail[n] = _piece(t)
                self.links[n] = 0
                self.commas[n] = t.count(",") + t.count("，")
                continue
            size, lead, trail, links, commas = 0, False, False, 0, 0
            for k in tree.kids[n]:
                if k in seen_gone:
                    continue
                links += self.links[k] + (self.n[k] if tree.tag[k] == "a" and tree.kind[k] == ELEMENT else 0)
                commas += self.commas[k]
                if not self.n[k]:
                    if self.lead[k]:
                        trail = True
                        if not size:
                            lead = True
                    continue
                if size:
                    size += self.n[k] + (1 if trail or self.lead[k] else 0)
                else:
                    size = self.n[k]
                    lead = lead or self.lead[k]
                trail = self.trail[k]
            self.n[n], self.lead[n], self.trail[n], self.links[n], self.commas[n] = size, lead, trail, links, commas

    def density(self, node: int) -> float:
        return self.links[node] / self.n[node] if self.n[node] else 0.0


def text_sizes(tree: Tree, root: int, gone: set[int] | None = None) -> dict[int, int]:
    """Visible characters of every subtree under ``root``."""
    return _Sizes(tree, root, gone or set()).n


def _score(tree: Tree, root: int, s: _Sizes, gone: set[int]) -> dict[int, Candidate]:
    points: dict[int, float] = {}
    items: dict[int, int] = {}
    for n in s.order:
        if n == root or tree.kind[n] != ELEMENT:
            continue
        weight = SEED_WEIGHT.get(tree.tag[n])
        if weight is None or s.n[n] < LEAST_SEED:
            continue
        parent = tree.parent[n]
        if tree.tag[n] in ("li", "dd"):
            if parent not in items:
                items[parent] = sum(1 for k in tree.kids[parent] if k not in gone and tree.tag[k] in ("li", "dd"))
            if items[parent] > LIST_LIMIT:
                continue
        own = (1.0 + s.commas[n] + min(s.n[n] / 100.0, 3.0)) * weight
        up = parent
        for part in PASSED_UP:
            if up < 0:
                break
            if tree.kind[up] == ELEMENT:
                points[up] = points.get(up, 0.0) + own / part
            up = tree.parent[up]
    out = {}
    for n in s.order:
        tag = tree.tag[n]
        if n not in points or tag not in BLOCKS or tag in CHROME:
            continue
        density = s.density(n)
        out[n] = Candidate(n, (points[n] + TAG_SCORE.get(tag, 0.0)) * _hint_factor(hints(tree, n)) * (1.0 - density), s.n[n], density)
    return out


def candidates(tree: Tree) -> list[Candidate]:
    """Scored blocks in document order."""
    root = tree.body if tree.body is not None else 0
    gone = noise(tree, root)
    return list(_score(tree, root, _Sizes(tree, root, gone), gone).values())


def _best(tree: Tree, scored: dict[int, Candidate]) -> Candidate | None:
    fit = [c for c in scored.values() if c.link_density <= 0.5]
    if not fit:
        return None
    top = max(c.score for c in fit)
    chosen = next(c for c in fit if c.score == top)  # of equals the first in the document
    for up in tree.ancestors(chosen.node):
        c = scored.get(up)
        if c is not None and c.link_density <= 0.5 and c.score >= 0.85 * chosen.score:
            chosen = c
    return chosen


def _belongs(tree: Tree, node: int, best: Candidate, scored: dict[int, Candidate], s: _Sizes) -> bool:
    """Whether a sibling of the best block is part of the same article."""
    if tree.kind[node] != ELEMENT or tree.tag[node] in CHROME:
        return False
    c = scored.get(node)
    if c is not None and c.score >= max(0.2 * best.score, 10.0) and c.link_density < 0.4:
        return True
    tag, size, density = tree.tag[node], s.n[node], s.density(node)
    if tag == "p":
        return size > 80 and density < 0.25
    if tag not in ("section", "div", "article") or size <= 150 or density >= 0.35:
        return False
    text = hints(tree, node)
    return not any(h in text for h in NEGATIVE) and any(tree.kind[d] == ELEMENT and d in s.n and tree.tag[d] in ("h1", "h2", "h3", "h4") for d in tree.walk(node))


def _leftover(tree: Tree, node: int, s: _Sizes) -> bool:
    """Whether a block inside the article is chrome after all."""
    tag = tree.tag[node]
    if tag in CHROME:
        return True
    if tag not in ("div", "section", "ul", "ol", "table"):
        return False
    size = s.n[node]
    if not size:
        return not any(d in s.n and tree.tag[d] in ("img", "video", "picture", "figure") for d in tree.walk(node))
    density = s.density(node)
    text = hints(tree, node)
    negative = bool(text) and any(h in text for h in NEGATIVE)
    return density > 0.5 and size < 400 or negative and (density > 0.25 or size < 150)


def article(tree: Tree) -> Article:
    """The best block with what belongs to it; the whole body where that is missing or under 200 characters."""
    root = tree.body if tree.body is not None else 0
    gone = noise(tree, root)
    s = _Sizes(tree, root, gone)
    scored = _score(tree, root, s, gone)
    best = _best(tree, scored)
    if best is None or best.text_len < LEAST_ARTICLE:
        return Article([root], False, gone, s.n[root], best.score if best else 0.0, True, scored)
    roots, grown = [best.node], False
    parent = tree.parent[best.node]
    if parent >= 0 and tree.kind[parent] == ELEMENT:
        # the body itself may win: its siblings lie outside what was measured
        kept = [k for k in tree.kids[parent] if k == best.node or k in s.n and _belongs(tree, k, best, scored, s)]
        if len(kept) > 1:
            roots, grown = kept, True
    inside = list(roots) if grown else []
    for r in roots:
        inside += [d for d in tree.walk(r) if d in s.n]
    dropped = {d for d in inside if tree.kind[d] == ELEMENT and _leftover(tree, d, s)}
    gone = gone | dropped
    size, trail = 0, False
    for r in roots:
        if r in gone:
            continue
        part = _Sizes(tree, r, gone)
        if part.n[r]:
            size += part.n[r] + (1 if size and (trail or part.lead[r]) else 0)
            trail = part.trail[r]
        elif part.lead[r]:
            trail = True
    return Article(roots, grown, gone, size, best.score, False, scored)
