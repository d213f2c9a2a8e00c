"""Markdown of a subtree. Handlers are generators that name the nodes to write next, so depth costs no recursion."""

from __future__ import annotations

import re
from collections.abc import Iterator

from folio.extract.readability import WHITE
from folio.functions.url import join
from folio.html.tree import ELEMENT, TEXT, Tree

__all__ = ["collapse", "escape_inline", "escape_url", "to_markdown"]

_WHITE_RUN = re.compile("[" + "".join(re.escape(c) for c in sorted(WHITE)) + "]+")
_STRIP = "".join(WHITE)
_MARKED = re.compile(r"([\\`*_\[\]])")
_LINE_MARK = re.compile(r"(\A|\n)([#>\-+])")
_TICKS = re.compile("`+")
# Containers that start a block of their own, and those that do not.
_CONTAINERS = frozenset("div section article main body html header footer aside nav tbody thead tfoot video audio source details summary address center picture figure dl p".split())
_WRAPS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_SOURCES = ("src", "data-src", "data-original", "data-lazy-src")


def collapse(text: str) -> str:
    """Runs of white space as one blank each."""
    return _WHITE_RUN.sub(" ", text)


def escape_inline(text: str) -> str:
    """Marks that Markdown would read, and those that it reads at the start of a line (or of the text)."""
    return _LINE_MARK.sub(r"\1\\\2", _MARKED.sub(r"\\\1", text))


def escape_url(url: str) -> str:
    return url.replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def _fence(text: str, least: int) -> str:
    return "`" * max(least, 1 + max((len(m) for m in _TICKS.findall(text)), default=0))


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and not out[-1]:
        out.pop()
    return [x.removesuffix("\r") for x in out]


class _Writer:
    def __init__(self, tree: Tree, gone: set[int], base: str | None, images: bool, links: bool, max_chars: int | None):
        self.tree, self.gone, self.base, self.images, self.links, self.most = tree, gone, base, images, links, max_chars
        self.out: list[str] = []  # characters
        self.lists: list[list] = []  # [ordered, counter]
        self.pre = False
        self.full = False
        self.look = 0  # characters before which the size cannot reach the limit

    # -- output
    def push(self, s: str) -> None:
        if self.full:
            return
        self.out.extend(s)
        if self.most is not None and len(self.out) >= self.look:
            left = self.most - len("".join(self.out).encode("utf-8", "surrogatepass"))
            self.full = left <= 0
            self.look = len(self.out) + max(1, left // 4)  # a character has four bytes at most

    def block(self) -> None:
        out = self.out
        if not out:
            return
        while out and out[-1] == " ":
            out.pop()
        if out[-2:] != ["\n", "\n"]:
            out.extend("\n" if out[-1:] == ["\n"] else "\n\n")

    def line(self) -> None:
        if self.out and self.out[-1] != "\n":
            self.out.append("\n")

    def take(self, start: int) -> list[str]:
        """What was written since ``start``, as lines without line ends around them."""
        inner = "".join(self.out[start:])
        del self.out[start:]
        return _lines(inner.strip("\n"))

    # -- tree
    def kids(self, node: int) -> Iterator[int]:
        for k in self.tree.kids[node]:
            if self.full:
                return
            if k not in self.gone:
                yield k

    def text(self, node: int) -> str:
        if not self.gone:
            return self.tree.text_of(node)
        out, stack = [], [node]
        while stack:
            n = stack.pop()
            if self.tree.kind[n] == TEXT:
                out.append(self.tree.text[n])
            stack.extend(k for k in reversed(self.tree.kids[n]) if k not in self.gone)
        return "".join(out)

    def resolve(self, url: str) -> str:
        return (join(self.base, url) or url) if self.base else url

    def run(self, nodes: list[int]) -> str:
        stack: list[Iterator[int]] = [iter(nodes)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            elif not self.full or len(stack) > 1:
                stack.append(self.write(node))
        return _normal("".join(self.out))

    def write(self, node: int) -> Iterator[int]:
        tree = self.tree
        if tree.kind[node] == TEXT:
            if self.pre:
                self.push(tree.text[node])
            else:
                s = collapse(tree.text[node])
                if s and not (s == " " and (not self.out or self.out[-1] == "\n")):
                    self.push(escape_inline(s))
            return
        if tree.kind[node] != ELEMENT:
            return
        tag = tree.tag[node]
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.block()
            self.push("#" * int(tag[1]) + " ")
            yield from self.kids(node)
            self.block()
        elif tag in _CONTAINERS:
            self.block()
            yield from self.kids(node)
            self.block()
        elif tag in _WRAPS:
            if self.text(node).strip(_STRIP):
                self.push(_WRAPS[tag])
                yield from self.kids(node)
                self.push(_WRAPS[tag])
        elif tag == "br":
            self.push("  \n")
        elif tag == "hr":
            self.block()
            self.push("---")
            self.block()
        elif tag == "code" and not self.pre:
            s = self.text(node)
            fence = _fence(s, 1)
            pad = " " if s.startswith("`") or s.endswith("`") else ""
            self.push(f"{fence}{pad}{s}{pad}{fence}")
        elif tag == "pre":
            self.code_block(node)
        elif tag == "blockquote":
            self.block()
            start = len(self.out)
            yield from self.kids(node)
            self.push("\n".join(f"> {x}" if x else ">" for x in self.take(start)))
            self.block()
        elif tag == "a":
            href = (tree.attr(node, "href") or "").strip(_STRIP)
            plain = not self.links or not href or href.startswith("#") or href.lower().startswith("javascript:") or not self.text(node).strip(_STRIP)
            if plain:
                yield from self.kids(node)
            else:
                self.push("[")
                yield from self.kids(node)
                self.push(f"]({escape_url(self.resolve(href))})")
        elif tag == "img":
            self.image(node)
        elif tag == "figcaption":
            self.line()
            self.push("*")
            yield from self.kids(node)
            self.push("*")
            self.block()
        elif tag in ("ul", "ol"):
            self.block()
            self.lists.append([tag == "ol", 0])
            yield from self.kids(node)
            self.lists.pop()
            self.block()
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = "- "
            if self.lists:
                self.lists[-1][1] += 1
                if self.lists[-1][0]:
                    mark = f"{self.lists[-1][1]}. "
            self.line()
            self.push("  " * depth + mark)
            start = len(self.out)
            yield from self.kids(node)
            body = self.take(start)
            self.push("\n".join(x if not k or not x else "  " * (depth + 1) + x for k, x in enumerate(body)))
            self.line()
        elif tag == "dt":
            self.line()
            self.push("**")
            yield from self.kids(node)
            self.push("**")
            self.line()
        elif tag == "dd":
            self.push(": ")
            yield from self.kids(node)
            self.line()
        elif tag == "table":
            self.table(node)
        else:
            yield from self.kids(node)

    def code_block(self, node: int) -> None:
        tree = self.tree
        code = next((d for d in tree.walk(node) if tree.tag[d] == "code" and d not in self.gone), None)
        classes = (tree.attr(code, "class") or "").split() if code is not None else []
        language = next((c.split("-", 1)[1] for c in classes if c.startswith(("language-", "lang-"))), "")
        body = self.text(node)
        fence = _fence(body, 3)
        self.block()
        self.push(f"{fence}{language}\n" + body.rstrip("\n") + f"\n{fence}")
        self.block()

    def image(self, node: int) -> None:
        if not self.images:
            return
        attr = self.tree.attr
        src = next((v for v in (attr(node, a) for a in _SOURCES) if v is not None), None)
        if src is None or not src.strip(_STRIP):
            first = (attr(node, "srcset") or "").split(",")[0].split()
            src = first[0] if first else None
        if src is None or src.startswith("data:"):
            return
        self.push(f"![{escape_inline(collapse(attr(node, 'alt') or ''))}]({escape_url(self.resolve(src.strip(_STRIP)))})")

    def table(self, node: int) -> None:
        tree = self.tree
        rows = []
        stack = [node]
        while stack:
            n = stack.pop()
            if tree.tag[n] == "tr" and n != node:
                cells = [collapse(self.text(k)).replace("|", "\\|").strip(_STRIP) for k in tree.kids[n] if k not in self.gone and tree.tag[k] in ("td", "th")]
                if cells:
                    rows.append(cells)
            stack.extend(k for k in reversed(tree.kids[n]) if k not in self.gone)
        if not rows:
            return
        width = max(map(len, rows))
        self.block()
        for k, cells in enumerate(rows):
            self.push(" ".join(cells) if width < 2 else "| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
            self.line()
            if width >= 2 and not k:
                self.push("| " + " | ".join(["---"] * width) + " |")
                self.line()
        self.block()


def _normal(text: str) -> str:
    """One blank line at most between lines, no blanks at their ends, one line end at the end."""
    out: list[str] = []
    for line in _lines(text):
        line = line.rstrip(_STRIP)
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).rstrip(_STRIP) + "\n"


def to_markdown(tree: Tree, nodes: list[int], base_url: str | None = None, images: bool = True, links: bool = True, max_chars: int | None = None, gone: set[int] | None = None) -> str:
    """Markdown of ``nodes`` in order, without the subtrees in ``gone``."""
    gone = gone or set()
    return _Writer(tree, gone, base_url, images, links, max_chars).run([n for n in nodes if n not in gone])
