"""HTML tree construction after the public WHATWG standard, in columns.

``parse`` returns a ``Tree``: parallel lists by node id (0 is the document) instead of node
objects, so that a page turns into Arrow arrays without a walk. Building is iterative; depth
costs memory only. Implied elements, foster parenting, the list of active formatting elements
with its reconstruction and the adoption agency, templates and foreign content are covered.
"""

from __future__ import annotations

import html as _html
import re

__all__ = ["COMMENT", "DOCTYPE", "DOCUMENT", "ELEMENT", "TEXT", "Tree", "parse", "parse_fragment"]

ELEMENT, TEXT, COMMENT, DOCUMENT, DOCTYPE = 1, 3, 8, 9, 10
MAX_ERRORS = 256

_TAG = re.compile(
    r"<(?:(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>"
    r"|!--(?P<comment>>|->|.*?(?:--!?>|\Z))|!doctype(?P<doctype>[^>]*+)>?|(?P<bogus>[!?/][^>]*+>?)|(?P<eof>/?[a-zA-Z][^>]*+\Z))",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*+|(?=[\s>])))?)?", re.S)
_RAWTEXT = frozenset("style xmp iframe noembed noframes noscript script".split())
_RCDATA = frozenset("title textarea".split())

_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr image".split())
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split()
)
_SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select "
    "source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_LIST_SCOPE = _SCOPE | {"ol", "ul"}
_BUTTON_SCOPE = _SCOPE | {"button"}
_TABLE_SCOPE = frozenset("html table template".split())
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_IMPLIED_ALL = _IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_SPACES = " \t\n\f\r"


class Tree:
    """``parent``, ``kind``, ``tag``, ``attrs`` (pairs in order), ``text``, ``ns``, ``kids`` by node id; ``content``: template -> its fragment."""

    __slots__ = ("attrs", "content", "errors", "kids", "kind", "ns", "parent", "quirks", "tag", "text")

    def __init__(self):
        self.parent, self.kind, self.tag, self.attrs, self.text, self.ns, self.kids = [-1], [DOCUMENT], [None], [()], [None], [None], [[]]
        self.content: dict[int, int] = {}
        self.errors: list[str] = []
        self.quirks = False

    def add(self, kind: int, tag=None, attrs=(), text=None, ns=None) -> int:
        self.parent.append(-1)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.ns.append(ns)
        self.kids.append([])
        return len(self.parent) - 1

    def attr(self, node: int, name: str) -> str | None:
        for k, v in self.attrs[node]:
            if k == name:
                return v
        return None

    def detach(self, node: int) -> None:
        p = self.parent[node]
        if p >= 0:
            self.kids[p].remove(node)
            self.parent[node] = -1

    def append(self, parent: int, node: int) -> None:
        self.detach(node)
        self.kids[parent].append(node)
        self.parent[node] = parent

    def insert(self, parent: int, at: int, node: int) -> None:
        self.detach(node)
        self.kids[parent].insert(at, node)
        self.parent[node] = parent

    def walk(self, root: int = 0):
        """Descendants in document order, without ``root``; template contents are apart."""
        stack = [iter(self.kids[root])]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            yield node
            if self.kids[node]:
                stack.append(iter(self.kids[node]))

    def ancestors(self, node: int):
        node = self.parent[node]
        while node >= 0:
            yield node
            node = self.parent[node]

    def text_of(self, node: int) -> str:
        """Text of a subtree, pieces not separated."""
        if self.kind[node] == TEXT:
            return self.text[node]
        return "".join(self.text[n] for n in self.walk(node) if self.kind[n] == TEXT)

    def child(self, parent: int, *tags: str) -> int | None:
        return next((n for n in self.kids[parent] if self.kind[n] == ELEMENT and self.tag[n] in tags), None)

    @property
    def html(self) -> int | None:
        return next((n for n in self.kids[0] if self.kind[n] == ELEMENT), None)

    @property
    def head(self) -> int | None:
        return None if self.html is None else self.child(self.html, "head")

    @property
    def body(self) -> int | None:
        return None if self.html is None else self.child(self.html, "body", "frameset")


def _attributes(raw: str) -> tuple:
    if not raw or raw.isspace() or raw == "/":
        return ()
    seen = {}
    for name, a, b, c in _ATTR.findall(raw):
        name = name.lower()
        if name not in seen:
            value = a or b or c
            seen[name] = _html.unescape(value) if "&" in value else value
    return tuple(seen.items())


class _Builder:
    def __init__(self, markup: str, context: str | None = None):
        self.src = markup.replace("\r\n", "\n").replace("\r", "\n")
        self.t = Tree()
        self.open: list[int] = []
        self.fmt: list = []  # node ids, None is a marker
        self.mode = self.initial
        self.back = None
        self.head = None
        self.form = None
        self.modes: list = []  # of templates
        self.foster = False
        self.pending: list[str] | None = None
        self.skip_newline = False
        self.context = context
        self.frames = True

    # -- tree helpers
    def error(self, what: str) -> None:
        if len(self.t.errors) < MAX_ERRORS:
            self.t.errors.append(what)

    def top(self) -> int:
        return self.open[-1]

    def top_tag(self) -> str | None:
        return self.t.tag[self.open[-1]] if self.open else None

    def place(self, override: int | None = None) -> tuple[int, int]:
        """(parent, position) at which a node goes in, foster parenting included."""
        t = self.t
        target = self.open[-1] if override is None else override
        if self.foster and t.tag[target] in ("table", "tbody", "tfoot", "thead", "tr"):
            for k in range(len(self.open) - 1, -1, -1):
                n = self.open[k]
                if t.tag[n] == "template":
                    return t.content[n], len(t.kids[t.content[n]])
                if t.tag[n] == "table":
                    p = t.parent[n]
                    if p >= 0:
                        return p, t.kids[p].index(n)
                    before = self.open[k - 1]
                    return before, len(t.kids[before])
            return self.open[0], len(t.kids[self.open[0]])
        if target in t.content:
            target = t.content[target]
        return target, len(t.kids[target])

    def insert_text(self, s: str) -> None:
        if not s:
            return
        t = self.t
        p, at = self.place()
        if p == 0:
            return
        if at and t.kind[t.kids[p][at - 1]] == TEXT:
            t.text[t.kids[p][at - 1]] += s
            return
        t.insert(p, at, t.add(TEXT, text=s))

    def insert_comment(self, s: str, parent: int | None = None) -> None:
        n = self.t.add(COMMENT, text=s)
        p, at = (parent, len(self.t.kids[parent])) if parent is not None else self.place()
        self.t.insert(p, at, n)

    def insert_element(self, tag: str, attrs=(), ns=None, push: bool = True) -> int:
        t = self.t
        n = t.add(ELEMENT, tag, attrs, ns=ns)
        if self.open:
            p, at = self.place()
        else:
            p, at = 0, len(t.kids[0])
        t.insert(p, at, n)
        if tag == "template" and ns is None:
            f = t.add(DOCUMENT)
            t.content[n] = f
        if push:
            self.open.append(n)
        return n

    def in_scope(self, tags, bounds=_SCOPE) -> bool:
        tag = self.t.tag
        for n in reversed(self.open):
            if tag[n] in tags:
                return True
            if tag[n] in bounds:
                return False
        return False

    def pop_until(self, tags) -> None:
        while self.open:
            n = self.open.pop()
            if self.t.tag[n] in tags:
                return

    def implied(self, but: str | None = None, which=_IMPLIED) -> None:
        while self.open and self.top_tag() in which and self.top_tag() != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope(("p",), _BUTTON_SCOPE):
            self.implied("p")
            self.pop_until(("p",))

    def clear_to(self, tags) -> None:
        while self.open and self.top_tag() not in tags and self.top_tag() not in ("template", "html"):
            self.open.pop()

    # -- active formatting
    def push_fmt(self, n: int) -> None:
        t = self.t
        same = 0
        for k in range(len(self.fmt) - 1, -1, -1):
            f = self.fmt[k]
            if f is None:
                break
            if t.tag[f] == t.tag[n] and sorted(t.attrs[f]) == sorted(t.attrs[n]):
                same += 1
                if same == 3:
                    del self.fmt[k]
                    break
        self.fmt.append(n)

    def clear_fmt(self) -> None:
        while self.fmt and self.fmt.pop() is not None:
            pass

    def reconstruct(self) -> None:
        if not self.fmt or self.fmt[-1] is None or self.fmt[-1] in self.open:
            return
        k = len(self.fmt) - 1
        while k > 0 and self.fmt[k - 1] is not None and self.fmt[k - 1] not in self.open:
            k -= 1
        for j in range(k, len(self.fmt)):
            f = self.fmt[j]
            self.fmt[j] = self.insert_element(self.t.tag[f], self.t.attrs[f])

    def adopt(self, tag: str) -> None:
        """The adoption agency, as the standard numbers it."""
        t = self.t
        if self.top_tag() == tag and self.top() not in self.fmt:
            self.open.pop()
            return
        for _ in range(8):
            f = None
            for x in reversed(self.fmt):
                if x is None:
                    break
                if t.tag[x] == tag:
                    f = x
                    break
            if f is None:
                self.any_end(tag)
                return
            if f not in self.open:
                self.fmt.remove(f)
                return
            if not self.in_scope((tag,)):
                return
            at = self.open.index(f)
            block = next((n for n in self.open[at + 1 :] if t.tag[n] in _SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.fmt.remove(f)
                return
            common = self.open[at - 1]
            mark = self.fmt.index(f)
            node = last = block
            pos = self.open.index(block)
            inner = 0
            while True:
                inner += 1
                pos -= 1
                node = self.open[pos]
                if node == f:
                    break
                if inner > 3 and node in self.fmt:
                    k = self.fmt.index(node)
                    del self.fmt[k]
                    if k < mark:
                        mark -= 1
                if node not in self.fmt:
                    del self.open[pos]
                    continue
                new = t.add(ELEMENT, t.tag[node], t.attrs[node], ns=t.ns[node])
                self.fmt[self.fmt.index(node)] = new
                self.open[pos] = new
                node = new
                if last == block:
                    mark = self.fmt.index(new) + 1
                t.append(node, last)
                last = node
            keep, self.foster = self.foster, True
            p, where = self.place(common)
            self.foster = keep
            was = t.parent[last]
            if was == p and t.kids[p].index(last) < where:
                where -= 1
            t.insert(p, where, last)
            new = t.add(ELEMENT, t.tag[f], t.attrs[f], ns=t.ns[f])
            for kid in list(t.kids[block]):
                t.append(new, kid)
            t.append(block, new)
            k = self.fmt.index(f)
            del self.fmt[k]
            if k < mark:
                mark -= 1
            self.fmt.insert(mark, new)
            self.open.remove(f)
            self.open.insert(self.open.index(block) + 1, new)

    def any_end(self, tag: str) -> None:
        t = self.t
        for k in range(len(self.open) - 1, -1, -1):
            n = self.open[k]
            if t.tag[n] == tag:
                self.implied(tag)
                del self.open[k:]
                return
            if t.tag[n] in _SPECIAL:
                self.error(f"unexpected </{tag}>")
                return

    def reset_mode(self) -> None:
        t = self.t
        for k in range(len(self.open) - 1, -1, -1):
            n = self.open[k]
            tag = self.context if k == 0 and self.context else t.tag[n]
            last = k == 0
            if tag == "select":
                self.mode = self.in_select
                return
            if tag in ("td", "th") and not last:
                self.mode = self.in_cell
                return
            mode = {"tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table, "body": self.in_body}.get(tag)
            if tag == "template":
                mode = self.modes[-1] if self.modes else self.in_body
            elif tag == "head" and not last:
                mode = self.in_head
            elif tag == "html" and mode is None:
                mode = self.before_head if self.head is None else self.after_head
                if self.context:
                    mode = self.in_body
            if mode is not None:
                self.mode = mode
                return
            if last:
                self.mode = self.in_body
                return

    # -- tokens: kind is "s" start, "e" end, "t" text, "c" comment, "d" doctype, "" end of file
    def initial(self, kind, name, attrs):
        if kind == "t":
            name = name.lstrip(_SPACES)
            if not name:
                return None
        elif kind == "c":
            self.insert_comment(name, 0)
            return None
        elif kind == "d":
            parts = name.split(None, 1)
            n = self.t.add(DOCTYPE, tag=(parts[0].lower() if parts else ""), text=name)
            self.t.append(0, n)
            self.t.quirks = not parts or parts[0].lower() != "html"
            self.mode = self.before_html
            return None
        self.t.quirks = kind != "d"
        self.mode = self.before_html
        return (kind, name, attrs)

    def before_html(self, kind, name, attrs):
        if kind == "d":
            return None
        if kind == "c":
            self.insert_comment(name, 0)
            return None
        if kind == "t":
            name = name.lstrip(_SPACES)
            if not name:
                return None
        if kind == "s" and name == "html":
            self.insert_element("html", attrs)
            self.mode = self.before_head
            return None
        if kind == "e" and name not in ("head", "body", "html", "br"):
            return None
        self.insert_element("html")
        self.mode = self.before_head
        return (kind, name, attrs)

    def before_head(self, kind, name, attrs):
        if kind == "t":
            name = name.lstrip(_SPACES)
            if not name:
                return None
        elif kind == "c":
            self.insert_comment(name)
            return None
        elif kind == "d":
            return None
        elif kind == "s" and name == "html":
            return self.in_body(kind, name, attrs)
        elif kind == "s" and name == "head":
            self.head = self.insert_element("head", attrs)
            self.mode = self.in_head
            return None
        elif kind == "e" and name not in ("head", "body", "html", "br"):
            return None
        self.head = self.insert_element("head")
        self.mode = self.in_head
        return (kind, name, attrs)

    def in_head(self, kind, name, attrs):
        if kind == "t":
            white = name[: len(name) - len(name.lstrip(_SPACES))]
            self.insert_text(white)
            name = name[len(white) :]
            if not name:
                return None
        elif kind == "c":
            self.insert_comment(name)
            return None
        elif kind == "d":
            return None
        elif kind == "s":
            if name == "html":
                return self.in_body(kind, name, attrs)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert_element(name, attrs, push=False)
                return None
            if name == "template":
                self.insert_element(name, attrs)
                self.fmt.append(None)
                self.frames = False
                self.mode = self.in_template
                self.modes.append(self.in_template)
                return None
            if name in _HEAD:
                self.raw_element(name, attrs)
                return None
            if name == "head":
                return None
        elif kind == "e":
            if name == "head":
                self.open.pop()
                self.mode = self.after_head
                return None
            if name == "template":
                if any(self.t.tag[n] == "template" for n in self.open):
                    self.implied(which=_IMPLIED_ALL)
                    self.pop_until(("template",))
                    self.clear_fmt()
                    if self.modes:
                        self.modes.pop()
                    self.reset_mode()
                return None
            if name not in ("body", "html", "br"):
                return None
        self.open.pop()
        self.mode = self.after_head
        return (kind, name, attrs)

    def after_head(self, kind, name, attrs):
        if kind == "t":
            white = name[: len(name) - len(name.lstrip(_SPACES))]
            self.insert_text(white)
            name = name[len(white) :]
            if not name:
                return None
        elif kind == "c":
            self.insert_comment(name)
            return None
        elif kind == "d":
            return None
        elif kind == "s":
            if name == "html":
                return self.in_body(kind, name, attrs)
            if name == "body":
                self.insert_element("body", attrs)
                self.mode = self.in_body
                return None
            if name == "frameset":
                self.insert_element("frameset", attrs)
                self.mode = self.in_frameset
                return None
            if name in _HEAD:
                self.open.append(self.head)
                rest = self.in_head(kind, name, attrs)
                if self.head in self.open:
                    self.open.remove(self.head)
                return rest
            if name == "head":
                return None
        elif kind == "e":
            if name == "template":
                return self.in_head(kind, name, attrs)
            if name not in ("body", "html", "br"):
                return None
        self.insert_element("body")
        self.mode = self.in_body
        return (kind, name, attrs)

    def in_body(self, kind, name, attrs):
        t = self.t
        if kind == "t":
            name = name.replace("\0", "")
            if self.skip_newline:
                self.skip_newline = False
                if name.startswith("\n"):
                    name = name[1:]
            if name:
                if self.fmt:
                    self.reconstruct()
                self.insert_text(name)
            return None
        self.skip_newline = False
        if kind == "s":
            if name in _FORMATTING:
                if name == "a":
                    for f in reversed(self.fmt):
                        if f is None:
                            break
                        if t.tag[f] == "a":
                            self.adopt("a")
                            if f in self.fmt:
                                self.fmt.remove(f)
                            if f in self.open:
                                self.open.remove(f)
                            break
                self.reconstruct()
                if name == "nobr" and self.in_scope(("nobr",)):
                    self.adopt("nobr")
                    self.reconstruct()
                self.push_fmt(self.insert_element(name, attrs))
            elif name in _BLOCK:
                self.close_p()
                self.insert_element(name, attrs)
            elif name in _HEADINGS:
                self.close_p()
                if self.top_tag() in _HEADINGS:
                    self.open.pop()
                self.insert_element(name, attrs)
            elif name == "li":
                for n in reversed(self.open):
                    tag = t.tag[n]
                    if tag == "li":
                        self.implied("li")
                        self.pop_until(("li",))
                        break
                    if tag in _SPECIAL and tag not in ("address", "div", "p"):
                        break
                self.close_p()
                self.insert_element(name, attrs)
            elif name in ("dd", "dt"):
                for n in reversed(self.open):
                    tag = t.tag[n]
                    if tag in ("dd", "dt"):
                        self.implied(tag)
                        self.pop_until((tag,))
                        break
                    if tag in _SPECIAL and tag not in ("address", "div", "p"):
                        break
                self.close_p()
                self.insert_element(name, attrs)
            elif name == "html":
                if not any(t.tag[n] == "template" for n in self.open) and self.open:
                    self.merge(self.open[0], attrs)
            elif name in _HEAD and name not in ("noframes", "noscript"):
                return self.in_head(kind, name, attrs)
            elif name == "body":
                if len(self.open) > 1 and t.tag[self.open[1]] == "body" and not any(t.tag[n] == "template" for n in self.open):
                    self.frames = False
                    self.merge(self.open[1], attrs)
            elif name in ("pre", "listing"):
                self.close_p()
                self.insert_element(name, attrs)
                self.skip_newline = True
            elif name == "form":
                if self.form is None or any(t.tag[n] == "template" for n in self.open):
                    self.close_p()
                    n = self.insert_element(name, attrs)
                    if not any(t.tag[x] == "template" for x in self.open):
                        self.form = n
            elif name == "plaintext":
                self.close_p()
                self.insert_element(name, attrs)
                self.insert_text(self.src[self.pos :])
                self.pos = len(self.src)
            elif name == "button":
                if self.in_scope(("button",)):
                    self.implied()
                    self.pop_until(("button",))
                self.reconstruct()
                self.insert_element(name, attrs)
            elif name in ("applet", "marquee", "object"):
                self.reconstruct()
                self.insert_element(name, attrs)
                self.fmt.append(None)
            elif name == "table":
                if not t.quirks:
                    self.close_p()
                self.insert_element(name, attrs)
                self.mode = self.in_table
            elif name in ("area", "br", "embed", "img", "image", "keygen", "wbr", "input"):
                self.reconstruct()
                self.insert_element("img" if name == "image" else name, attrs, push=False)
            elif name in ("param", "source", "track"):
                self.insert_element(name, attrs, push=False)
            elif name == "hr":
                self.close_p()
                self.insert_element(name, attrs, push=False)
            elif name in ("textarea", "xmp", "iframe", "noembed", "noscript", "noframes"):
                if name == "xmp":
                    self.close_p()
                    self.reconstruct()
                self.raw_element(name, attrs)
            elif name == "select":
                self.reconstruct()
                self.insert_element(name, attrs)
                self.mode = self.in_select
            elif name in ("optgroup", "option"):
                if self.top_tag() == "option":
                    self.open.pop()
                self.reconstruct()
                self.insert_element(name, attrs)
            elif name in ("rb", "rtc"):
                if self.in_scope(("ruby",)):
                    self.implied()
                self.insert_element(name, attrs)
            elif name in ("rp", "rt"):
                if self.in_scope(("ruby",)):
                    self.implied("rtc")
                self.insert_element(name, attrs)
            elif name in ("math", "svg"):
                self.reconstruct()
                self.insert_element(name, attrs, ns=name, push=not self.self_closing)
            elif name in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr", "frameset"):
                self.error(f"unexpected <{name}>")
            else:
                self.reconstruct()
                self.insert_element(name, attrs)
            return None
        if kind == "e":
            if name in _FORMATTING:
                self.adopt(name)
            elif name == "p":
                if not self.in_scope(("p",), _BUTTON_SCOPE):
                    self.insert_element("p")
                self.close_p()
            elif name in _BLOCK or name in ("button", "listing", "pre"):
                if self.in_scope((name,)):
                    self.implied()
                    self.pop_until((name,))
                else:
                    self.error(f"unexpected </{name}>")
            elif name == "li":
                if self.in_scope(("li",), _LIST_SCOPE):
                    self.implied("li")
                    self.pop_until(("li",))
            elif name in ("dd", "dt"):
                if self.in_scope((name,)):
                    self.implied(name)
                    self.pop_until((name,))
            elif name in _HEADINGS:
                if self.in_scope(_HEADINGS):
                    self.implied()
                    self.pop_until(_HEADINGS)
            elif name == "form":
                n, self.form = self.form, None
                if n is not None and n in self.open and self.in_scope(("form",)):
                    self.implied()
                    self.open.remove(n)
            elif name in ("applet", "marquee", "object"):
                if self.in_scope((name,)):
                    self.implied()
                    self.pop_until((name,))
                    self.clear_fmt()
            elif name == "br":
                self.reconstruct()
                self.insert_element("br", push=False)
            elif name in ("body", "html"):
                if self.in_scope(("body",)):
                    self.mode = self.after_body
                    if name == "html":
                        return (kind, name, attrs)
            elif name == "template":
                return self.in_head(kind, name, attrs)
            else:
                self.any_end(name)
            return None
        if kind == "c":
            self.insert_comment(name)
        elif kind == "" and self.modes:
            return self.in_template(kind, name, attrs)
        return None

    def merge(self, node: int, attrs) -> None:
        have = {k for k, _ in self.t.attrs[node]}
        self.t.attrs[node] = (*self.t.attrs[node], *((k, v) for k, v in attrs if k not in have))

    def in_table(self, kind, name, attrs):
        if kind == "t" and self.top_tag() in ("table", "tbody", "template", "tfoot", "thead", "tr"):
            if name.strip(_SPACES):
                return self.fostered(kind, name, attrs)
            self.insert_text(name)
            return None
        if kind == "c":
            self.insert_comment(name)
            return None
        if kind == "d":
            return None
        if kind == "s":
            if name == "caption":
                self.clear_to(("table",))
                self.fmt.append(None)
                self.insert_element(name, attrs)
                self.mode = self.in_caption
                return None
            if name in ("colgroup", "col"):
                self.clear_to(("table",))
                self.insert_element("colgroup", attrs if name == "colgroup" else ())
                self.mode = self.in_column_group
                return None if name == "colgroup" else (kind, name, attrs)
            if name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to(("table",))
                own = name in ("tbody", "tfoot", "thead")
                self.insert_element(name if own else "tbody", attrs if own else ())
                self.mode = self.in_table_body
                return None if own else (kind, name, attrs)
            if name == "table":
                if self.in_scope(("table",), _TABLE_SCOPE):
                    self.pop_until(("table",))
                    self.reset_mode()
                    return (kind, name, attrs)
                return None
            if name in ("style", "script", "template"):
                return self.in_head(kind, name, attrs)
            if name == "input" and dict(attrs).get("type", "").lower() == "hidden":
                self.insert_element(name, attrs, push=False)
                return None
            if name == "form":
                if self.form is None:
                    self.form = self.insert_element(name, attrs)
                    self.open.pop()
                return None
        elif kind == "e":
            if name == "table":
                if self.in_scope(("table",), _TABLE_SCOPE):
                    self.pop_until(("table",))
                    self.reset_mode()
                return None
            if name in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return None
            if name == "template":
                return self.in_head(kind, name, attrs)
        elif kind == "":
            return self.in_body(kind, name, attrs)
        return self.fostered(kind, name, attrs)

    def fostered(self, kind, name, attrs):
        self.foster = True
        rest = self.in_body(kind, name, attrs)
        self.foster = False
        return rest

    def in_caption(self, kind, name, attrs):
        close = kind == "e" and name in ("caption", "table") or kind == "s" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if close:
            if self.in_scope(("caption",), _TABLE_SCOPE):
                self.implied()
                self.pop_until(("caption",))
                self.clear_fmt()
                self.mode = self.in_table
                return None if kind == "e" and name == "caption" else (kind, name, attrs)
            return None
        if kind == "e" and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return None
        return self.in_body(kind, name, attrs)

    def in_column_group(self, kind, name, attrs):
        if kind == "t":
            white = name[: len(name) - len(name.lstrip(_SPACES))]
            self.insert_text(white)
            name = name[len(white) :]
            if not name:
                return None
        elif kind == "c":
            self.insert_comment(name)
            return None
        elif kind == "s" and name == "col":
            self.insert_element(name, attrs, push=False)
            return None
        elif kind in ("s", "e") and name == "template":
            return self.in_head(kind, name, attrs)
        elif kind == "":
            return self.in_body(kind, name, attrs)
        if self.top_tag() != "colgroup":
            return None
        self.open.pop()
        self.mode = self.in_table
        return None if kind == "e" and name == "colgroup" else (kind, name, attrs)

    def in_table_body(self, kind, name, attrs):
        groups = ("tbody", "tfoot", "thead")
        if kind == "s":
            if name == "tr":
                self.clear_to(groups)
                self.insert_element(name, attrs)
                self.mode = self.in_row
                return None
            if name in ("td", "th"):
                self.clear_to(groups)
                self.insert_element("tr")
                self.mode = self.in_row
                return (kind, name, attrs)
        if kind == "e" and name in groups:
            if self.in_scope((name,), _TABLE_SCOPE):
                self.clear_to(groups)
                self.open.pop()
                self.mode = self.in_table
            return None
        if kind == "s" and name in ("caption", "col", "colgroup", *groups) or kind == "e" and name == "table":
            if self.in_scope(groups, _TABLE_SCOPE):
                self.clear_to(groups)
                self.open.pop()
                self.mode = self.in_table
                return (kind, name, attrs)
            return None
        if kind == "e" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return None
        return self.in_table(kind, name, attrs)

    def in_row(self, kind, name, attrs):
        if kind == "s" and name in ("td", "th"):
            self.clear_to(("tr",))
            self.insert_element(name, attrs)
            self.mode = self.in_cell
            self.fmt.append(None)
            return None
        ends = kind == "e" and name in ("tr", "table", "tbody", "tfoot", "thead") or kind == "s" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")
        if ends:
            if kind == "e" and name in ("tbody", "tfoot", "thead") and not self.in_scope((name,), _TABLE_SCOPE):
                return None
            if self.in_scope(("tr",), _TABLE_SCOPE):
                self.clear_to(("tr",))
                self.open.pop()
                self.mode = self.in_table_body
                return None if kind == "e" and name == "tr" else (kind, name, attrs)
            return None
        if kind == "e" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return None
        return self.in_table(kind, name, attrs)

    def in_cell(self, kind, name, attrs):
        if kind == "e" and name in ("td", "th"):
            if self.in_scope((name,), _TABLE_SCOPE):
                self.implied()
                self.pop_until((name,))
                self.clear_fmt()
                self.mode = self.in_row
            return None
        if kind == "s" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr") or kind == "e" and name in ("table", "tbody", "tfoot", "thead", "tr"):
            if kind == "e" and not self.in_scope((name,), _TABLE_SCOPE):
                return None
            if self.in_scope(("td", "th"), _TABLE_SCOPE):
                self.implied()
                self.pop_until(("td", "th"))
                self.clear_fmt()
                self.mode = self.in_row
                return (kind, name, attrs)
            return None
        if kind == "e" and name in ("body", "caption", "col", "colgroup", "html"):
            return None
        return self.in_body(kind, name, attrs)

    def in_select(self, kind, name, attrs):
        if kind == "t":
            self.insert_text(name.replace("\0", ""))
        elif kind == "c":
            self.insert_comment(name)
        elif kind == "s":
            if name in ("option", "optgroup", "hr"):
                if self.top_tag() == "option":
                    self.open.pop()
                if name != "option" and self.top_tag() == "optgroup":
                    self.open.pop()
                self.insert_element(name, attrs, push=name != "hr")
            elif name in ("select", "input", "keygen", "textarea", "caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
                if self.in_scope(("select",), _TABLE_SCOPE):
                    self.pop_until(("select",))
                    self.reset_mode()
                    return None if name == "select" else (kind, name, attrs)
            elif name in ("script", "template"):
                return self.in_head(kind, name, attrs)
        elif kind == "e":
            if name == "option" and self.top_tag() == "option":
                self.open.pop()
            elif name == "optgroup":
                if self.top_tag() == "option" and len(self.open) > 1 and self.t.tag[self.open[-2]] == "optgroup":
                    self.open.pop()
                if self.top_tag() == "optgroup":
                    self.open.pop()
            elif name == "select" or name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self.in_scope((name,), _TABLE_SCOPE):
                if self.in_scope(("select",), _TABLE_SCOPE):
                    self.pop_until(("select",))
                    self.reset_mode()
                    return None if name == "select" else (kind, name, attrs)
            elif name == "template":
                return self.in_head(kind, name, attrs)
        return None

    def in_template(self, kind, name, attrs):
        if kind in ("t", "c", "d"):
            return self.in_body(kind, name, attrs)
        if kind == "s":
            if name in _HEAD and name not in ("noframes", "noscript"):
                return self.in_head(kind, name, attrs)
            mode = self.in_table if name in ("caption", "colgroup", "tbody", "tfoot", "thead") else self.in_column_group if name == "col" else self.in_table_body if name == "tr" else self.in_row if name in ("td", "th") else self.in_body
            self.modes[-1] = mode
            self.mode = mode
            return (kind, name, attrs)
        if kind == "e":
            return self.in_head(kind, name, attrs) if name == "template" else None
        if not any(self.t.tag[n] == "template" for n in self.open):
            return None
        self.pop_until(("template",))
        self.clear_fmt()
        self.modes.pop()
        self.reset_mode()
        return (kind, name, attrs)

    def after_body(self, kind, name, attrs):
        if kind == "t" and not name.strip(_SPACES):
            return self.in_body(kind, name, attrs)
        if kind == "c":
            self.insert_comment(name, self.open[0] if kind else 0)
            return None
        if kind == "d" or kind == "e" and name == "html" or kind == "":
            return None
        self.mode = self.in_body
        return (kind, name, attrs)

    def in_frameset(self, kind, name, attrs):
        if kind == "s" and name == "frameset":
            self.insert_element(name, attrs)
        elif kind == "s" and name == "frame":
            self.insert_element(name, attrs, push=False)
        elif kind == "s" and name == "noframes":
            self.raw_element(name, attrs)
        elif kind == "e" and name == "frameset" and len(self.open) > 1:
            self.open.pop()
        elif kind == "c":
            self.insert_comment(name)
        elif kind == "t":
            self.insert_text("".join(c for c in name if c in _SPACES))
        return None

    def foreign(self, kind, name, attrs) -> bool:
        """Tokens within svg and math; False where the rules for html take over."""
        t = self.t
        node = self.top()
        if kind == "t":
            self.insert_text(name.replace("\0", "�"))
            return True
        if kind == "c":
            self.insert_comment(name)
            return True
        if kind == "s":
            if name in _BREAKOUT or name == "font" and any(k in ("color", "face", "size") for k, _ in attrs):
                while self.open and t.ns[self.top()] is not None and t.tag[self.top()] not in _INTEGRATION:
                    self.open.pop()
                return False
            self.insert_element(name, attrs, ns=t.ns[node], push=not self.self_closing)
            return True
        if kind == "e":
            for k in range(len(self.open) - 1, 0, -1):
                if t.tag[self.open[k]] == name:
                    del self.open[k:]
                    return True
                if t.ns[self.open[k - 1]] is None:
                    return False
        return kind != ""

    # -- driver
    def raw_element(self, name: str, attrs) -> None:
        """An element whose text is not markup: taken up to its end tag."""
        self.insert_element(name, attrs)
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(self.src, self.pos)
        body = self.src[self.pos : m.start() if m else len(self.src)]
        self.pos = m.end() if m else len(self.src)
        if name in _RCDATA:
            if name == "textarea" and body.startswith("\n"):
                body = body[1:]
            if "&" in body:
                body = _html.unescape(body)
        keep, self.foster = self.foster, False
        self.insert_text(body)
        self.foster = keep
        self.open.pop()

    def feed(self, kind, name, attrs) -> None:
        token = (kind, name, attrs)
        turns = 0
        while token is not None and turns < 64:
            turns += 1
            if self.open and token[0] and self.t.ns[self.top()] is not None:
                inside = self.t.tag[self.top()] in _INTEGRATION and token[0] in ("s", "t")
                if not inside and self.foreign(*token):
                    return
            token = self.mode(*token)

    def run(self) -> Tree:
        src = self.src
        self.pos = 0
        self.self_closing = False
        search = _TAG.search
        while self.pos < len(src):
            m = search(src, self.pos)
            at = m.start() if m else len(src)
            if at > self.pos:
                text = src[self.pos : at]
                self.feed("t", _html.unescape(text) if "&" in text else text, ())
            if m is None:
                break
            self.pos = m.end()
            name = m["name"]
            if name is not None:
                raw = m["attrs"]
                name = name.lower()
                if m["end"]:
                    self.feed("e", name, ())
                else:
                    self.self_closing = raw.endswith("/")
                    self.feed("s", name, _attributes(raw))
            elif m["comment"] is not None:
                body = m["comment"]
                body = body[: -4 if body.endswith("--!>") else -3] if body.endswith(("-->", "--!>")) else "" if body in (">", "->") else body
                self.feed("c", body, ())
            elif m["doctype"] is not None:
                self.feed("d", m["doctype"].strip(), ())
            elif m["bogus"] is not None:
                body = m["bogus"]
                if body == "</>":
                    continue
                body = body[1:] if body[0] in "!/" else body
                self.feed("c", body[:-1] if body.endswith(">") else body, ())
        self.feed("", "", ())
        return self.t


def parse(markup: str | None) -> Tree:
    """Tree of a whole document; null and empty text give html, head and body alone."""
    return _Builder(markup or "").run()


def parse_fragment(markup: str | None, context: str = "body") -> tuple[Tree, int]:
    """(tree, root) of markup as the inside of a ``context`` element."""
    b = _Builder(markup or "", context)
    root = b.insert_element("html")
    if context == "template":
        b.modes.append(b.in_template)
    b.mode = b.in_body
    b.reset_mode()
    if context in _RCDATA or context in _RAWTEXT or context == "plaintext":
        text = _html.unescape(b.src) if context in _RCDATA else b.src
        b.insert_text(text)
        return b.t, root
    b.run()
    return b.t, root
