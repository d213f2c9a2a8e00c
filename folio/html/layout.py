"""Layout-aware rendering of one page into visible lines.

A single pass over the markup builds a light box tree: implied end tags close
paragraphs, list items, cells and options; visibility rules drop head, script,
style, noscript, comments, ``hidden`` and inline ``display:none`` subtrees.
What remains is emitted as *lines*: the text of one block box, or the stretch
of it up to a ``br`` or an inner block, white space collapsed.

Everything is iterative and linear in the length of the page, so a page of any
size or nesting depth is handled.
"""

from __future__ import annotations

import html as _html
import re

__all__ = ["Page", "render", "visible_lines", "render_text"]

#: Elements whose content is never markup: skipped in one step by the scanner.
_RAW = "script|style|noscript|title|textarea|iframe|noembed|noframes|xmp|template|svg|math|object|select"

_TOKEN = re.compile(
    r"<(?:"
    r"!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    rf"|({_RAW})(?=[\s/>])[^>]*+>(?:.*?</\1(?=[\s/>])[^>]*+>|.*\Z)"  # raw element
    r"|([a-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>"  # start tag
    r"|/([a-z][^\s/>]*+)[^>]*+>"  # end tag
    r"|[!?/][^>]*+>"  # doctype, bogus comment
    r")",
    re.S | re.I,
)

#: Block boxes: a start or end tag of one of these ends the current line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option "
    "p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: start tag -> (open tags it closes, tags that bound the search)
_IMPLIED = {
    "li": ({"li"}, frozenset("ul ol menu dir table td th body".split())),
    "dt": ({"dt", "dd"}, frozenset("dl table td th body".split())),
    "dd": ({"dt", "dd"}, frozenset("dl table td th body".split())),
    "td": ({"td", "th"}, frozenset({"table"})),
    "th": ({"td", "th"}, frozenset({"table"})),
    "tr": ({"tr"}, frozenset({"table"})),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, frozenset({"table"})),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, frozenset({"table"})),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, frozenset({"table"})),
    "option": ({"option"}, frozenset({"select", "body"})),
}
_CODE = frozenset("code kbd samp tt var".split())
_P_SCOPE = frozenset("table td th caption button body html object".split())
_SCOPE = frozenset("table td th caption html".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

_HIDE = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_HIDDEN_ATTR = re.compile(r"(?:^|\s|[\"'/])hidden(?=[\s=/]|$)", re.I)
_STYLE = re.compile(r"style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_NAME = re.compile(r"(?:^|[\s\"'])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _is_hidden(attrs: str) -> bool:
    """``hidden`` as an attribute of its own, or an inline ``display: none``."""
    if not _HIDE.search(attrs):
        return False
    if _HIDDEN_ATTR.search(_QUOTED.sub("=", attrs)):
        return True
    m = _STYLE.search(attrs)
    return bool(m and _NONE.search(_html.unescape(m[1] or m[2] or m[3] or "")))


def names(attrs: str) -> str:
    """class, id and role of a start tag, in lower case, joined by blanks."""
    return " ".join(a or b or c for a, b, c in _NAME.findall(attrs)).lower() if attrs else ""


class Page:
    """The rendered page.

    ``lines``: list of ``(text, box, tag, link_chars)``; ``box`` is an index into
    ``boxes``, a list of ``(parent, tag, attrs)`` of the *block* boxes in document
    order (0 is the root); ``tag`` the nearest block's tag. ``codes``: line number ->
    the pieces of it that stand in inline code.
    """

    __slots__ = ("boxes", "codes", "lines")

    def __init__(self):
        self.boxes = [(-1, "body", "")]
        self.lines = []
        self.codes = {}

    def path(self, box: int):
        """Boxes from ``box`` up to the root."""
        while box >= 0:
            yield box
            box = self.boxes[box][0]


def render(markup: str | None) -> Page:
    """Parse ``markup`` and lay it out. ``None`` and empty text give no lines."""
    page = Page()
    if not markup:
        return page
    boxes, lines = page.boxes, page.lines
    stack: list[tuple[str, int, int]] = []  # (tag, its block box, hidden depth marker)
    top = 0  # current block box
    buf: list[str] = []
    links = 0  # text characters inside <a> of this line
    anchors = 0
    hidden_at = -1  # length of the stack below the hidden element
    head = False
    pos = 0
    code_from = -1  # where inline code begins in the buffer
    codes: list[str] = []
    unescape = _html.unescape

    def flush():
        nonlocal links, code_from
        if buf:
            if code_from >= 0:
                codes.append("".join(buf[code_from:]))
                code_from = 0
            text = "".join(buf)
            buf.clear()
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                if codes:
                    page.codes[len(lines)] = [" ".join(unescape(c).split()) for c in codes if c.strip()]
                lines.append((text, top, boxes[top][1], links))
            if codes:
                codes.clear()
        links = 0

    def pop_to(depth: int):
        nonlocal top, hidden_at, anchors, code_from
        while len(stack) > depth:
            tag, box, _ = stack.pop()
            if tag in BLOCKS:
                if hidden_at < 0:
                    flush()
                if box == top:
                    top = boxes[box][0]
            elif tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _CODE and code_from >= 0:
                codes.append("".join(buf[code_from:]))
                code_from = -1
            if len(stack) == hidden_at:
                hidden_at = -1

    for m in _TOKEN.finditer(markup):
        start = m.start()
        if start > pos and hidden_at < 0 and not head:
            piece = markup[pos:start]
            buf.append(piece)
            if anchors:
                links += len(piece.strip())
        pos = m.end()
        tag = m[2]
        if tag is not None:
            tag = tag.lower()
            if tag == "br":
                if hidden_at < 0:
                    flush()
                continue
            if tag == "head":
                head = True
                continue
            if tag == "html" or tag == "body":
                if tag == "body":
                    head = False
                    buf.clear()
                    attrs = m[3]
                    if attrs and _is_hidden(attrs) and hidden_at < 0:
                        hidden_at = 0
                        stack.append(("body", 0, 0))
                continue
            attrs = m[3]
            block = tag in BLOCKS
            if head:
                if not block and tag in ("meta", "link", "base"):
                    continue
                head = False
                buf.clear()
            if block:
                if hidden_at < 0:
                    flush()
                if tag in _ENDS_P:
                    for i in range(len(stack) - 1, -1, -1):
                        t = stack[i][0]
                        if t == "p":
                            pop_to(i)
                            break
                        if t in _P_SCOPE:
                            break
                    if tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                        pop_to(len(stack) - 1)
                rule = _IMPLIED.get(tag)
                if rule:
                    closes, bounds = rule
                    for i in range(len(stack) - 1, -1, -1):
                        t = stack[i][0]
                        if t in closes:
                            pop_to(i)
                            break
                        if t in bounds:
                            break
            if tag in _VOID:
                if block and hidden_at < 0:
                    boxes.append((top, tag, attrs))
                continue
            if attrs.endswith("/") and not block and tag != "a":
                attrs = attrs[:-1]
            if hidden_at < 0 and attrs and _is_hidden(attrs):
                hidden_at = len(stack)
            if block:
                if hidden_at < 0:
                    boxes.append((top, tag, attrs))
                    top = len(boxes) - 1
                    stack.append((tag, top, 0))
                else:
                    stack.append((tag, -1, 0))
            else:
                if tag == "a":
                    anchors += 1
                elif tag in _CODE and code_from < 0:
                    code_from = len(buf)
                stack.append((tag, -1, 0))
            continue
        tag = m[4]
        if tag is not None:
            tag = tag.lower()
            if tag == "head":
                head = False
                buf.clear()
                continue
            if tag == "br":
                flush()
                continue
            if tag == "body" or tag == "html":
                continue
            block = tag in BLOCKS
            if not block:
                # an inline end tag closes its element unless a block opened since
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t == tag:
                        if len(stack) - 1 == i:
                            pop_to(i)
                        else:
                            if hidden_at == i:
                                pop_to(i)
                            else:
                                del stack[i]
                                if hidden_at > i:
                                    hidden_at -= 1
                                if tag == "a":
                                    anchors = max(0, anchors - 1)
                                elif tag in _CODE and code_from >= 0:
                                    codes.append("".join(buf[code_from:]))
                                    code_from = -1
                        break
                    if t in BLOCKS:
                        break
                continue
            if hidden_at < 0:
                flush()
            if tag in _HEADINGS:
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t in _HEADINGS:
                        pop_to(i)
                        break
                    if t in _SCOPE:
                        break
                continue
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == tag:
                    pop_to(i)
                    break
                if t in _SCOPE and tag not in _TABLE_PARTS:
                    break
                if tag == "li" and t in ("ul", "ol"):
                    break
                if t == "table" and tag != "table":
                    break
            continue
    if pos < len(markup) and hidden_at < 0 and not head:
        buf.append(markup[pos:])
    if hidden_at < 0:
        flush()
    return page


def visible_lines(markup: str | None) -> list[str]:
    """The visible lines of a page, in document order."""
    return [line[0] for line in render(markup).lines]


def render_text(page: Page, keep=None) -> str:
    """Plain text with the page's layout: a blank line between blocks, ``- `` or
    a counter before list items, the cells of a table row aligned in columns.

    ``keep``: optional set of line numbers; others are left out.
    """
    out: list[str] = []
    counters: dict[int, int] = {}
    rows: list[list[str]] = []
    row_box = -1

    def end_table():
        nonlocal row_box
        if rows:
            width = [max(len(r[i]) if i < len(r) else 0 for r in rows) for i in range(max(map(len, rows)))]
            out.append("\n".join(" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows))
            rows.clear()
        row_box = -1

    for n, (text, box, tag, _) in enumerate(page.lines):
        if keep is not None and n not in keep:
            continue
        path = list(page.path(box))
        tags = [page.boxes[b][1] for b in path]
        row = next((b for b, t in zip(path, tags) if t == "tr"), None)
        if row is not None and tag in ("td", "th"):
            if row != row_box:
                rows.append([])
                row_box = row
            rows[-1].append(text)
            continue
        end_table()
        if "li" in tags:
            li = path[tags.index("li")]
            parent = page.boxes[li][0]
            depth = sum(t in ("ul", "ol") for t in tags) - 1
            if li in counters:
                out.append("  " * (depth + 1) + text)
            else:
                counters[li] = 1
                mark = "- "
                if parent >= 0 and page.boxes[parent][1] == "ol":
                    counters[-parent - 1] = counters.get(-parent - 1, 0) + 1
                    mark = f"{counters[-parent - 1]}. "
                out.append("  " * max(depth, 0) + mark + text)
        else:
            out.append(text)
    end_table()
    text: list[str] = []
    for piece in out:
        listed = piece.lstrip().startswith(("- ", "1. ")) or bool(re.match(r"\s*\d+\. ", piece))
        if text:
            text.append("\n" if listed and text[-1].lstrip().startswith("- ") else "\n\n")
        text.append(piece)
    return "".join(text)
