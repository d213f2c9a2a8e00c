"""Main body of a page (problem 2): which visible lines belong to the article.

The page is first laid out (``folio.html.layout``): all visible text, block by
block. Three kinds of evidence then decide, line by line, all of it linear in
the page:

* *structure*: the boxes that hold menus (lists of short labels), related
  headlines, reader comments, notices and footers are found by what stands in
  them, never by their class names, and are dropped whole unless the headline
  stands in them too;
* *position*: what is left outside the headline's branch (other cells of a
  layout table, closing blocks after the article) is dropped;
* *phrases*: inside the article, bylines, reading times, tags, advertising
  marks, share and letter prompts and standing notes are dropped one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.html.layout import Page, render, render_text
from folio.session import spread

__all__ = ["article_lines", "chrome_kind", "main_bodies", "main_line_heads", "main_lines", "split_page"]

# Fixed phrase lists, by kind; matched against the case-folded line.
_COMMENT_HEAD = (
    r"\d+ (?:reader )?(?:comments?|commentaires?|comentarios?|kommentare?|leserkommentare?|replies|responses)"
    r"|(?:comments?|commentaires|comentarios|kommentare|комментари[ией]|replies|responses|discussion|leave a comment|join the conversation)(?: ?[:(] ?\d+\)?)?"
    r"|\d+ комментари[ийяев]+"
)
_REPLY = r"(?:reply|répondre|responder|antworten|ответить|report|signaler|melden|denunciar)"
_RELATED_HEAD = (
    r"you may also like|you might also like|read next|read more|read also|see also|related(?: (?:articles|stories|posts|news))?|recommended(?: for you)?|"
    r"most read|most popular|trending(?: now)?|more stories|more from .{2,60}|also on .{2,60}|"
    r"à lire aussi|lire aussi|à lire ensuite|articles liés|les plus lus|plus sur .{2,60}|"
    r"lea también|le puede interesar|te puede interesar|lo más leído|noticias relacionadas|más de .{2,60}|más en .{2,60}|"
    r"lesen sie auch|das könnte sie auch interessieren|mehr zum thema|weiterlesen|meistgelesen|mehr von .{2,60}|"
    r"читайте также|читайте далее|по теме|самое читаемое|смотрите также|ещё на .{2,60}|еще на .{2,60}"
)
_FOOTER = (
    r"(?:©|\(c\)|copyright).{0,80}|.*\b(?:all rights reserved|tous droits réservés|todos los derechos reservados|alle rechte vorbehalten)\b.*|.*все права защищены.*|"
    r"no part of this page may be reproduced .*|toute reproduction .*interdite\.?|prohibida la reproducción .*|vervielfältigung nur mit .*|перепечатка без .*|"
    r".{2,60} is not responsible for the content of external .*|.{2,60} n[’']est pas responsable .*|.{2,60} no (?:es|se hace) responsable .*|.{2,60} haftet nicht .*|.{2,60} не (?:несёт|несет|отвечает) .*|"
    r"registered (?:at|in) .{2,60} number .{2,20}|(?:enregistré|immatriculé|inscrit).{2,80}num[ée]ro .{2,20}|registrad[oa] en .{2,80}|(?:ein|re)getragen (?:in|zu) .{2,80}|зарегистрирован.{2,100}|"
    r"powered by .{2,40}|propulsé par .{2,40}|hecho con .{2,40}|betrieben mit .{2,40}|работает на .{2,40}"
)
_COOKIE = (
    r".*\bcookies?\b.{0,120}|.*файлы cookie.*|by staying on this page .*|by continuing .{0,80}(?:agree|accept).*|.{2,60} stores small files on your device .*|"
    r"en poursuivant, vous acceptez .*|al continuar.{0,20} acepta.*|si continúa.*acepta.*|mit der nutzung stimmen sie .*|продолжая, вы соглашаетесь .*"
)
_LETTER = (
    r"sign up for the .{2,60}|get the best of .{2,80}|support .{2,60} from .{2,40} a month|subscribe to .{2,60}|"
    r"recevez la lettre de .{2,60}|abonnez-vous .{2,60}|le meilleur de .{2,80}|soutenez .{2,60} dès .{2,40}|"
    r"reciba el boletín de .{2,60}|suscríbase .{2,60}|lo mejor de .{2,80}|apoye a? ?.{2,60} desde .{2,40}|"
    r"den morgenbrief von .{2,60}|das beste von .{2,80}|.{2,60} ab .{2,30} im monat unterstützen|newsletter .{2,60} abonnieren|"
    r"подпишитесь на .{2,80}|лучшее от .{2,80}|лучшее из .{2,80}|поддержите .{2,80}"
)
_AD = (
    r"advertisement|advertising|sponsored(?: content)?|promoted|ad|paid content|publicité|sponsorisé|contenu (?:partenaire|sponsorisé)|publicidad|patrocinado|anuncio|contenido patrocinado|"
    r"anzeige|werbung|gesponsert|реклама|на правах рекламы|партнёрский материал|спонсорский материал"
)
_SHARE = (
    r"send this page to .*|like it\? pass it on.*|share (?:this )?(?:story|article|page|post|it|on)\b.{0,60}|pass it on.*|"
    r"envoyer cette page .*|partager (?:cet|cette|l[’']).{0,60}|cela vous a plu.*|ça vous (?:a plu|plaît).*|faites passer.*|"
    r"envíe esta página .*|comparta (?:esta|este).{0,60}|¿le gustó\?.*|compártalo.*|"
    r"diesen (?:beitrag|artikel) teilen.*|diese seite (?:an .*|weiter).*|gefällt (?:es )?ihnen\?.*|weitersagen.*|"
    r"поделиться .*|отправить страницу .*|понравилось\?.*|расскажите друзьям.*"
)
_NOTE = (
    r"views given here are those of .*|prices were correct at the time .*|this text was produced with help .*|"
    r"les (?:avis|opinions|propos).{0,60}(?:auteur|engagent).*|les prix indiqués .*|texte préparé avec .*|"
    r"las opiniones .{0,80}(?:autor|firma).*|los precios pueden .*|texto elaborado con .*|"
    r"(?:die )?(?:hier )?(?:geäußerten |genannten )?(?:ansichten|meinungen).{0,80}(?:autor|verfass).*|preise können sich .*|dieser text entstand .*|"
    r"мнение автора .*|мнения.{0,60}автор.*|цены могли измениться.*|материал подготовлен .*"
)
_FAILED = (
    r"comments could not be loaded.*|impossible de charger .*|no se pudieron cargar .*|kommentare konnten nicht .*|не удалось загрузить .*"
)
_READ_TIME = r"(?:\d+ ?(?:-|–)?)?\d+ ?(?:min|minutes?)\.? (?:read|de lecture)|(?:reading time|lecture|temps de lecture|чтение|время чтения|lesezeit|lesedauer|tiempo de lectura) ?: ?\d+ .{1,12}|\d+ min(?:utos)? de lectura|\d+ min(?:uten)?\.? lesezeit|\d+ мин(?:ут[ыа]?)?\.? чтения"
_UPDATED = r"(?:last )?(?:updated|published|posted|mis à jour|publié|actualizado|publicado|aktualisiert|veröffentlicht|обновлено|опубликовано)(?: on| le| el| am)? ?:? ?\d.{0,40}"
_TAGS = r"(?:tags|topics|keywords|filed under|thèmes|mots-clés|étiquettes|temas|etiquetas|themen|schlagwörter|stichwörter|темы|теги|метки) ?: ?.{0,200}"
_BYLINE = re.compile(r"(?:by|par|por|von|de|автор:?|текст:?|text:?|author:?) (?:[^\W\d_][\w’'.-]*)(?: [^\W\d_][\w’'.-]*){0,4}(?: ?[|·,–—-] ?.{0,40})?", re.I)
_DATE_TAIL = re.compile(r"[|·] ?\d{1,2}\.? \w+\.? \d{4}$|[|·] ?\w+ \d{1,2},? \d{4}$")


def _full(pattern: str) -> re.Pattern:
    return re.compile(pattern)


_KINDS = [(k, _full(p)) for k, p in (
    ("comments", _COMMENT_HEAD), ("reply", _REPLY), ("related", _RELATED_HEAD), ("footer", _FOOTER), ("cookie", _COOKIE),
    ("letter", _LETTER), ("ad", _AD), ("share", _SHARE), ("note", _NOTE), ("failed", _FAILED), ("read_time", _READ_TIME), ("updated", _UPDATED), ("tags", _TAGS),
)]
#: Kinds that mark the whole box in which they stand.
_WHOLE_BOX = frozenset(("comments", "reply", "related", "footer", "cookie", "letter", "menu"))
_PIPES = re.compile(r"[^|·•/]{1,30}(?: ?[|·•/] ?[^|·•/]{1,30}){2,}")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”»“]?$")
_FLOW = frozenset("p li ul ol td th tr tbody thead tfoot table caption blockquote figure figcaption pre h1 h2 h3 h4 h5 h6 dl dt dd".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
_SECTIONS = frozenset("section article main body hgroup".split())
_CHROME_TAGS = frozenset("nav footer aside menu form dialog".split())


def chrome_kind(text: str, tag: str) -> str | None:
    """The kind of chrome that a line is by its words, or None."""
    n = len(text)
    if n > 220:
        return None
    low = text.casefold()
    for kind, pattern in _KINDS:
        if pattern.fullmatch(low):
            if kind == "related" and tag not in ("h2", "h3", "h4", "h5", "h6", "div", "p", "strong"):
                continue
            if kind == "cookie" and n < 12:
                continue
            return kind
    if tag not in ("h1", "h2", "td", "li") and n < 110 and not _SENTENCE_END.search(text) and _BYLINE.fullmatch(text) and (n < 60 or _DATE_TAIL.search(text)):
        return "byline"
    if tag in ("p", "div", "nav") and n < 140 and _PIPES.fullmatch(text) and not _SENTENCE_END.search(text):
        return "menu"
    return None


def _label(text: str) -> bool:
    """A short label such as the entries of a menu."""
    return len(text) <= 28 and text.count(" ") <= 3 and not _SENTENCE_END.search(text)


def article_lines(page: Page) -> list[int]:
    """Numbers of the lines that make up the page's own article."""
    lines, boxes = page.lines, page.boxes
    if not lines:
        return []
    kinds = [chrome_kind(t, tag) for t, _, tag, _ in lines]

    # menus: lists of at least two short labels and nothing else
    by_list: dict[int, list[int]] = {}
    for n, (_, box, tag, _) in enumerate(lines):
        b = box
        while b > 0 and boxes[b][1] not in ("ul", "ol", "menu"):
            b = boxes[b][0]
        if b > 0:
            by_list.setdefault(b, []).append(n)
    for own in by_list.values():
        if len(own) >= 2 and all(_label(lines[n][0]) and lines[n][2] == "li" for n in own):
            for n in own:
                kinds[n] = "menu"

    head = next((n for n, line in enumerate(lines) if line[2] == "h1"), None)
    if head is None:  # no headline: the box with the most prose stands in for it
        weight: dict[int, int] = {}
        marked: set[int] = set()
        for n, (text, box, tag, _) in enumerate(lines):
            b = box
            while b > 0 and boxes[b][1] in _FLOW and boxes[b][1] not in ("td", "th"):
                b = boxes[b][0]
            if kinds[n] in _WHOLE_BOX:
                marked.add(b)
            elif kinds[n] is None and tag != "li":
                weight[b] = weight.get(b, 0) + len(text)
        best = [b for b in weight if b not in marked]
        root = max(best, key=lambda b: (weight[b], -b)) if best else 0
        spine = set(page.path(root))
    else:
        spine = set(page.path(boxes[lines[head][1]][0])) if lines[head][1] > 0 else {0}
    if head is not None:
        # a headline in a page header does not make the header the article
        b = boxes[lines[head][1]][0]
        if b > 0 and boxes[b][1] == "header":
            spine.discard(b)

    dropped: set[int] = set()  # boxes dropped whole
    for n, kind in enumerate(kinds):
        if kind in _WHOLE_BOX:
            b = lines[n][1]
            while b > 0 and (boxes[b][1] in _FLOW or boxes[b][1] in ("nav", "menu")) and boxes[b][0] not in spine and boxes[b][0] > 0:
                b = boxes[b][0]
            if b > 0 and b not in spine and boxes[b][1] not in ("header",):
                dropped.add(b)

    keep: list[int] = []
    outside: list[int] = []  # lines in plain boxes beside the spine
    skip_list = False
    comments = False
    for n, (text, box, tag, _) in enumerate(lines):
        if n == head:
            skip_list = comments = False
            if kinds[n] is None or kinds[n] in ("related", "byline"):
                keep.append(n)
            continue
        kind = kinds[n]
        chain = []
        b = box
        gone = False
        while b > 0 and b not in spine:
            if b in dropped or boxes[b][1] in _CHROME_TAGS:
                gone = True
                # a heading alone was dropped: what it heads stands beside it
                if b in dropped and boxes[b][1] in _HEADS:
                    skip_list = skip_list or kind == "related"
                    comments = comments or kind == "comments"
                break
            chain.append(b)
            b = boxes[b][0]
        if gone:
            continue
        if kind is not None:
            if kind == "related":
                skip_list = True
            if kind == "comments":
                comments = True
            continue
        if comments:
            continue
        if skip_list:
            if tag == "li":
                continue
            skip_list = False
        # another cell of the layout table that holds the headline
        if head is not None and b > 0 and boxes[b][1] in ("tr", "table", "tbody", "thead", "tfoot", "ul", "ol", "dl"):
            continue
        if any(boxes[c][1] not in _FLOW and boxes[c][1] not in _SECTIONS for c in chain) and tag != "div":
            outside.append(n)
            continue
        if tag == "div" and len(chain) > 1 and any(boxes[c][1] not in _FLOW and boxes[c][1] not in _SECTIONS for c in chain[1:]):
            outside.append(n)
            continue
        keep.append(n)
    if outside:
        # plain boxes count as parts of the article when they stand within it, or
        # when they hold most of its prose (a headline apart from its text)
        first, last = (keep[0], keep[-1]) if keep else (0, len(lines))
        prose = sum(len(lines[n][0]) for n in keep if n != head)
        out = sum(len(lines[n][0]) for n in outside)
        keep += [n for n in outside if first < n < last or out > prose]
        keep.sort()
    return keep


def split_page(markup: str | None, source: str | None = None) -> tuple[Page, list[int]]:
    """Layout of ``markup`` (of ``source`` where markup shows nothing) and its article lines."""
    page = render(markup)
    if not page.lines and source:
        page = render(source)
    return page, article_lines(page)


def main_lines(markup: str | None, source: str | None = None) -> list[str]:
    """The main body's visible lines, in document order. Null or empty pages give none."""
    page, keep = split_page(markup, source)
    return [page.lines[n][0] for n in keep]


_FOUND = pa.schema([("page_id", pa.int64()), ("line_head", pa.string())])
_BODY = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("kept", pa.int64()), ("dropped", pa.int64())])


def main_line_heads(pages: DataFrame, head: int = 60) -> DataFrame:
    """(page_id, line_head): different heads of the main body's lines, one Arrow pass, no shuffle.

    Null ids give no row; pages whose html shows nothing are read from ``source_html``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads = [], []
            for i, markup, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if i is None:
                    continue
                own = dict.fromkeys(x[:head] for x in main_lines(markup, source))
                ids += [i] * len(own)
                heads += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heads, pa.string())], schema=_FOUND)

    return spread(pages.select(F.col("page_id").cast("bigint"), "html", "source_html")).mapInArrow(run, "page_id bigint, line_head string")


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, text, kept, dropped): the main body as laid-out text, and the number of lines on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, markup, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if i is None:
                    continue
                page, keep = split_page(markup, source)
                rows.append((i, render_text(page, set(keep)), len(keep), len(page.lines) - len(keep)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BODY)], schema=_BODY)

    return spread(pages.select(F.col("page_id").cast("bigint"), "html", "source_html")).mapInArrow(run, "page_id bigint, text string, kept bigint, dropped bigint")
