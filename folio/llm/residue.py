"""Template residue and error pages (problem 6).

One Arrow pass lays each page out, finds the place of its article and gives

* a direct verdict where a *placeholder rule* holds: an unfilled slot in any line
  outside code, a printed empty value as a line or field, or filler text (dummy-text
  words, repeated stand-ins); and where a larger page is for the most part known messages;
* for pages that show hardly any prose there, their *messages*: the lines with
  numbers, addresses and dates masked, hashed after normalisation.

Messages are grouped by exact hash across sources (partial aggregates, so a message
on a third of all pages costs no more than any other), each group is classified
once with the phrase rules, and a message that no rule knows still counts when it
recurs on many sources. The verdicts return to the pages by a salted hash join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.html.layout import Page, render
from folio.llm.mainbody import article_lines
from folio.operators.sites import host_of
from folio.session import hot_join, spread, stage

__all__ = ["classify_message", "find_residue", "mask_message", "page_evidence", "residue_messages", "residue_pages"]

#: Unfilled slots of common template languages, fixed patterns.
SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|<\?(?:php|=)[^?\n]*\?>|[$#]\{[^{}\n]*\}"
    r"|@@[\w.\- ]{1,60}@@|%%[\w.\- ]{1,60}%%|\[\[[\w.\- ]{1,60}\]\]|(?<![\w])__[A-Za-z][\w.]{0,60}?__(?!\w)|\[%[^%\n]*%\]|\{(?:[a-z]+[._])+[a-z]+\}|%\([\w.]+\)s"
)
#: Printed forms of an empty value, whole line or whole parts of one.
_EMPTY = re.compile(r"(?:undefined|null|none|nan|nil|\[object object\]|\(?no title\)?|\(?untitled\)?|n/a|\(null\)|\(none\)|—|-|–|\.\.\.|…)", re.I)
#: Those that no writer would set as a line or field of its own, in the case in which programs print them; dashes, "n/a" and "none" may be meant.
_PRINTED = re.compile(r"undefined|null|NaN|\[object Object\]|\(null\)|\(undefined\)")
_FIELDS = re.compile(r"\s*[·•|]\s*")
_VALUE = re.compile(r"[^:.!?]{1,40}: ?(.*)")
_EMPTY_WIDE = re.compile(r"\[object object\]|\(?no title\)?", re.I)
_EMPTY_SPLIT = re.compile(r"\s*[·|,/:;]\s*|\s+")
#: Words of the usual dummy text, fixed values.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_WORD = re.compile(r"[^\W\d_]+")

_FILLER = re.compile(
    r"(?:asdf|qwerty|xxx|foo|bar|test|blah|bla|tbd|tba|todo|lipsum)(?:[ .,]+(?:asdf|qwerty|xxx|foo|bar|test|blah|bla|tbd|tba|todo|lipsum))*[.!]?"
    r"|lorem ipsum.*|todo\b.{0,120}|tbd\b.{0,80}|(?:please )?(?:insert|enter|add|put|write|type|paste) (?:your |the |some |body |more )*(?:text|copy|content|title|headline|description|body copy)\b.{0,160}"
    r"|your (?:text|content|headline|title|copy) (?:goes )?here\b.{0,160}|(?:dummy|placeholder|sample|filler|example) (?:copy|text|content)\b.{0,160}|this is (?:an example|a sample|a test|a placeholder|placeholder|dummy) ?(?:page|text|post|article|content)?\b.{0,120}"
    r"|(?:this )?(?:page|block|section) (?:has no content yet|is empty|intentionally left blank).{0,80}|content (?:goes here|coming soon|to follow)\b.{0,60}|coming soon[.!…]*"
    r"|texte (?:à venir|de remplissage|provisoire|ici)\b.{0,120}|(?:saisissez|insérez|ajoutez) .{0,20}texte.{0,80}|contenu à venir.{0,60}|bloc provisoire.{0,40}"
    r"|texto de (?:relleno|ejemplo|prueba)\b.{0,120}|(?:inserte|escriba|añada) .{0,30}texto.{0,80}|contenido pendiente.{0,60}"
    r"|blindtext\b.{0,120}|platzhalter(?:text)?\b.{0,120}|(?:hier )?(?:steht|text) (?:hier|einfügen|folgt)\b.{0,80}|hier (?:steht|kommt|folgt) (?:ihr|der|ein)? ?text.{0,80}|text folgt.{0,40}"
    r"|здесь будет (?:текст|содержание|контент).{0,120}|(?:заполните|замените) этот (?:блок|текст).{0,60}|текст[- ](?:заглушка|рыба)\b.{0,80}|вставьте текст.{0,80}|пример текста.{0,60}"
    r"|(?:ここに|ダミー).{0,60}"
)
_SCRIPTS = re.compile(
    r"(?:loading|please wait)?.{0,60}\b(?:enable|activate|turn on|switch on|allow)\b.{0,20}\b(?:javascript|scripts?)\b.{0,100}|.{0,60}\b(?:javascript|scripts?) (?:is|are|must be|needs? to be|has to be)? ?(?:required|disabled|enabled|switched (?:on|off)|turned off|needed|off)\b.{0,80}"
    r"|.{0,60}\b(?:needs?|requires?) (?:javascript|scripts?)\b.{0,80}|your browser (?:does not|doesn[’']t|cannot|can[’']t) (?:run|support|execute).{0,20}(?:javascript|scripts?).{0,80}|.{0,40}check that (?:javascript|scripts?) .{0,40}|.{0,20}without (?:javascript|scripts?)\b.{0,60}|loading[.… ]*"
    r"|.{0,40}\b(?:activer|activez|autoriser) (?:javascript|les scripts)\b.{0,80}|.{0,40}javascript (?:est|doit être) (?:requis|désactivé|activé|nécessaire).{0,60}|.{0,30}nécessite javascript.{0,60}|chargement[.… ]*"
    r"|.{0,40}\b(?:active|activar|habilite|habilitar) (?:el )?javascript\b.{0,80}|.{0,40}(?:requiere|necesita) javascript.{0,60}|cargando[.… ]*"
    r"|.{0,40}\b(?:aktivieren|schalten) sie (?:bitte )?javascript\b.{0,80}|.{0,40}javascript (?:ist )?(?:erforderlich|deaktiviert|aktivieren|einschalten|muss).{0,60}|.{0,40}benötigt javascript.{0,60}|(?:wird|seite wird) geladen[.… ]*"
    r"|.{0,30}включите (?:javascript|скрипты|поддержку).{0,80}|.{0,40}(?:требуется|необходим|нужен|отключен|отключён) javascript.{0,60}|.{0,40}javascript (?:отключен|отключён|необходим|выключен).{0,60}|загрузка[.… ]*"
    r"|.{0,20}javascript ?を有効.{0,40}"
)
_ERROR = re.compile(
    r"(?:http )?(?:error|erreur|fehler|ошибка|error de|código|code)?[ :#]*#(?:[ .:\-–—]+.{0,80})?"
    r"|(?:error|erreur|fehler|ошибка|code|код|référence|referencia|reference|kennung|request id|ray(?: id)?|incident|код ошибки)[ :#]*#[#\w\-. ]*"
    r"|.{0,40}\b(?:access|permission) (?:is |was |has been )?(?:denied|forbidden|refused)\b.{0,60}|forbidden|unauthori[sz]ed|you do not have permission .{0,80}|(?:accès|accés) (?:refusé|interdit).{0,60}|acceso (?:denegado|prohibido).{0,60}|zugriff (?:verweigert|nicht erlaubt).{0,60}|доступ (?:запрещ[её]н|ограничен|закрыт).{0,60}|vous n[’']avez pas (?:l[’']autorisation|le droit).{0,80}|no tiene permiso.{0,80}|sie haben keine berechtigung.{0,80}|у вас нет (?:прав|доступа).{0,80}"
    r"|.{0,60}\b(?:page|story|article|address|site|content|file|document)\b.{0,40}\b(?:not found|cannot be found|could not be found|can[’']t be found|no longer (?:here|exists|available)|does not exist|doesn[’']t exist|is not here|is missing|not available|unavailable|has moved|has been (?:moved|removed|deleted))\b.{0,60}|not found|it may have moved.{0,80}"
    r"|(?:oops|sorry|whoops|uh-?oh|hoppla|vaya|ups|désolé|lo sentimos|leider|entschuldigung|извините|ой|упс)\b[!,.: ].{0,110}|oops!?|here is what our readers like instead\.?"
    r"|.{0,40}(?:page|adresse|article).{0,40}(?:introuvable|n[’']existe (?:pas|plus)|pas (?:été )?trouvée?)\b.{0,40}|.{0,40}no (?:encontramos|se encontró|se ha encontrado|existe).{0,60}|.{0,40}página no (?:encontrada|existe|disponible).{0,40}|.{0,40}(?:seite|artikel|datei).{0,30}nicht (?:gefunden|vorhanden|verfügbar).{0,40}|.{0,40}(?:страниц\w*|стать\w*|файл\w*) (?:не (?:найден\w*|существует|доступн\w*)|удален\w*|удалён\w*).{0,40}"
    r"|.{0,40}\b(?:something|anything) went wrong\b.{0,60}|an? (?:unexpected |internal |unknown )?(?:error|fault|problem|exception) (?:has )?occurred\b.{0,80}|une erreur .{0,60}(?:survenue|produite).{0,40}|.{0,20}algo (?:salió|ha salido|fue) mal.{0,40}|se (?:ha producido|produjo) un error.{0,60}|.{0,10}(?:es )?ist ein .{0,20}fehler aufgetreten.{0,60}|es ist ein fehler .{0,60}|etwas ist schief.{0,40}|что-то пошло не так.{0,40}|произошла .{0,20}ошибка.{0,60}"
    r"|.{0,40}\b(?:internal|server|application|system|fatal|runtime|database) (?:server )?(?:error|fault|exception)\b.{0,100}|.{0,20}internal (?:error|fault).{0,60}|fatal(?: error)?: .{0,140}|application error.{0,100}|see the console for details\.?"
    r"|.{0,40}database (?:connection|error).{0,80}|(?:error establishing|could not connect).{0,80}|sqlstate.{0,80}|[\w.]+(?:exception|error)(?: at|:| in)? .{0,140}|traceback .{0,80}|(?:warning|notice|parse error|uncaught \w+): .{0,140}|at [\w.$#<>]+\([\w.:# ]*\)"
    r"|.{0,40}\b(?:service|site|page|server|website)\b.{0,30}\b(?:temporarily )?(?:unavailable|offline|down)\b.{0,60}|temporarily unavailable.{0,40}|.{0,20}(?:we are |under |carrying out |scheduled )maintenance\b.{0,80}|come back (?:in a few minutes|later|soon).{0,20}|bad gateway|gateway time-?out|.{0,40}(?:temporairement|momentanément) indisponible.{0,40}|.{0,30}en maintenance.{0,40}|.{0,40}(?:temporalmente|momentáneamente) no disponible.{0,40}|.{0,30}en mantenimiento.{0,40}|.{0,40}(?:vorübergehend|derzeit|zurzeit) nicht (?:erreichbar|verfügbar).{0,40}|.{0,30}wartungsarbeiten.{0,40}|.{0,40}временно недоступ.{0,40}|.{0,30}(?:технические|ведутся).{0,20}работы.{0,40}"
    r"|too many requests.{0,60}|slow down and try again.{0,40}|rate limit.{0,60}|.{0,20}trop de requêtes.{0,40}|demasiadas (?:solicitudes|peticiones).{0,40}|zu viele anfragen.{0,40}|слишком много запросов.{0,40}"
    r"|.{0,30}checking (?:that you are|if you are|you are|your browser).{0,60}|(?:verify|confirm|prove) (?:that )?you are (?:a )?human.{0,60}|are you (?:a )?(?:human|robot).{0,40}|this takes a few seconds\..{0,60}|.{0,20}vérif\w+ que vous êtes .{0,20}humain.{0,40}|.{0,20}no (?:es|eres) un robot.{0,40}|.{0,20}(?:dass )?sie (?:ein mensch|kein roboter).{0,40}|.{0,20}что вы (?:не робот|человек).{0,40}|captcha.{0,40}"
    r"|.{0,40}not available in your (?:region|country|area).{0,40}|.{0,40}(?:pas|plus) disponible dans votre (?:région|pays).{0,40}|.{0,40}no (?:está )?disponible en su (?:región|país).{0,40}|.{0,40}in ihrer? (?:region|land) nicht verfügbar.{0,40}|.{0,40}недоступ\w* в вашем регионе.{0,40}"
    r"|(?:please )?(?:log|sign) in to (?:continue|read|view).{0,60}|session (?:has )?expired.{0,60}|your session .{0,60}|request (?:blocked|rejected|timed out).{0,60}|try again later\.?|veuillez réessayer.{0,40}|inténtelo (?:de nuevo|más tarde).{0,40}|bitte versuchen sie es .{0,40}|попробуйте (?:позже|ещ[её] раз).{0,40}"
)
#: Headlines that editors leave in place of a real one.
_STUB_HEAD = re.compile(r"(?:new|sample|example|test|untitled|blank) ?(?:page|post|article|document)?|title|headline|untitled|draft(?: #)?|lorem ipsum|page title|(?:nouvelle page|sans titre|titre|brouillon|neue seite|ohne titel|titel|entwurf|nueva página|sin título|título|borrador|новая страница|без названия|заголовок|черновик)(?: #)?")

_MASKS = (
    (re.compile(r"https?://\S+|www\.\S+|(?:/[\w.\-]+){2,}/?"), "@"),
    (re.compile(r"\b[\w.+\-]+@[\w\-]+\.[\w.\-]+"), "@"),
    (re.compile(r"\b\d{1,4}[./\-]\d{1,2}[./\-]\d{1,4}(?:[t ]\d{1,2}:\d{2}(?::\d{2})?)?"), "#"),
    (re.compile(r"\b(?=[0-9a-f\-]*\d)[0-9a-f]{4,}(?:-[0-9a-f]+)*\b"), "#"),
    (re.compile(r"\d+(?:[.,:]\d+)*"), "#"),
)


def mask_message(text: str) -> str:
    """Case folded, white space collapsed, addresses, dates and numbers masked."""
    s = " ".join(text.casefold().split())
    for pattern, mask in _MASKS:
        s = pattern.sub(mask, s)
    return s


def _lorem(text: str) -> bool:
    words = [w.lower() for w in _WORD.findall(text)]
    return len(words) >= 4 and sum(w in _LOREM for w in words) >= 0.7 * len(words)


def _repeats(text: str) -> bool:
    """One sentence over and over."""
    parts = [p.strip() for p in re.split(r"[.!?]+", text) if p.strip()]
    return len(parts) >= 3 and len(set(parts)) == 1


def _printed_empty(text: str) -> bool:
    """A whole line, a separated field or the value after a short name is the printed form of an empty value."""
    for part in _FIELDS.split(text.strip()):
        named = _VALUE.fullmatch(part)
        if _PRINTED.fullmatch(part) or named and _PRINTED.fullmatch(named[1]):
            return True
    return False


def classify_message(masked: str) -> str | None:
    """The kind of a masked message: ``slot``, ``empty``, ``filler``, ``scripts``, ``error``; None for other text."""
    if SLOT.search(masked):
        return "slot"
    parts = [p for p in _EMPTY_SPLIT.split(_EMPTY_WIDE.sub("null", masked)) if p]
    if _EMPTY.fullmatch(masked) or (parts and len(parts) <= 6 and all(_EMPTY.fullmatch(p) for p in parts)):
        return "empty"
    if _FILLER.fullmatch(masked) or _lorem(masked):
        return "filler"
    if len(masked) <= 220:
        if _SCRIPTS.fullmatch(masked):
            return "scripts"
        if _ERROR.fullmatch(masked):
            return "error"
    # a longer one is made of known sentences and frames of a trace
    parts = [p.strip() for p in re.split(r"(?<=[.!?…])\s+|\s+(?=at [\w.$#<>]+\()", masked) if p.strip()]
    if len(parts) > 1 and all(len(p) <= 220 for p in parts):
        first = None
        for p in parts:
            kind = _FILLER.fullmatch(p) and "filler" or _SCRIPTS.fullmatch(p) and "scripts" or _ERROR.fullmatch(p) and "error"
            if not kind:
                return None
            first = first or kind
        return first
    return None


#: A page with more prose than this beside its messages has an article of its own.
PROSE = 160


def page_evidence(page: Page, keep: list[int] | None = None) -> tuple[bool, list[str], bool]:
    """(direct verdict, masked messages, bare): ``bare`` when the article's place holds hardly more than messages can.

    ``keep``: the numbers of the article's lines, if they are known.
    """
    keep = article_lines(page) if keep is None else keep
    if not keep:  # nothing but chrome: no block stands where an article should be
        return False, [], False
    # code is quoted, not shown in place of text: blocks of it are left out, inline pieces removed
    text = [_without_code(page, n) for n in keep if page.lines[n][2] not in ("pre", "code", "listing")]
    prose = filler = 0
    for t in text:
        if SLOT.search(t) or _printed_empty(t):
            return True, [], False
        if _lorem(t):
            filler += len(t)
        else:
            prose += len(t)
    if filler and filler >= prose:
        return True, [], False
    if not text:
        return False, [], False
    if len(text) > 8 or any(len(t) > 300 and not _repeats(t) for t in text):
        # more than messages usually take: known messages must be most of it
        return _mostly_messages(text), [], False
    return False, [mask_message(t) for t in text], True


def _mostly_messages(text: list[str]) -> bool:
    left = sum(map(len, text)) / 2
    for t in sorted(text, key=len, reverse=True):  # an article is known by its longest lines
        if classify_message(mask_message(t)) is None:
            left -= len(t)
            if left < 0:
                return False
    return True


def _without_code(page: Page, n: int) -> str:
    text = page.lines[n][0]
    for code in page.codes.get(n, ()):
        text = text.replace(code, " ")
    return text


_SCHEMA = [("page_id", pa.int64()), ("source", pa.string()), ("direct", pa.bool_()), ("messages", pa.list_(pa.struct([("hash", pa.int64()), ("text", pa.string())])))]
_SQL = "page_id bigint, source string, direct boolean, messages array<struct<hash: bigint, text: string>>"


def evidence_table(pages: DataFrame, beside: tuple[str, list[pa.DataType], Callable] | None = None) -> DataFrame:
    """(page_id, source, direct, messages) of the pages with any evidence.

    ``beside``: (columns in SQL, their types, function): further columns from the same layout of each page, so that a page is laid out
    once for all that is asked of it. The function takes the article's lines (of ``source_html`` where html shows none) and returns the
    values, or None where there are none; pages with values give a row too.
    """
    sql, types, values = beside or ("", [], None)
    names = [x.split()[0] for x in sql.split(",") if x.strip()]
    schema = pa.schema([*_SCHEMA, *zip(names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, source, *markup in zip(*(c.to_pylist() for c in batch.columns)):
                if i is None:
                    continue
                page = render(markup[0])
                keep = article_lines(page)
                direct, messages, _ = page_evidence(page, keep) if page.lines else (False, [], False)
                own = None
                if values:
                    if not page.lines and markup[1]:
                        page = render(markup[1])
                        keep = article_lines(page)
                    own = values([page.lines[n][0] for n in keep])
                if direct or messages or own is not None:
                    rows.append((i, source, direct, [{"hash": _hash(m), "text": m} for m in messages], *(own or [None] * len(names))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    picked = pages.select(F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("source"), "html", *(["source_html"] if values else []))
    return spread(picked).mapInArrow(run, _SQL + (", " + sql if sql else ""))


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def residue_messages(evidence: DataFrame, min_sources: int = 5) -> DataFrame:
    """(hash, text, kind, pages, sources, recurring): every masked message, classified once."""
    lines = evidence.where("not direct").select("page_id", "source", F.explode("messages").alias("m")).select("page_id", "source", "m.hash", "m.text")
    by_source = lines.groupBy("hash", "source").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    groups = by_source.groupBy("hash").agg(F.min("text").alias("text"), F.sum("n").alias("pages"), F.count("source").alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [classify_message(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.string())], [*batch.schema.names, "kind"])

    out = groups.mapInArrow(run, "hash bigint, text string, pages bigint, sources bigint, kind string")
    # headings recur by themselves; an unknown message must look like one: short, and on many sources
    return out.withColumn("recurring", (F.col("sources") >= min_sources) & (F.length("text") <= 120))


def residue_pages(evidence: DataFrame, min_sources: int = 5) -> DataFrame:
    """(page_id) of the pages that show residue, from their staged evidence. A message on a large part of all pages is joined in salted parts."""
    messages = residue_messages(evidence, min_sources).where("kind is not null or recurring").select("hash", "kind", "recurring")
    lines = evidence.where("not direct").select("page_id", F.explode("messages").alias("m"), F.size("messages").alias("n_lines")).select("page_id", "n_lines", "m.hash", F.length("m.text").alias("n"))
    joined = hot_join(lines, messages, ["hash"], "page_id", how="left")
    # known text, all lines recurring, and what is left beside them
    judged = joined.groupBy("page_id").agg(
        F.max(F.col("kind").isNotNull()).alias("known"),
        F.min(F.coalesce("recurring", F.lit(False))).alias("all_recur"),
        F.sum(F.when(F.col("kind").isNull() & ~F.coalesce("recurring", F.lit(False)), F.col("n")).otherwise(0)).alias("rest"),
        F.sum("n").alias("size"),
        F.max("n_lines").alias("n_lines"),
    )
    # an unknown message counts only where it stands alone: copies of a short article recur too
    alone = F.col("all_recur") & (F.col("n_lines") <= 2) & (F.col("size") <= PROSE)
    short = judged.where((F.col("known") & (F.col("rest") <= PROSE)) | alone).select("page_id")
    return evidence.where("direct").select("page_id").union(short).distinct()


def find_residue(pages: DataFrame, min_sources: int = 5) -> DataFrame:
    """(page_id) of the pages that show residue, filler, an error or a call for scripts instead of an article.

    Pages without html or without a visible line are never cases. Rows that share a page_id count once.
    """
    return residue_pages(stage(evidence_table(pages), "evidence"), min_sources)
