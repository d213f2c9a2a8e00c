"""Garbled text from wrong character encodings (problem 4).

A text is searched as a graph: its nodes are texts, its edges undo one wrong step
(*encode* with the charset it was read in, *decode* with another one, *unescape*
entities and escapes). Best-first search with visited-state hashing follows the
cheapest text; the cost is the number of implausible characters: controls, marks,
symbols within words, capitals within words, scripts mixed in a word, lead and
continuation bytes shown as letters. Texts whose marks cannot be undone
(replacement characters, question marks in place of letters) are found by the
marks themselves.

A cheap screen leaves out most bodies before any search: character classes looked up for all characters at once, and
one regular expression over what they leave. The rest is searched passage by passage, so a long sound text with
one garbled passage is found, and only that passage changes: a sound one keeps its entities and escapes. The response's
declared charset gives the first edge that is tried.

The search is bounded by ``MAX_DEPTH`` steps and ``MAX_NODES`` expanded texts a passage. A text beyond them (garbled more than three
times over) is not restored but still found, by its marks and its cost. A text that is as good as sound ends the search.
"""

from __future__ import annotations

import codecs
import heapq
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import spread

__all__ = ["cost", "find_garbled", "passages", "repair", "restore_text", "unescape_literal"]

#: Charsets that the search knows, fixed values: those a text was wrongly read in, and those it was written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "iso8859-2", "cp1250", "koi8-r", "cp866", "iso8859-5", "iso8859-15")
WRITTEN_IN = ("utf-8", "cp1252", "mac_roman", "cp1251", "iso8859-2", "cp1250", "koi8-r", "cp866", "shift_jis", "euc_jp", "cp437", "cp850", "iso8859-5")
MAX_DEPTH = 3
MAX_NODES = 60

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŸŹŻŽА-ЯЁЂЃЄЅІЇЈЉЊЋЌЎЏҐΑ-Ω"
_LOW = "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžа-яёђѓєѕіїјљњћќўџґα-ω"
_LETTER = r"[^\W\d_]"
#: Characters that the bytes 80-BF show as in cp1252 and latin-1, and in cp1251.
_CONT = "\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_CONT_CYR = "ЂЃ‚ѓ„…†‡€‰Љ‹ЊЌЋЏђ‘’“”•–—™љ›њќћџ\u00a0ЎўЈ¤Ґ¦§Ё©Є«¬\u00ad®Ї°±Ііґµ¶·№є»јЅѕї\u0098"
_SYMBOL = "¡-©¬-´¶¸¹¼-¿×÷ˆˇ˘˙˚˛˜˝†‡•‰‹›€™‚„ƒ√∫≈∆∂∑∏π≠≤≥∞◊Ω⁄ﬁﬂ⌐₧\u2500-\u25ff«»ªº”“"

_HARD = re.compile("[\u0080-\u0084\u0086-\u009f\ue000-\uf8ff\ufffe\uffff]")
_MARK = re.compile("\ufffd")
_INSIDE = re.compile(rf"(?<={_LETTER})[{_SYMBOL}](?={_LETTER})")
_EDGE = re.compile(rf"(?<![\w{_SYMBOL}])[±³¶¸¹¼¦§¯ˆ˙√├┬][{_LOW}]|(?<=[{_LOW}])[±³¶¸¹¼√├┬‰ˆ˙∫](?![\w])")
_CASE = re.compile(rf"[{_LOW}](?=[{_UP}])")
_ASCII_CASE = re.compile(r"[a-z](?=[A-Z])")
_SCRIPTS = re.compile("[A-Za-zÀ-ɏ](?=[Ͱ-ϿЀ-ӿ\u0250-\u036f])|[Ͱ-ϿЀ-ӿ\u0250-\u036f](?=[A-Za-zÀ-ɏ])")
_PAIR = re.compile(rf"[ÂÃÄÅÆÎÏÐÑØÙĂĹĂ×][{_CONT}ĄĽĘŹŁŞŤłľşťľźčęążĽ](?![^\s{_CONT}]*[a-z]”)|[à-ï][{_CONT}]{{2}}|[РСГВД][{_CONT_CYR}]|в[Ђ„‚][{_CONT_CYR}]?|[√¬┬├][^\s\w]|[√├┬‚][ÄÅÂÊÁËÈÍÎÏÌÓÔÒÚÛÙ®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªº]|[\u2500-\u257f][^\s]")
_ODD_CYR = re.compile("[ЂЃЅЈЉЊЋЌЎЏђѓѕјљњћќўџҐґЄєЇїІі]")
_RUN = re.compile("[À-ÖØ-öø-ÿ]{4,}")
_RARE = re.compile("[ƀ-ʯ\u0300-\u036fԀ-֏\u0700-\u08ff\u1400-\u167f\U00010000-\U0001f000]")
_CJK = re.compile("[A-Za-zÀ-ɏЀ-ӿ](?=[぀-ヿ㐀-鿿가-힣])|[぀-ヿ㐀-鿿가-힣](?=[A-Za-zÀ-ɏЀ-ӿ])")
_HALF = re.compile("[\uff61-\uff9f]")
_NON_ASCII = re.compile("[^\x00-\x7f]")

#: Question marks where letters stood.
_LOST = re.compile(r"(?<![/=&?.\w-])[^\W\d_]+\?[a-zß-öø-ÿą-žа-яё]+(?![\w/]*=)|(?<![\w/=&?])\?[a-zß-öø-ÿą-ž]{2,}(?![\w/]*=)")
_LOST_RUN = re.compile(r"(?<![^\s\"'>(])\?{3,}(?![^\s\"'<).,;:])")

_SCREEN = re.compile("|".join(p.pattern for p in (_HARD, _MARK, _INSIDE, _EDGE, _SCRIPTS, _PAIR, _RUN, _RARE, _HALF, _LOST, _LOST_RUN)) + rf"|[ß-öø-ÿāăąćčęěğłńňőœřśşšťůűźżžа-яё](?=[{_UP}])|[{_LOW}](?=[À-ÖØ-ÞА-ЯЁĂĄĆČĘĹŁŃŘŚŠŹŻŽ])")

#: Classes of neighbouring characters that the screen's expression needs: (first, second) and (first, second, third).
_PAIRS = (
    (rf"[{_LOW}]", rf"(?=[^\x00-\x7f])[{_UP}]"), (rf"(?=[^\x00-\x7f])[{_LOW}]", rf"[{_UP}]"), ("[A-Za-zÀ-ɏ]", "[Ͱ-ϿЀ-ӿ\u0250-\u036f]"), ("[Ͱ-ϿЀ-ӿ\u0250-\u036f]", "[A-Za-zÀ-ɏ]"),
    ("[±³¶¸¹¼¦§¯ˆ˙√├┬]", rf"[{_LOW}]"), (rf"[{_LOW}]", "[±³¶¸¹¼√├┬‰ˆ˙∫]"), ("[ÂÃÄÅÆÎÏÐÑØÙĂĹ×]", rf"[{_CONT}ĄĽĘŹŁŞŤłľşťľźčęążĽ]"), ("[РСГВД]", rf"[{_CONT_CYR}]"), ("в", "[Ђ„‚]"), ("[√¬┬├‚\u2500-\u257f]", r"\S"),
)
_TRIPLES = ((_LETTER, rf"[{_SYMBOL}]", _LETTER), ("[à-ï]", rf"[{_CONT}]", rf"[{_CONT}]"))
_PAIR_BITS, _TRIPLE_BITS, _RUN_BIT, _ALONE_BIT = np.uint32(0xFFFF), np.uint32(0xF0000), np.uint32(1 << 20), np.uint32(1 << 21)


def _tables() -> list[np.ndarray]:
    """Bits of the classes that each character of the basic plane is in, as the first, second and third of neighbours."""
    out = [np.zeros(0x10000, dtype=np.uint32) for _ in range(3)]
    text = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x10000)))

    def mark(table: np.ndarray, pattern: str, bit) -> None:
        table[[m.start() for m in re.finditer(pattern, text)]] |= np.uint32(bit)

    for group, first in ((_PAIRS, 0), (_TRIPLES, 16)):
        for k, patterns in enumerate(group):
            for table, pattern in zip(out, patterns):
                mark(table, pattern, 1 << (first + k))
    for table in out[:2]:
        mark(table, "[À-ÖØ-öø-ÿ]", _RUN_BIT)
    for pattern in (_HARD, _MARK, _RARE, _HALF):
        mark(out[0], pattern.pattern, _ALONE_BIT)
    return out


_FIRST, _SECOND, _THIRD = _tables()
_ASKED = re.compile(r"\?(?:[a-zß-öø-ÿą-žа-яё]|\?\?)")


def _suspicious(text: str) -> bool:
    """Whether the screen finds anything; most texts are told by the classes of neighbouring characters alone."""
    if not _ASKED.search(text):
        if text.isascii():
            return False
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if int(code.max()) <= 0xFFFF:  # characters beyond the basic plane are rare: the expression decides
            first = _FIRST[code]
            pair = first[:-1] & _SECOND[code[1:]]
            hits = np.bitwise_or.reduce(pair & _PAIR_BITS, initial=0) | np.bitwise_or.reduce(first & _ALONE_BIT, initial=0)
            if not hits and not (pair[:-1] & _THIRD[code[2:]] & _TRIPLE_BITS).any() and not (pair[:-2] & pair[2:] & _RUN_BIT).any():
                return False
    return _SCREEN.search(text) is not None


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|&#(\d{1,7});|&#[xX]([0-9a-fA-F]{1,6});|&([a-zA-Z]{2,8});")


def unescape_literal(text: str) -> str:
    """Entities and ``\\uXXXX`` escapes as the characters they name (numbers 128-159 as controls)."""
    if "&" not in text and "\\u" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[4]:
            s = _html.unescape(m[0])
            return m[0] if s in "<>&\"'" else s
        n = int(m[1], 16) if m[1] else int(m[2]) if m[2] else int(m[3], 16)
        return m[0] if n > 0x10FFFF or n in (0x22, 0x26, 0x3C, 0x3E, 0x27, 0x5C) or 0xD800 <= n < 0xE000 else chr(n)

    return _ESCAPE.sub(one, text)


_SPLIT = re.compile(r"<[^<>]{0,300}>|[\r\n]+|(?<!\\)\"")


def passages(text: str) -> list[str]:
    """Pieces between tags, line ends and quotation marks of JSON."""
    return [text[a:b] for a, b in _spans(text)]


def _spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if a < b and not text[a:b].isspace()]


def cost(text: str) -> float:
    """Implausibility of a text; 0 for plain sound text but for a little for each character beyond ASCII."""
    if text.isascii():
        return 0.0
    return (
        4.0 * len(_HARD.findall(text))
        + 4.0 * len(_MARK.findall(text))
        + 2.5 * len(_INSIDE.findall(text))
        + 2.0 * len(_EDGE.findall(text))
        + 2.0 * (len(_CASE.findall(text)) - len(_ASCII_CASE.findall(text)))
        + 2.5 * len(_SCRIPTS.findall(text))
        + 2.5 * len(_PAIR.findall(text))
        + 0.5 * len(_ODD_CYR.findall(text))
        + 0.7 * sum(len(m) - 3 for m in _RUN.findall(text))
        + 1.5 * len(_RARE.findall(text))
        + 2.5 * len(_CJK.findall(text))
        + 1.0 * len(_HALF.findall(text))
        + 0.02 * len(_NON_ASCII.findall(text))
    )


def _sloppy(error: UnicodeError):
    """Controls 80-9F stand for their own bytes where a charset leaves those undefined."""
    if isinstance(error, UnicodeEncodeError):
        piece = error.object[error.start : error.end]
        if all(0x80 <= ord(c) <= 0x9F for c in piece):
            return bytes(ord(c) for c in piece), error.end
    raise error


codecs.register_error("folio-controls", _sloppy)


def _apply(path: list[str], text: str) -> str | None:
    """The steps of a path, as far as each is possible."""
    try:
        for name in path:
            if name == "unescape":
                text = unescape_literal(text)
            else:
                read, written = name.split(">")
                text = text.encode(read, "folio-controls").decode(written)
    except UnicodeError:
        return None
    return text


def _steps(text: str) -> Iterator[tuple[str, str]]:
    plain = unescape_literal(text)
    if plain != text:
        yield "unescape", plain
    for read in READ_AS:
        try:
            raw = text.encode(read, "folio-controls")
        except UnicodeError:
            continue
        for written in WRITTEN_IN:
            if written == read:
                continue
            try:
                yield f"{read}>{written}", raw.decode(written)
            except UnicodeError:
                continue


def repair(text: str, hint: list[str] | None = None, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> tuple[str, float, float, list[str]]:
    """(cheapest reachable text, its cost, the text's own cost, steps) by best-first search.

    ``hint``: steps that restored a passage of the same body; taken at once if they make this one sound.
    The search ends at the first text that is as good as sound.
    """
    own = cost(text)
    if hint:
        first = _apply(hint, text)
        if first is not None and first != text and (c := cost(first)) <= 0.06 * own:
            return first, c, own, hint
    best, best_cost, best_path = text, own, []
    seen = {hash(text)}
    queue: list[tuple[float, int, int, str, list[str]]] = [(own, 0, 0, text, [])]
    order = nodes = 0
    while queue and nodes < max_nodes:
        at, depth, _, node, path = heapq.heappop(queue)
        nodes += 1
        if at < best_cost - 1e-9:
            best, best_cost, best_path = node, at, path
        if depth == max_depth or at < 0.05 * own:
            if at < 0.05 * own and depth:
                break
            continue
        for name, text_to in _steps(node):
            h = hash(text_to)
            if h in seen:
                continue
            seen.add(h)
            # a step has its price, so that two ways to the same plausibility prefer the shorter
            c = cost(text_to) + 0.3
            if c - 0.3 <= 0.04 * own:
                return text_to, c, own, [*path, name]
            if c < own * 1.5 + 2:
                order += 1
                heapq.heappush(queue, (c, depth + 1, order, text_to, [*path, name]))
    return best, best_cost, own, best_path


_QUOTED = re.compile(rf"(?<=\s)[\ufffd{_UP}{_CONT}√├┬┤│]{{1,4}}(?=[\s.,;:!?])")


def _lossy(text: str, cut: bool) -> bool:
    """Marks or question marks where letters stood, whatever could be restored."""
    marks = list(_MARK.finditer(text))
    if marks:
        loose = 0
        for m in marks:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if cut and not text[m.end() :].strip("\ufffd \r\n\t"):
                continue  # the cut end of a truncated body
            if (before == "" or before.isspace()) and (after == "" or after.isspace()):
                loose += 1  # stands alone: may be named rather than shown
                continue
            return True
        if loose > 2:
            return True
    return len(_LOST.findall(text)) >= 2 or len(_LOST_RUN.findall(text)) >= 2


def judge(text: str, cut: bool = False, hints: list[list[str]] | None = None) -> tuple[bool, str]:
    """(garbled, restored): whether a passage, already unescaped, was decoded wrongly, and its text as far as it can be restored."""
    if not _suspicious(text):
        return False, text
    lossy = _lossy(text, cut)
    bare = _QUOTED.sub(" ", text)  # signs named in sound text stand alone
    own = cost(bare) - 0.02 * len(_NON_ASCII.findall(bare))
    if cut:
        own -= 4.0 * bare.count("\ufffd")
    if own < 2.0:
        return lossy, text
    fixed, after, before, path = repair(text, hints[-1] if hints else None)
    if path and after <= 0.45 * before and before - after >= 1.9:
        if hints is not None:
            hints.append(path)
        return True, fixed
    if lossy:
        return True, text
    # nothing reachable is sound: controls and many implausible characters are evidence by themselves
    if _HARD.search(bare) or own >= 12.0:
        return True, text
    return False, text


#: Names of charsets as responses give them, by the codec that the search knows.
_CODECS = {codecs.lookup(name).name: name for name in READ_AS}


def _first_edge(charset: str | None) -> list[list[str]]:
    """The step that undoes a decoding with the declared charset, where that is one of those that garble."""
    try:
        name = _CODECS.get(codecs.lookup(charset).name) if charset else None
    except (LookupError, ValueError):
        name = None
    return [[f"{name}>utf-8"]] if name else []


def judge_body(body: str | None, truncated: bool | None = False, charset: str | None = None) -> tuple[bool, str | None, int]:
    """(garbled, restored body, passages changed). Null and empty bodies are sound.

    Only garbled passages change; all else, entities and escapes too, stays as it was.
    """
    if not body:
        return False, body, 0
    # truncation leaves half an escape or a mark at the end
    plain = unescape_literal(body)
    if not _suspicious(plain):
        return False, body, 0
    found, changed, out, at = False, 0, [], 0
    asked = [0, 0]
    spans = _spans(body)
    hints = _first_edge(charset)
    for n, (a, b) in enumerate(spans):
        part = unescape_literal(body[a:b])
        hit, fixed = judge(part, bool(truncated) and n == len(spans) - 1, hints)
        if hit:
            found = True
            if fixed != part:
                changed += 1
                out += [body[at:a], fixed]
                at = b
        elif not found and "?" in part:
            asked = [asked[0] + len(_LOST.findall(part)), asked[1] + len(_LOST_RUN.findall(part))]
    # letters lost one by one in many passages
    found = found or max(asked) >= 2
    return found, "".join([*out, body[at:]]), changed


_OUT = pa.schema([("response_id", pa.int64()), ("body", pa.string()), ("passages", pa.int64())])


def restore_text(responses: DataFrame) -> DataFrame:
    """(response_id, body, passages): the garbled responses with their text restored where it can be.

    ``passages``: how many passages were changed; 0 where the loss cannot be undone. Null ids give no row;
    a response delivered twice gives one row for each copy. One Arrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, body, cut, charset in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if i is None:
                    continue
                found, text, changed = judge_body(body, cut, charset)
                if found:
                    rows.append((i, text, changed))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    charset = F.col("charset") if "charset" in responses.columns else F.lit(None).cast("string")
    return spread(responses.select(F.col("response_id").cast("bigint"), "body", "truncated", charset.alias("charset"))).mapInArrow(run, "response_id bigint, body string, passages bigint")


def find_garbled(responses: DataFrame) -> DataFrame:
    """(response_id), distinct: responses with a garbled passage."""
    return restore_text(responses).select("response_id").distinct()
