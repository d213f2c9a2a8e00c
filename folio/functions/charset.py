"""Charsets and kinds of responses: declared and sniffed charset, decoding, content kind, body limit, refusals."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import ascii_lower

__all__ = ["block_reason", "body_limit", "content_kind", "content_type_charset", "decode_body", "decode_one", "header", "is_readable", "looks_like_html", "sniff"]

WINDOW = 8192
BODY_LIMIT = 32 * 1024 * 1024
#: Labels whose meaning on the web is not the name's own (fixed values).
_WEB = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "l1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "x-cp1252": "windows-1252", "cp1252": "windows-1252", "x-cp1251": "windows-1251", "cp1251": "windows-1251",
        "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "x-sjis": "shift_jis", "sjis": "shift_jis", "ms_kanji": "shift_jis", "windows-31j": "shift_jis", "gb2312": "gbk", "chinese": "gbk", "x-gbk": "gbk", "ks_c_5601-1987": "euc-kr", "korean": "euc-kr",
        "iso-8859-9": "windows-1254", "latin5": "windows-1254", "koi8": "koi8-r", "koi": "koi8-r", "macintosh": "macintosh", "mac": "macintosh", "x-mac-roman": "macintosh", "utf-16": "utf-16le", "unicode": "utf-16le", "dos-874": "windows-874", "iso-8859-11": "windows-874", "tis-620": "windows-874"}
_CODEC = {"macintosh": "mac_roman", "windows-874": "cp874", "koi8-u": "koi8_u", "gbk": "gb18030", "ibm866": "cp866", "x-mac-cyrillic": "mac_cyrillic", "iso-8859-8-i": "iso8859-8"}


def for_label(label: str) -> str | None:
    """Name of a label's encoding in lower case, or None for what nobody knows."""
    s = label.strip(" \t\n\f\r").lower()
    if not re.fullmatch(r"[a-z0-9:_.+\-]+", s):
        return None
    name = _WEB.get(s, s)
    try:
        codecs.lookup(_CODEC.get(name, name))
    except (LookupError, ValueError):
        return None
    if not getattr(codecs.lookup(_CODEC.get(name, name)), "_is_text_encoding", True):
        return None
    return name


def declared(content_type: str) -> str | None:
    """Charset of a Content-Type value."""
    m = re.search(r"charset\s*(.*)", content_type.lower(), re.S)
    if not m or not m[1].startswith("="):
        return None
    value = re.split("[\"'; ]", m[1][1:].strip().lstrip("\"'"), maxsplit=1)[0]
    return value or None


def _attribute(tag: str, name: str) -> str | None:
    """Value of an attribute of a start tag; every occurrence of the name is tried."""
    for m in re.finditer(rf"(?<=[\s<]){re.escape(name)}|\A{re.escape(name)}", tag):
        rest = tag[m.end() :].lstrip()
        if not rest.startswith("="):
            continue
        rest = rest[1:].lstrip()
        value = rest[1:].split(rest[0])[0] if rest[:1] in ("'", '"') else re.split(r"[ \t\n/>]", rest)[0]
        if value.strip():
            return value.strip()
    return None


def _from_meta(window: bytes) -> str | None:
    text = window.decode("utf-8", "replace").lower()
    for m in re.finditer(r"<meta[^>]*", text):
        tag = m[0]
        value = _attribute(tag, "charset")
        if value and (name := for_label(value)):
            return name
        if "content-type" in (_attribute(tag, "http-equiv") or ""):
            content = _attribute(tag, "content")
            label = declared(content) if content else None
            if label and (name := for_label(label)):
                return name
    return None


def sniff(raw: bytes, content_type: str | None) -> str:
    """Encoding of a body: byte order mark, declaration of the response, declaration in the markup, then valid UTF-8 or windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16be"), (b"\xff\xfe", "utf-16le")):
        if raw.startswith(mark):
            return name
    label = declared(content_type or "")
    if label and (name := for_label(label)):
        return name
    window = raw[:WINDOW]
    if name := _from_meta(window):
        return name
    try:
        window.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "windows-1252"


def decode_one(raw: bytes, content_type: str | None) -> tuple[str, str]:
    name = sniff(raw, content_type)
    for mark in (b"\xef\xbb\xbf", b"\xfe\xff", b"\xff\xfe"):
        if raw.startswith(mark):
            raw = raw[len(mark) :]
            break
    if name == "windows-1252":  # undefined bytes stand for themselves
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw) if any(b in raw for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else raw.decode("cp1252"), name
    return raw.decode(_CODEC.get(name, name), "replace"), name


_DECODED = pa.struct([("text", pa.string()), ("charset", pa.string())])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def _decode(raw: pa.Array, content_type: pa.Array) -> pa.Array:
    rows = []
    for r, c in zip(raw.to_pylist(), content_type.to_pylist()):
        rows.append(None if r is None else dict(zip(("text", "charset"), decode_one(r, c))))
    return pa.array(rows, _DECODED)


def decode_body(raw: Column, content_type: Column) -> Column:
    """(text, charset) of a body; null bodies stay null."""
    return _decode(raw, content_type)


def header(headers: Column, name: str) -> Column:
    """Value of the first header of a name, whatever its case; null if there is none."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def content_type_charset(content_type: Column) -> Column:
    """Declared charset in lower case; null where there is none."""
    value = F.regexp_extract(ascii_lower(content_type), r"charset\s*=\s*['\"]*([^'\"; ]+)", 1)
    return F.when(value != "", value)


def looks_like_html(raw: Column) -> Column:
    """By the first 512 bytes."""
    head = ascii_lower(F.regexp_replace(F.decode(F.substring(raw, 1, 512), "iso-8859-1"), r"^[\s\x{85}\p{Z}]+", ""))
    return F.startswith(head, F.lit("<!doctype html")) | F.startswith(head, F.lit("<html")) | F.startswith(head, F.lit("<")) & F.contains(head, F.lit("<body"))


def content_kind(content_type: Column, raw: Column) -> Column:
    """html, json, xml, text, pdf, image, media or other; the mark of a PDF beats what is declared."""
    t = F.trim(F.substring_index(ascii_lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    return (
        F.when(F.coalesce(F.startswith(F.substring(raw, 1, 5), F.lit(b"%PDF-")), F.lit(False)) | (t == "application/pdf"), "pdf")
        .when(t.isin("text/html", "application/xhtml+xml"), "html")
        .when(t.isin("application/json", "text/json", "application/ld+json"), "json")
        .when(t.isin("application/xml", "text/xml", "application/rss+xml", "application/atom+xml"), "xml")
        .when(F.startswith(t, F.lit("text/")), "text")
        .when(F.startswith(t, F.lit("image/")), "image")
        .when(F.startswith(t, F.lit("audio/")) | F.startswith(t, F.lit("video/")), "media")
        .when((t == "") & F.coalesce(looks_like_html(raw), F.lit(False)), "html")
        .otherwise("other")
    )


def is_readable(kind: Column) -> Column:
    """Kinds that the page pipeline can read."""
    return kind.isin("html", "xml", "text")


def body_limit(raw: Column, limit: int = BODY_LIMIT) -> tuple[Column, Column]:
    """(the first ``limit`` bytes, whether more were there)."""
    return F.substring(raw, 1, limit), F.octet_length(raw) > limit


def block_reason(status: Column, body_bytes: Column) -> Column:
    """Why nothing was served, by status; null otherwise."""
    return (
        F.when(status == 403, "403: the server refused the request")
        .when(status == 429, "429: rate limited")
        .when(status == 439, "439: the site's bot check refused the request")
        .when((status == 503) & (body_bytes < 20_000), "503: likely a bot-check interstitial")
    )
