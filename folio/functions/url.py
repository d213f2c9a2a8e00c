"""Addresses after the public WHATWG URL standard: parse, join and parts of http-like addresses."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["Url", "join", "parse", "url_join", "url_parts"]

#: Default ports of the special schemes (fixed values).
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)", re.S)
_DROP = str.maketrans("", "", "\t\n\r")
_C0_SPACE = "".join(map(chr, range(0x21)))
_HOST_BAD = set("\0\t\n\r #/:<>?@[\\]^|%\x7f") | set(map(chr, range(0x20)))
_SETS = {"fragment": ' "<>`', "query": " \"#<>'", "path": ' "#<>?^`{}', "user": " \"#<>?^`{}/:;=@[\\]|", "opaque": ""}


@dataclass
class Url:
    scheme: str
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    user: str = ""
    password: str = ""
    opaque: bool = False

    def __str__(self) -> str:
        out = f"{self.scheme}:"
        if self.host is not None:
            who = self.user + (f":{self.password}" if self.password else "")
            out += "//" + (f"{who}@" if who else "") + self.host + ("" if self.port is None else f":{self.port}")
        out += self.path
        return out + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def _encode(text: str, which: str) -> str:
    stop = _SETS[which]
    if text.isascii() and text.isprintable() and not any(c in text for c in stop):
        return text
    return "".join(c if 0x20 <= ord(c) < 0x7F and c not in stop else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None | bool:
    """The address in dots, False for one out of range, None for what is no number."""
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    last = parts[-1]
    if not (last.isascii() and last.isdigit() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last)):
        return None
    if len(parts) > 4:
        return False
    numbers = []
    for p in parts:
        m = re.fullmatch(r"0[xX]([0-9a-fA-F]*)|(0[0-7]*)|([1-9][0-9]*)", p)
        if not m:
            return False
        numbers.append(int(m[1] or "0", 16) if m[1] is not None else int(m[2], 8) if m[2] else int(m[3]))
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return False
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        if not text.endswith("]"):
            return None
        try:
            return f"[{IPv6Address(text[1:-1]).compressed}]"
        except AddressValueError:
            return None
    if not special:
        return None if any(c in _HOST_BAD and c != "%" for c in text) else _encode(text, "opaque")
    if "%" in text:
        from urllib.parse import unquote

        text = unquote(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.replace("。", ".").replace("­", "")).lower()
        try:
            text = ".".join(p if p.isascii() else "xn--" + unicodedata.normalize("NFC", p).encode("punycode").decode() for p in text.split("."))
        except UnicodeError:
            return None
    text = text.lower()
    if not text or any(c in _HOST_BAD for c in text):
        return None
    v4 = _ipv4(text)
    return None if v4 is False else v4 or text


def _dots(segments: list[str], raw: str, special: bool) -> list[str]:
    """Path segments of ``raw`` after those given, dot segments resolved."""
    out = list(segments)
    parts = re.split(r"[/\\]" if special else "/", raw)
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(p, "path"))
    return out


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """A Url, or None where the standard fails."""
    if text is None:
        return None
    text = text.strip(_C0_SPACE).translate(_DROP)
    text, mark, fragment = text.partition("#")
    fragment = _encode(fragment, "fragment") if mark else None
    m = _SCHEME.fullmatch(text)
    if m:
        scheme, rest = m[1].lower(), m[2]
        special = scheme in PORTS
        if special and base is not None and base.scheme == scheme and not re.match(r"[/\\]", rest):
            return _relative(rest, base, fragment)
        if special and scheme != "file":
            return _authority(scheme, rest.lstrip("/\\"), fragment)
        if scheme == "file" or rest.startswith("//"):
            return _authority(scheme, rest[2:] if rest.startswith("//") else rest, fragment, file=scheme == "file")
        if rest.startswith("/"):
            path, q, query = rest.partition("?")
            return Url(scheme, path="/" + "/".join(_dots([], path[1:], False)), query=_encode(query, "query") if q else None, fragment=fragment)
        path, q, query = rest.partition("?")
        return Url(scheme, path=_encode(path, "opaque"), query=_encode(query, "query") if q else None, fragment=fragment, opaque=True)
    if base is None:
        return None
    if base.opaque:
        if text:
            return None
        return Url(**{**base.__dict__, "fragment": fragment})
    return _relative(text, base, fragment)


def _relative(text: str, base: Url, fragment: str | None) -> Url | None:
    special = base.scheme in PORTS
    slashed = text.replace("\\", "/") if special else text
    if slashed.startswith("//"):
        return _authority(base.scheme, text[2:].lstrip("/\\") if special else text[2:], fragment)
    path, q, query = text.partition("?")
    out = Url(base.scheme, base.host, base.port, base.path, base.query, fragment, base.user, base.password)
    if path:
        first = path[0] == "/" or special and path[0] == "\\"
        old = base.path[1:].split("/")[:-1] if base.path and not first else []
        out.path = "/" + "/".join(_dots(old, path[1:] if first else path, special))
        out.query = None
    if q:
        out.query = _encode(query, "query")
    return out


def _authority(scheme: str, rest: str, fragment: str | None, file: bool = False) -> Url | None:
    special = scheme in PORTS
    m = re.match(r"[^/\\?]*" if special else r"[^/?]*", rest)
    auth, tail = m[0], rest[m.end() :]
    user = password = ""
    if "@" in auth and not file:
        who, _, auth = auth.rpartition("@")
        user, _, password = who.partition(":")
        user, password = _encode(user, "user"), _encode(password, "user")
    port = None
    pm = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", auth, re.S)
    if pm is None:
        return None
    if pm[2]:
        if not (pm[2].isascii() and pm[2].isdigit()) or int(pm[2]) > 65535:
            return None
        port = int(pm[2])
    host = _host(pm[1], special) if pm[1] else "" if file or not special else None
    if host is None:
        return None
    path, q, query = tail.partition("?")
    segments = _dots([], path[1:], special) if path else ([""] if special else [])
    return Url(scheme, host, None if port == PORTS.get(scheme) else port, "/" + "/".join(segments) if segments else "", _encode(query, "query") if q else None, fragment, user, password)


def join(base: str | Url | None, text: str | None) -> str | None:
    """``text`` resolved against ``base``; None where it cannot be."""
    if text is None:
        return None
    if isinstance(base, str):
        base = parse(base)
    out = parse(text, base)
    return None if out is None else str(out)


@F.arrow_udf(T.StringType())
def _join(base: pa.Array, text: pa.Array) -> pa.Array:
    bases: dict = {}
    out = []
    for b, t in zip(base.to_pylist(), text.to_pylist()):
        if b not in bases:
            if len(bases) > 10_000:
                bases.clear()
            bases[b] = parse(b)
        out.append(join(bases[b], t))
    return pa.array(out, pa.string())


_PARTS = pa.struct([("scheme", pa.string()), ("host", pa.string()), ("port", pa.int32()), ("path", pa.string()), ("query", pa.string()), ("fragment", pa.string()), ("href", pa.string())])


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType() if n == "port" else T.StringType()) for n in ("scheme", "host", "port", "path", "query", "fragment", "href")]))
def _parts(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.to_pylist():
        u = parse(t)
        rows.append(None if u is None else {"scheme": u.scheme, "host": u.host, "port": u.port, "path": u.path, "query": u.query, "fragment": u.fragment, "href": str(u)})
    return pa.array(rows, _PARTS)


def url_join(base: Column, text: Column) -> Column:
    """``text`` resolved against ``base``; null where it cannot be."""
    return _join(base, text)


def url_parts(text: Column) -> Column:
    """Struct of an absolute address's parts; null for what is none."""
    return _parts(text)
