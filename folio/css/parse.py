"""Selectors as a small syntax tree, after the public Selectors 4 grammar."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

__all__ = ["Complex", "Compound", "Nth", "SelectorError", "parse_selector"]


class SelectorError(ValueError):
    """The text is no selector."""


@dataclass(frozen=True)
class Nth:
    """``a n + b`` with the selector list of an ``of``, if any."""

    a: int
    b: int
    of: tuple = ()


@dataclass(frozen=True)
class Compound:
    """Tests that all hold for one element: (kind, ...) tuples."""

    tests: tuple


@dataclass(frozen=True)
class Complex:
    """Compounds with the combinator that stands before each; that of the first is empty, or given in relative selectors."""

    parts: tuple = field(default_factory=tuple)


_NAME = re.compile(r"-?(?:[_a-zA-Z]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F]|--)(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F])*")
_HASH = re.compile(r"#((?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n0-9a-fA-F])+)")
_ATTR = re.compile(r"\[\s*(?:(?:[\w*-]*\|)(?!=))?([^\s=~|^$*\]\"'\[]+)\s*(?:([~|^$*]?=)\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([^\s\]\"']+))\s*([iIsS])?\s*)?\]", re.S)
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*(?:of\s+(.*))?\Z", re.I | re.S)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
_LISTS = ("is", "where", "not", "has", "matches", "-webkit-any", "any")
_NTHS = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
_OLD_ELEMENTS = ("before", "after", "first-line", "first-letter")


def _plain(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and 0 < int(m[1], 16) <= 0x10FFFF else m[2] or "�", s)


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def space(self) -> bool:
        start = self.i
        while self.i < len(self.s):
            if self.s[self.i] in " \t\n\r\f":
                self.i += 1
            elif self.s.startswith("/*", self.i):
                end = self.s.find("*/", self.i + 2)
                self.i = len(self.s) if end < 0 else end + 2
            else:
                break
        return self.i > start

    def take(self, pattern: re.Pattern):
        m = pattern.match(self.s, self.i)
        if m:
            self.i = m.end()
        return m

    def group(self) -> str:
        """Text up to the closing bracket of one just opened."""
        depth, start, quote = 1, self.i, ""
        while self.i < len(self.s):
            c = self.s[self.i]
            if quote:
                if c == "\\":
                    self.i += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
                if not depth:
                    self.i += 1
                    return self.s[start : self.i - 1]
            self.i += 1
        raise SelectorError(f"unclosed bracket in {self.s!r}")

    def pseudo(self):
        self.i += 1
        element = self.s.startswith(":", self.i)
        if element:
            self.i += 1
        m = self.take(_NAME)
        if not m:
            raise SelectorError(f"no name after a colon in {self.s!r}")
        name = _plain(m[0]).lower()
        arg = None
        if self.s.startswith("(", self.i):
            self.i += 1
            arg = self.group()
        if element or name in _OLD_ELEMENTS:
            return ("never", name)
        if name in _LISTS:
            if arg is None or not arg.strip() and name in ("not", "has"):
                raise SelectorError(f":{name} needs an argument")
            forgiving = name not in ("not", "has")
            return ("not" if name == "not" else "has" if name == "has" else "is", tuple(_list(arg, relative=name == "has", forgiving=forgiving)))
        if name in _NTHS:
            m = _NTH.match(arg or "")
            if not m or arg is None:
                raise SelectorError(f"bad argument of :{name}")
            if m[1]:
                a, b = 2, int(m[1].lower() == "odd")
            elif m[5]:
                a, b = 0, int(m[5])
            else:
                a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
                b = int((m[3] or "+") + (m[4] or "0"))
            if m[6] and "of-type" in name:
                raise SelectorError(f":{name} takes no 'of'")
            return ("nth", "last" in name, "type" in name, Nth(a, b, tuple(_list(m[6])) if m[6] else ()))
        simple = {"first-child": (False, False), "last-child": (True, False), "first-of-type": (False, True), "last-of-type": (True, True)}
        if name in simple:
            return ("nth", *simple[name], Nth(0, 1))
        if name == "only-child":
            return ("only", False)
        if name == "only-of-type":
            return ("only", True)
        return ("pseudo", name)

    def compound(self) -> Compound | None:
        tests: list = []
        start = self.i
        if self.s.startswith("*", self.i) and not self.s.startswith("*|", self.i):
            self.i += 1
        else:
            if self.s.startswith("*|", self.i):
                self.i += 2
            m = self.take(_NAME)
            if m:
                tests.append(("tag", _plain(m[0]).lower()))
            elif self.s.startswith("*", self.i):
                self.i += 1
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "#":
                m = self.take(_HASH)
                if not m:
                    raise SelectorError(f"bad id in {self.s!r}")
                tests.append(("id", _plain(m[1])))
            elif c == ".":
                self.i += 1
                m = self.take(_NAME)
                if not m:
                    raise SelectorError(f"bad class in {self.s!r}")
                tests.append(("class", _plain(m[0])))
            elif c == "[":
                m = self.take(_ATTR)
                if not m:
                    raise SelectorError(f"bad attribute test in {self.s!r}")
                value = next((x for x in (m[3], m[4], m[5]) if x is not None), None)
                tests.append(("attr", _plain(m[1]).lower(), m[2] or "", None if value is None else _plain(value), (m[6] or "").lower()))
            elif c == ":":
                tests.append(self.pseudo())
            else:
                break
        return Compound(tuple(tests)) if self.i > start else None

    def complex(self, relative: bool) -> Complex:
        parts = []
        self.space()
        comb = ""
        if relative:
            comb = " "
            if self.i < len(self.s) and self.s[self.i] in ">+~":
                comb = self.s[self.i]
                self.i += 1
                self.space()
        while True:
            c = self.compound()
            if c is None:
                raise SelectorError(f"expected a selector in {self.s!r} at {self.i}")
            parts.append((comb, c))
            spaced = self.space()
            if self.i >= len(self.s) or self.s[self.i] == ",":
                return Complex(tuple(parts))
            if self.s[self.i] in ">+~":
                comb = self.s[self.i]
                self.i += 1
                self.space()
            elif spaced:
                comb = " "
            else:
                raise SelectorError(f"unexpected {self.s[self.i]!r} in {self.s!r}")


def _list(text: str, relative: bool = False, forgiving: bool = False) -> list[Complex]:
    if forgiving:  # members that do not parse are left out
        out, p, start, depth = [], _Parser(text), 0, 0
        pieces = []
        for k, c in enumerate(text):
            depth += (c in "([") - (c in ")]")
            if c == "," and not depth:
                pieces.append(text[start:k])
                start = k + 1
        pieces.append(text[start:])
        for piece in pieces:
            try:
                p = _Parser(piece)
                one = p.complex(relative)
                if p.i == len(piece):
                    out.append(one)
            except SelectorError:
                continue
        return out
    p, out = _Parser(text), []
    while True:
        out.append(p.complex(relative))
        if p.i >= len(p.s):
            return out
        p.i += 1


def parse_selector(text: str) -> list[Complex]:
    """The members of a selector list; SelectorError for text that is none."""
    if not text or not text.strip():
        raise SelectorError("empty selector")
    return _list(text)
