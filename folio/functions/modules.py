"""Import maps: parse, merge and resolve; used inside Arrow stages."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.url import join, parse

__all__ = ["ImportMap", "resolve_specifier"]


def _key(key: str, base: str) -> str:
    """Keys that are addresses, or relative to one, are made absolute; bare keys stay."""
    if key.startswith(("/", "./", "../")) or parse(key) is not None:
        return join(base, key) or key
    return key


def _entries(given: dict, base: str) -> dict[str, str]:
    """Longest keys first; entries whose target cannot be resolved, or that map a prefix to no prefix, are left out."""
    out = {}
    for k, v in given.items():
        target = join(base, v) if isinstance(v, str) else None
        k = _key(k, base)
        if target is not None and (target.endswith("/") or not k.endswith("/")):
            out[k] = target
    return dict(sorted(out.items(), key=lambda e: -len(e[0].encode())))


def _find(entries: dict[str, str], specifier: str) -> str | None:
    for k, target in entries.items():
        if k == specifier:
            return target
        if k.endswith("/") and specifier.startswith(k):
            return target + specifier[len(k) :]
    return None


@dataclass
class ImportMap:
    imports: dict[str, str] = field(default_factory=dict)
    scopes: list[tuple[str, dict[str, str]]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str, base: str) -> ImportMap | None:
        """The map of a JSON object, or None for text that is none."""
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, dict):
            return None
        imports, scopes = value.get("imports"), value.get("scopes")
        out = cls(_entries(imports, base) if isinstance(imports, dict) else {})
        for scope, entries in (scopes.items() if isinstance(scopes, dict) else ()):
            at = join(base, scope)
            if isinstance(entries, dict) and at is not None:
                out.scopes.append((at, _entries(entries, base)))
        out.scopes.sort(key=lambda s: -len(s[0].encode()))
        return out

    def merge(self, other: ImportMap) -> ImportMap:
        """Both maps; of equal keys the first stands."""
        imports = other.imports | self.imports
        return ImportMap(dict(sorted(imports.items(), key=lambda e: -len(e[0].encode()))), sorted(self.scopes + other.scopes, key=lambda s: -len(s[0].encode())))

    def resolve(self, specifier: str, referrer: str) -> str | None:
        """Address of a specifier as imported from ``referrer``: its scopes first, then the map itself."""
        s = _key(specifier, referrer)
        for scope, entries in self.scopes:
            if referrer.startswith(scope) and (found := _find(entries, s)) is not None:
                return found
        return _find(self.imports, s)


@F.arrow_udf(T.StringType())
def _resolve(text: pa.Array, base: pa.Array, specifier: pa.Array, referrer: pa.Array) -> pa.Array:
    out = []
    for t, b, s, r in zip(*(c.to_pylist() for c in (text, base, specifier, referrer))):
        m = ImportMap.parse(t, b) if None not in (t, b, s, r) else None
        out.append(m.resolve(s, r) if m else None)
    return pa.array(out, pa.string())


def resolve_specifier(text: Column, base: Column, specifier: Column, referrer: Column) -> Column:
    """Address that an import map gives a specifier; null if it gives none."""
    return _resolve(text, base, specifier, referrer)
