"""Cookies as ordered pairs: parse, set, delete, describe, fingerprint, candidates. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["cookie_fingerprint", "cookie_pairs", "delete_cookie", "describe_cookies", "domain_candidates", "jar_text", "path_candidates", "set_cookie"]

MAX_COOKIES = 200
_PAIR = "array<struct<name: string, value: string>>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def cookie_pairs(jar: Column) -> Column:
    """(name, value) in order; parts without ``=`` are left out."""
    parts = F.filter(F.split(jar, ";"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(parts, lambda p: F.struct(_trim(F.substring_index(p, "=", 1)).alias("name"), _trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value")))


def jar_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "; ")


def set_cookie(jar: Column, writes: Column) -> Column:
    """The jar after the writes, in order: only the first part of each counts; a known name keeps its place."""

    def one(pairs: Column, write: Column) -> Column:
        first = _trim(F.substring_index(write, ";", 1))
        name = _trim(F.substring_index(first, "=", 1))
        value = _trim(F.regexp_replace(first, r"^[^=]*=", ""))
        known = F.exists(pairs, lambda p: p["name"] == name)
        put = F.struct(name.alias("name"), value.alias("value"))
        valid = F.contains(first, F.lit("=")) & (name != "")
        # of several with one name the first is replaced
        at = F.array_position(F.transform(pairs, lambda p: p["name"]), name)
        replaced = F.transform(pairs, lambda p, i: F.when(i + 1 == at, put).otherwise(p))
        return F.when(~valid, pairs).when(known, replaced).otherwise(F.concat(pairs, F.array(put)))

    start = F.coalesce(cookie_pairs(jar), F.array().cast(_PAIR)).cast(_PAIR)
    return jar_text(F.aggregate(writes, start, lambda acc, w: one(acc, w).cast(_PAIR)))


def delete_cookie(pairs: Column, name: Column) -> Column:
    """Pairs without those of a name."""
    return F.filter(pairs, lambda p: p["name"] != name)


def describe_cookies(pairs: Column, page_url: Column) -> Column:
    """Each pair with what a session cookie of the page has; at most 200, as the jar holds."""
    host = F.lower(F.regexp_extract(page_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.transform(
        F.slice(pairs, 1, MAX_COOKIES),
        lambda p: F.struct(
            p["name"].alias("name"), p["value"].alias("value"), host.alias("domain"), F.lit("/").alias("path"), F.lit(-1.0).alias("expires"),
            (F.octet_length(p["name"]) + F.octet_length(p["value"])).alias("size"), F.lit(False).alias("httpOnly"), F.startswith(page_url, F.lit("https:")).alias("secure"), F.lit(True).alias("session"), F.lit("Lax").alias("sameSite"),
        ),
    )


def cookie_fingerprint(jar: Column) -> Column:
    """Parts of a jar in sorted order, so that equal jars compare equal."""
    return F.array_join(F.array_sort(F.split(jar, "; ")), "; ")


def domain_candidates(host: Column) -> Column:
    """A host and its parents down to two labels."""
    h = F.lower(F.regexp_replace(host, r"^\.+", ""))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    up = F.when(n > 2, F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.array_join(F.slice(labels, k, n), "."))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(h), up)


def path_candidates(path: Column) -> Column:
    """A path, its directories upward, and the root."""
    p = F.when(path == "", F.lit("/")).otherwise(path)
    parts = F.split(p, "/")
    n = F.size(parts)
    least = F.when(F.startswith(p, F.lit("/")), 2).otherwise(1)
    ups = F.transform(F.sequence(n, least, F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    out = F.filter(ups, lambda x: x != "")
    return F.when(F.array_contains(out, "/"), out).otherwise(F.concat(out, F.array(F.lit("/"))))
