"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["ascii_lower", "clean", "error_signature", "front_matter", "fetch_pattern_matches", "glob_matches", "lines", "seed_score", "strip_site_suffix", "truncate_chars"]

_WHITE = r"[\s\x{85}\p{Z}]"
#: Separators between a title and the name of its site, in the order in which they are tried (fixed values).
SEPARATORS = (" — ", " – ", " | ", " - ", " · ", " :: ")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean(c: Column) -> Column:
    """Unicode white space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{_WHITE}+", " "))


def lines(c: Column) -> Column:
    """Lines without their ends; the last line end opens no further line."""
    return F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")


def strip_site_suffix(title: Column) -> Column:
    """Title without a closing site name of at most 40 characters that is shorter than what precedes it."""
    out = F.regexp_replace(title, rf"\A{_WHITE}+|{_WHITE}+\z", "")
    for sep in reversed(SEPARATORS):
        tail = F.substring_index(title, sep, -1)
        head = title.substr(F.lit(1), F.char_length(title) - F.char_length(tail) - len(sep))
        trimmed = F.regexp_replace(head, rf"\A{_WHITE}+|{_WHITE}+\z", "")
        fits = F.contains(title, F.lit(sep)) & (trimmed != "") & (F.char_length(tail) <= 40) & (F.char_length(head) > F.char_length(tail))
        out = F.when(fits, trimmed).otherwise(out)
    return out


def truncate_chars(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last blank if that lies beyond half of them in bytes, and an ellipsis."""
    cut = F.substring(text, 1, most)
    head = F.regexp_extract(cut, r"(?s)\A(.*) ", 1)
    at_blank = F.contains(cut, F.lit(" ")) & (F.octet_length(head) > most // 2)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(at_blank, head).otherwise(cut), F.lit("…")))


def seed_score(text: Column, weight: float = 1.0) -> Column:
    """Prose score of a block: one point, one for each comma of either width, one for each 100 characters up to three."""
    commas = sum(F.char_length(text) - F.char_length(F.replace(text, F.lit(k), F.lit(""))) for k in (",", "，"))
    return (F.lit(1.0) + commas + F.least(F.char_length(text) / F.lit(100.0), F.lit(3.0))) * F.lit(weight)


def error_signature(message: Column) -> Column:
    """A message's class and shape: addresses and numbers masked, at most 90 characters (80 for others)."""
    kind = F.regexp_extract(message, r"([A-Za-z]*Error):\s*([^\n]{0,90})", 1)
    text = F.regexp_extract(message, r"([A-Za-z]*Error):\s*([^\n]{0,90})", 2)
    masked = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", "<url>"), r"\b\d+\b", "N")
    other = F.substring(F.regexp_replace(F.substring_index(message, "\n", 1), r"https?://\S+", "<url>"), 1, 80)
    return F.when(kind == "", other).otherwise(F.substring(F.concat(kind, F.lit(": "), F.trim(masked)), 1, 90))


def glob_matches(text: Column, pattern: Column) -> Column:
    """``*`` is any run of characters, ``?`` any one, all else itself; over the whole text."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|\-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z")))


def fetch_pattern_matches(url: Column, kind: Column, pattern: Column, wanted: Column) -> Column:
    """A pattern fits an address, and a kind of resource if it names one, whatever its case."""
    return glob_matches(url, pattern) & (wanted.isNull() | (F.lower(wanted) == F.lower(kind)))


def front_matter(title: Column, author: Column, site: Column, published: Column, url: Column, description: Column, length: Column, low: Column) -> Column:
    """YAML head of a reading: quoted fields that are there, the length, and the flag if it is set."""

    def quoted(name: str, c: Column) -> Column:
        value = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.when(c.isNotNull(), F.concat(F.lit(f'{name}: "'), value, F.lit('"\n')))

    fields = [quoted(n, c) for n, c in (("title", title), ("author", author), ("site", site), ("published", published), ("url", url), ("description", description))]
    tail = F.concat(F.lit("length: "), length.cast("string"), F.lit("\n"), F.when(low, F.lit("low_confidence: true\n")).otherwise(""))
    return F.concat(F.lit("---\n"), F.concat_ws("", *fields), tail, F.lit("---\n\n"))
