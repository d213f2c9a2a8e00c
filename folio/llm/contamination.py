"""Evaluation texts leaking into the corpus (problem 8).

*Template canonicalisation*: words are reduced (invisible characters, accents, compatibility forms, case),
and numbers, names and units become typed placeholders. Windows of ``WORDS`` successive template words are
hashed and hash-joined with the windows of the evaluation items; an item of fewer words (``LEAST_WORDS`` at least) is one
window as a whole. Matches are then judged by their *slots*, the words behind the placeholders, over all windows
that lie on one alignment of a document with an item: equal slots are a literal leak, slots that map one to one onto
the item's throughout are a re-parameterised copy of it, others are chance.

The windows of the items also screen the corpus windows in the pass that makes them, as a sorted array whose
size is checked; beyond the bound all windows go to the join, with the same result. Both sides are joined by hash, and a
passage that a third of all documents quote costs one small row per document. The words of the items are counted in Spark and go
along with the tasks up to ``MAX_VOCABULARY``; more raise an error that asks for blocks of items.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import broadcast_if_small, spread, stage

__all__ = ["leak_windows", "leaks", "reduce_text", "template"]

WORDS = 13
#: Words that a shorter item must have to be looked for as a whole.
LEAST_WORDS = 5
#: Windows of all items up to which they are sent to every task as a screen (8 bytes each).
MAX_SCREEN = 4_000_000
#: Distinct words of all items up to which they are sent along.
MAX_VOCABULARY = 2_000_000

#: Units of measure, fixed values.
UNITS = frozenset("km m cm mm mi mile miles kg g mg lb lbs oz l ml h hr hrs hour hours min mins minute minutes sec seconds day days week weeks month months percent pct usd eur gbp dollar dollars euro euros pound pounds heures heure jours horas días stunden tage".split())
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_WORD = re.compile(r"[^\W_]+")


def _mark_class() -> str:
    """Ranges of all combining marks, from the character database."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Me")]
    out, start = [], marks[0]
    for a, b in zip(marks, [*marks[1:], -1]):
        if b != a + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    return "".join(out)


_MARKS = re.compile(f"[{_mark_class()}]+")


def reduce_text(text: str) -> str:
    """Without invisible characters, accents and compatibility forms; case is kept."""
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))


def words_of(text: str) -> tuple[list[str], list[str]]:
    """(words without case, the same words as written)."""
    plain = reduce_text(text)
    low = _WORD.findall(plain.casefold())
    as_is = _WORD.findall(plain)
    return low, as_is if len(as_is) == len(low) else low


def _h(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_NUMBER, _NAME, _UNIT = _h("\x00number"), _h("\x00name"), _h("\x00unit")
_SLOTS = np.array(sorted((_NUMBER, _NAME, _UNIT)), dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


def cases_of(text: str) -> dict[str, int]:
    """Word -> 1 where it stands capitalised within a sentence, plus 2 where it stands in lower case."""
    plain = reduce_text(text)
    out: dict[str, int] = {}
    for m in _WORD.finditer(plain):
        w = m[0]
        said = 0
        if w[0].isupper() and not w.isupper():
            before = plain[max(0, m.start() - 40) : m.start()].rstrip()
            said = 1 if before and before[-1] not in ".!?:\n" else 0
        elif w.islower():
            said = 2
        low = w.casefold()
        out[low] = out.get(low, 0) | said
    return out


def template(low: list[str], as_is: list[str], known: dict[str, int] | None) -> np.ndarray:
    """Hash of each word's template form; 0 for a word that no item has.

    ``known``: template forms of the items' words. Other words are numbers by their first
    character, names by a capital, and otherwise unknown.
    """
    ids = np.fromiter((known.get(w, 0) for w in low), dtype=np.uint64, count=len(low))
    for k in np.flatnonzero(ids == 0):
        w = low[k]
        if w[0].isdigit():
            ids[k] = _NUMBER
        elif as_is[k][0].isupper():
            ids[k] = _NAME
    return ids


def window_hashes(ids: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``words`` words, whether all of its words are known)."""
    n = len(ids) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, 0 if words == WORDS else words, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            h += ids[k : k + n] * _POWERS[k]
        h ^= h >> np.uint64(31)
    gaps = np.concatenate(([0], np.cumsum(ids == 0)))
    return h, gaps[words:] == gaps[:n]


_WINDOWS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("slots", pa.list_(pa.string()))])
_WINDOWS_SQL = "id bigint, h bigint, at int, words int, slots array<string>"


def _windows_pass(known: dict[str, int], screen: np.ndarray | None, lengths: list[int] | None):
    """``lengths``: window lengths to look for; None for items, which have their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _WINDOWS]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not text:
                    continue
                low, as_is = words_of(text)
                own = [min(WORDS, len(low))] if lengths is None else [n for n in lengths if n <= len(low)]
                if not own or own[0] < LEAST_WORDS:
                    continue
                form = template(low, as_is, known)
                slot = np.isin(form, _SLOTS)
                for words in own:
                    h, ok = window_hashes(form, words)
                    if screen is not None and len(screen):
                        at = np.searchsorted(screen, h)
                        at[at == len(screen)] = 0
                        ok &= screen[at] == h
                    for k in np.flatnonzero(ok):
                        for c, v in zip(cols, (i, int(h[k].view(np.int64)), int(k), words, [low[j] for j in range(k, k + words) if slot[j]])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _WINDOWS)], schema=_WINDOWS)

    return run


def _vocabulary(items: DataFrame) -> dict[str, int]:
    """Template form of every word of the items; the words are counted before they are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for w, c in cases_of(text).items():
                    said[w] = said.get(w, 0) | c
            yield pa.RecordBatch.from_arrays([pa.array(list(said), pa.string()), pa.array([c & 1 for c in said.values()], pa.int32()), pa.array([c >> 1 for c in said.values()], pa.int32())], ["word", "upper", "lower"])

    words = items.where("text is not null").select("text").mapInArrow(run, "word string, upper int, lower int").groupBy("word").agg((F.max("upper") > F.max("lower")).alias("name"))
    rows = words.limit(MAX_VOCABULARY + 1).toArrow()
    if rows.num_rows > MAX_VOCABULARY:
        raise ValueError(f"the items have more than {MAX_VOCABULARY} different words; split them into blocks")
    form = lambda w, name: _NUMBER if w[0].isdigit() else _UNIT if w in UNITS else _NAME if name else _h(w)
    return {w: form(w, name) for w, name in zip(rows["word"].to_pylist(), rows["name"].to_pylist())}


def leak_windows(documents: DataFrame, items: DataFrame, max_screen: int = MAX_SCREEN) -> DataFrame:
    """(doc_id, item_id, at, item_at, words, slots, item_slots): every pair of equal template windows of a document and an item.

    ``documents``: (doc_id, text); ``items``: (item_id, text). Null and empty texts have no windows, nor have items of fewer
    than ``LEAST_WORDS`` words. ``max_screen``: see ``MAX_SCREEN``; the rows are the same on both sides of it.
    """
    spark = documents.sparkSession
    known = spark.sparkContext.broadcast(_vocabulary(items))

    def of(df: DataFrame, name: str, screen=None, lengths=None) -> DataFrame:
        def run(batches):
            yield from _windows_pass(known.value, screen.value if screen is not None else None, lengths)(batches)

        return spread(df.select(F.col(name).cast("bigint"), "text")).mapInArrow(run, _WINDOWS_SQL)

    own = stage(of(items, "item_id").distinct(), "items")
    lengths = sorted(r.words for r in own.select("words").distinct().collect())  # from LEAST_WORDS to WORDS
    hashes = own.select("h").distinct().limit(max_screen + 1).toArrow()["h"].to_numpy()
    screen = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64))) if len(hashes) <= max_screen else None
    found = of(documents, "doc_id", screen, lengths).withColumnRenamed("id", "doc_id").distinct()
    own = own.select(F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    return found.join(broadcast_if_small(own, 200_000), "h").select("doc_id", "item_id", "at", "item_at", "words", "slots", "item_slots")


def leaks(windows: DataFrame) -> DataFrame:
    """(doc_id, item_id, literal, changed, chance, short): windows of each pair by the judgement of their slots.

    ``literal``: windows of ``WORDS`` words with equal slots; ``changed``: others whose slots map one to one, without a contradiction
    in any window of the same alignment; ``chance``: the rest. ``short``: finds of whole items that have fewer words, literal or changed.
    """
    full = F.col("words") == WORDS
    same = F.col("slots") == F.col("item_slots")
    # an alignment holds each position of the item once at most, so its slots are few
    by = windows.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count_if(full & same).alias("literal"), F.count_if(full & ~same).alias("other"), F.count_if(~full).alias("short"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "item_slots")))).alias("map"),
    )
    size = lambda side: F.size(F.array_distinct(F.transform("map", lambda x: x[side])))
    kept = (F.size("map") == size("slots")) & (F.size("map") == size("item_slots"))
    total = lambda c: F.sum(c).cast("bigint")
    return by.groupBy("doc_id", "item_id").agg(
        total("literal").alias("literal"), total(F.when(kept, F.col("other")).otherwise(0)).alias("changed"), total(F.when(kept, 0).otherwise(F.col("other"))).alias("chance"), total(F.when(kept, F.col("short")).otherwise(0)).alias("short")
    )
