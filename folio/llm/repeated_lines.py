"""Lines repeated across the documents of one source (problem 1).

Content-defined chunking: a rolling hash runs over the *letters* of the whole document (case and everything but letters
left out, line ends too) and cuts the stream where the hash of the last ``WINDOW`` letters has ``MASK`` zero bits, so an edit
moves only the cuts next to it. A document's chunks are those of the stream, which may run across line ends, and those
of each line by itself, whose ends are the line's own. Distinct documents are counted per source and chunk, and a
chunk that stands on too many is *cut* wherever it stands: a notice that is glued to a paragraph, or broken into
other lines on other pages, goes with the rest of its page left whole (``cut_repeated``).

A *line* is repeated when all of its chunks are; an exact count of the line follows, because chunks that are each
repeated need not be so together (``repeated_lines``).

Plan: one Arrow pass over the pages writes a narrow table (hashes and heads of lines), which is staged with each page's
source and threshold; counts are partial aggregates by (source, chunk), so a source with a third of all rows is
counted where its rows lie. The excessive chunks of a source are at most (chunks per document) / share, whatever its
size; they are broadcast if all of them are few, else joined by (source, chunk) and a salt over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.html.layout import render
from folio.session import hot_join, spread, stage

__all__ = ["chunk_letters", "cut_repeated", "letters_of", "line_table", "repeated_lines", "stream_chunks"]

WINDOW = 16
MASK = np.uint64((1 << 5) - 1)
#: Chunks are at least MIN_CHUNK letters, but for the last one of a line.
MIN_CHUNK = 24
_BASE = 0x9E3779B97F4A7C15
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)

LINES = pa.schema([("page_id", pa.int64()), ("key", pa.int64()), ("head", pa.string()), ("first", pa.bool_()), ("chunks", pa.list_(pa.int64())), ("fresh", pa.list_(pa.int64()))])


def letters_of(line: str) -> str:
    """Only the letters of a line, without case."""
    s = _NOT_LETTERS.sub("", line)
    if not s.isalpha():
        s = "".join(c for c in s if c.isalpha())
    return s.lower()


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _cuts(joined: str) -> np.ndarray:
    """Ends of the windows whose hash has the mask's zero bits, at any position of the stream."""
    n = len(joined)
    if n < MIN_CHUNK:
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    code = (code + np.uint64(1)) * np.uint64(_BASE | 1)
    code ^= code >> np.uint64(29)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h[k:] += code[: n - k] * _POWERS[k]
        h ^= h >> np.uint64(32)
    return np.flatnonzero((h & MASK) == 0) + 1


def chunk_spans(lines: list[str]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """Spans of letters in the stream: the chunks of each line (given as letters), and the stream's chunks that run across a line's end.

    A line's own cuts are those whose window lies within it. Empty lines give no chunk.
    """
    joined = "".join(lines)
    cuts = _cuts(joined).tolist()
    out: list[list[tuple[int, int]]] = []
    start = at = 0
    for line in lines:
        end = start + len(line)
        own: list[tuple[int, int]] = []
        last = start
        while at < len(cuts) and cuts[at] <= end:
            cut = cuts[at]
            at += 1
            if cut - start >= WINDOW and cut - last >= MIN_CHUNK and cut < end:
                own.append((last, cut))
                last = cut
        if end > last:
            own.append((last, end))
        out.append(own)
        start = end
    ends = np.cumsum([len(x) for x in lines]) if lines else np.zeros(0, np.int64)
    across, last = [], 0
    for cut in cuts:
        if cut - last < MIN_CHUNK:
            continue
        k = int(np.searchsorted(ends, last, side="right"))
        if k < len(ends) and ends[k] < cut:  # a line ends within
            across.append((last, cut))
        last = cut
    return out, across


def chunk_letters(lines: list[str]) -> list[list[int]]:
    """Hashes of the content-defined chunks of each line (given as letters)."""
    joined = "".join(lines)
    return [[_hash(joined[a:b]) for a, b in own] for own in chunk_spans(lines)[0]]


def stream_chunks(lines: list[str]) -> list[int]:
    """Hashes of the chunks that run across a line's end."""
    joined = "".join(lines)
    return [_hash(joined[a:b]) for a, b in chunk_spans(lines)[1]]


def _rows(page_id: int, lines: list[str]):
    letters = [letters_of(x) for x in lines]
    spans, across = chunk_spans(letters)
    joined = "".join(letters)
    extra = dict.fromkeys(_hash(joined[a:b]) for a, b in across)
    seen: set[int] = set(extra)
    keys: set[int] = set()
    done: set[tuple[int, str]] = set()
    for line, own, cut in zip(lines, letters, spans):
        if not own:
            continue
        key, head = _hash(own), line[:60]
        if (key, head) in done:
            continue
        done.add((key, head))
        chunks = [_hash(joined[a:b]) for a, b in cut]
        fresh = [c for c in dict.fromkeys(chunks) if c not in seen]
        seen.update(fresh)
        if extra:  # the stream's chunks go with the first line
            fresh += extra
            extra = {}
        yield page_id, key, head, key not in keys, chunks, fresh
        keys.add(key)


def line_table(pages: DataFrame, markup: bool = True, text_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row for each different line of a document: its letters' hash and head, its chunks, and those chunks (of any kind) that the document shows for the first time.

    ``markup``: the text is HTML and its visible lines count; else its own lines do.
    Null and empty texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in LINES]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or i is None:
                    continue
                lines = [x[0] for x in render(text).lines] if markup else [" ".join(x.split()) for x in text.split("\n")]
                for row in _rows(i, lines):
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, LINES)], schema=LINES)

    return spread(pages.select(F.col(id_col).cast("bigint"), F.col(text_col))).mapInArrow(run, "page_id bigint, key bigint, head string, first boolean, chunks array<bigint>, fresh array<bigint>")


def with_sources(lines: DataFrame, doc_source: DataFrame, min_docs: int = 3, min_share: float = 0.10) -> DataFrame:
    """``lines`` with their document's source and ``least``, the number of its documents from which a chunk or line is repeated excessively; staged."""
    own = doc_source.where("site is not null").select("page_id", "site")
    size = own.groupBy("site").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(min_share)).alias("least"))
    return stage(lines.join(hot_join(own, size, ["site"], "page_id"), "page_id"), "lines")


def _excessive(counted: DataFrame, name: str) -> DataFrame:
    """(site, name) of what stands on too many documents; ``counted``: a row for each document."""
    n = counted.groupBy("site", name).agg(F.count("*").alias("docs"), F.first("least").alias("least"))
    return n.where(F.col("docs") >= F.col("least") - F.lit(1e-9)).select("site", name)


def excessive_chunks(own: DataFrame) -> DataFrame:
    """(site, chunk), staged: the chunks that are repeated excessively; ``own``: as from ``with_sources``."""
    return stage(_excessive(own.select("site", "least", F.explode("fresh").alias("chunk")), "chunk"), "chunks")


def repeated_lines(own: DataFrame, often: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """(page_id, key, head) of the lines that stand on too many documents of their source.

    ``own``: as from ``with_sources``; ``often``: as from ``excessive_chunks``. Candidates are the lines whose chunks are all repeated;
    an exact count of the line follows. Up to ``max_rows`` chunks go along as one array per source, more are joined one by one:
    the rows are the same. A line that a document repeats counts once for it; rows
    that share an id count as documents of their own.
    """
    if often.limit(max_rows + 1).count() <= max_rows:
        sets = often.groupBy("site").agg(F.collect_set("chunk").alias("often"))
        found = own.join(F.broadcast(sets), "site").where(F.forall("chunks", lambda c: F.array_contains("often", c))).select("page_id", "site", "least", "key", "head", "first")
    else:
        each = own.select("page_id", "site", "least", "key", "head", "first", F.size(F.array_distinct("chunks")).alias("n"), F.explode(F.array_distinct("chunks")).alias("chunk"))
        met = hot_join(each, often, ["site", "chunk"], "page_id", max_rows=0)
        found = met.groupBy("page_id", "site", "least", "key", "head", "first", "n").agg(F.count_distinct("chunk").alias("met")).where("met = n").drop("met", "n")
    exact = _excessive(found.where("first"), "key")
    return hot_join(found, exact, ["site", "key"], "page_id").select("page_id", "key", "head")


def cut_text(lines: list[str], repeated: set[int]) -> tuple[list[str], int]:
    """(lines that are left, letters cut): every span of a repeated chunk is cut, with what stands between it and the next letter.

    A chunk of fewer than ``MIN_CHUNK`` letters, the end of a line, is cut only after a cut one or with its whole line.
    """
    letters = [letters_of(x) for x in lines]
    spans, across = chunk_spans(letters)
    joined = "".join(letters)
    gone = np.zeros(len(joined), dtype=bool)
    for a, b in across:
        if _hash(joined[a:b]) in repeated:
            gone[a:b] = True
    for own in spans:
        hits = [_hash(joined[a:b]) in repeated for a, b in own]
        whole = all(hits)
        for k, ((a, b), hit) in enumerate(zip(own, hits)):
            if hit and (whole or b - a >= MIN_CHUNK or k and hits[k - 1]):
                gone[a:b] = True
    out, at = [], 0
    for line, own in zip(lines, letters):
        part = gone[at : at + len(own)]
        at += len(own)
        if not len(own) or not part.any():
            out.append(line)
        elif not part.all():
            kept, cutting, k = [], False, 0
            for c in line:
                n = len(letters_of(c))
                if n:
                    cutting = bool(part[k : k + n].all())
                    k += n
                if not cutting:
                    kept.append(c)
            out.append(" ".join("".join(kept).split()))
    return [x for x in out if x], int(gone.sum())


def cut_repeated(pages: DataFrame, own: DataFrame, often: DataFrame, text_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, text, removed): each document's visible text without its repeated chunks; ``removed``: letters cut.

    ``own``, ``often``: as from ``with_sources`` and ``excessive_chunks``. A document gets only those repeated chunks that it holds itself.
    """
    each = own.select("page_id", "site", F.explode("fresh").alias("chunk"))
    held = hot_join(each, often, ["site", "chunk"], "page_id").groupBy("page_id").agg(F.collect_set("chunk").alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, counts = [], [], []
            for i, text, chunks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = [x[0] for x in render(text).lines]
                kept, n = cut_text(lines, set(chunks)) if chunks else (lines, 0)
                ids.append(i)
                texts.append("\n".join(kept))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["page_id", "text", "removed"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), text_col).join(held, "page_id", "left").mapInArrow(run, "page_id bigint, text string, removed bigint")
