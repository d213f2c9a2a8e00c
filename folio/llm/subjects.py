"""Subject areas of each document (problem 9).

*Fit*, on all distinct texts, each read whole: normalised tf-idf vectors are clustered by bisecting k-means in passes over
the staged vectors; only the two members that a split begins with are drawn. Each leaf is described by its discriminative terms (log odds against the other leaves) and has the
subjects that its labelled texts have, each subject counting alike. A discriminative term belongs to leaves as it stands in them.

*Assignment*, over all documents and whole texts: each sentence is shared out over the leaves to which its terms belong; a
document is a *mixture of leaves* by the share of its text, and the subjects of its leaves, each by its share, are the
document's. It gets every subject whose share is at least ``MIN_SHARE``. One Arrow pass without a shuffle; the model is a
table of terms by leaves.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import spread, stage

__all__ = ["Model", "assign", "bisect", "bisecting_kmeans", "distinct_texts", "fit", "fit_sample", "leaf_mixture", "leaf_table", "mixture"]

LEAVES = 320
#: Least share of a document's text; about a third, less what headings and notes take and what leaves of mixed texts share out to others.
MIN_SHARE = 0.21
#: Least share of a term's texts that stand under one subject, less its error by chance.
PURE = 0.4

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Blanks after a full stop, or line ends; begins with a class of characters, which the search looks for quickly.
_SENTENCE = re.compile(r"\s(?:(?<=[.!?。！？]\s)\s*|(?<=[\r\n])[\r\n]*)")


class _Codes(dict):
    """Piece of a text between blanks -> codes of its words, in order; no word holds a blank, and most pieces come again and again."""

    def __init__(self, code):
        super().__init__()
        self.code = code

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = tuple(k for k in map(self.code, _WORD.findall(piece)) if k is not None)
        if len(piece) <= 40:
            if len(self) >= 300_000:
                self.clear()
            self[piece] = got
        return got

    def of(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, text.lower().split())))


@dataclass
class Model:
    """``terms``: word -> row of ``belongs`` (terms by leaves: how much of a term stands in each leaf); ``lean``: leaves by subjects; ``leaves``: (leaf, subject, size, terms)."""

    subjects: list[str] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    belongs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    lean: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: list[tuple[int, str | None, int, list[str]]] = field(default_factory=list)


def _dots(rows: tuple[np.ndarray, np.ndarray, np.ndarray], centre: np.ndarray) -> np.ndarray:
    ptr, idx, val = rows
    part = np.concatenate(([0.0], np.cumsum(val * centre[idx])))
    return part[ptr[1:]] - part[ptr[:-1]]


def _take(rows, pick: np.ndarray):
    ptr, idx, val = rows
    n = ptr[pick + 1] - ptr[pick]
    out = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(ptr[pick] - out[:-1], n) + np.arange(out[-1])
    return out, idx[at], val[at]


def _mean(rows, width: int) -> np.ndarray:
    centre = np.bincount(rows[1], weights=rows[2], minlength=width)
    norm = math.sqrt(float(centre @ centre))
    return centre / norm if norm else centre


def bisecting_kmeans(rows, width: int, leaves: int, min_size: int = 8, rounds: int = 10, tries: int = 5, seed: int = 7) -> np.ndarray:
    """Leaf of each unit vector (CSR: row starts, columns, values); the leaf that is least tight is split first."""
    n = len(rows[0]) - 1
    rng = np.random.default_rng(seed)
    label = np.zeros(n, dtype=np.int64)
    total = {0: n}
    spread = {0: math.inf}
    done: set[int] = set()
    following = 1
    while len(total) < leaves:
        open_ = [k for k in total if k not in done and total[k] >= 2 * min_size]
        if not open_:
            break
        k = max(open_, key=lambda x: (spread[x], -x))
        members = np.flatnonzero(label == k)
        own = _take(rows, members)
        best = None
        # several beginnings: two members each, unlike one another; the tightest split counts
        for _ in range(tries):
            one = int(rng.integers(len(members)))
            like = _dots(own, _mean(_take(own, np.array([one])), width))
            unlike = np.flatnonzero(like <= np.quantile(like, 0.5))
            two = int(unlike[rng.integers(len(unlike))])
            a, b = _mean(_take(own, np.array([one])), width), _mean(_take(own, np.array([two])), width)
            side = like > _dots(own, b)
            for _ in range(rounds):
                if not side.any() or side.all():
                    break
                a, b = _mean(_take(own, np.flatnonzero(side)), width), _mean(_take(own, np.flatnonzero(~side)), width)
                da, db = _dots(own, a), _dots(own, b)
                new = da > db
                if (new == side).all():
                    break
                side = new
            if min(side.sum(), (~side).sum()) < min_size:
                continue
            tight = float(np.where(side, _dots(own, a), _dots(own, b)).sum())
            if best is None or tight > best[0]:
                best = tight, side, a, b
        if best is None:
            done.add(k)
            continue
        _, side, a, b = best
        label[members[side]] = following
        for x, part, centre in ((following, side, a), (k, ~side, b)):
            total[x] = int(part.sum())
            spread[x] = float(total[x] - _dots(_take(own, np.flatnonzero(part)), centre).sum())
        following += 1
    return label


def distinct_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, subject or null): exact copies are one text under their least doc_id, with the subject that most of their labels name.

    Repeated labels of a document must agree. A text whose copies are labelled far more rarely than documents in general has no subject: its few
    labels are the wrong ones. Copies meet as hashes, so a text on a third of all rows moves no more than any other.
    """
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.min("subject").alias("subject"), F.max("subject").alias("other")).where("subject = other").drop("other")
    given = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text", F.xxhash64("text").alias("key"), F.length("text").alias("n"))
    votes = given.drop("text").join(known, "doc_id", "left").groupBy("key", "n", "subject").agg(F.count("*").alias("votes"), F.min("doc_id").alias("doc_id"))
    rate = known.count() / max(1, documents.count())
    named = F.col("subject").isNotNull()
    tags = votes.groupBy("key", "n").agg(F.min("doc_id").alias("doc_id"), F.max(F.when(named, F.struct("votes", "subject"))).alias("top"), F.sum(F.when(named, F.col("votes"))).alias("all"), F.sum("votes").alias("copies"))
    tags = tags.select("doc_id", "key", "n", F.when((F.col("top.votes") * 2 > F.col("all")) & (F.col("top.votes") >= 0.3 * rate * F.col("copies")), F.col("top.subject")).alias("subject"))
    # the small side is the one that is hashed, texts are not sorted
    return given.join(tags.hint("shuffle_hash"), ["doc_id", "key", "n"]).select("doc_id", "text", "subject")


@dataclass
class Corpus:
    """All distinct texts as unit vectors (h, idx, val, subject; staged), their words with the number of texts that each stands in, and the number of texts."""

    vectors: DataFrame
    words: list[str]
    df: np.ndarray
    texts: int


def fit_sample(documents: DataFrame, labels: DataFrame) -> Corpus:
    """Every distinct text, read whole, as a normalised tf-idf vector; document frequencies are counted over all of them.

    The driver gets the vocabulary alone: words in at least one of 2,500 texts, so it does not grow with the corpus.
    """
    some = distinct_texts(documents, labels).select("text", "subject", F.xxhash64("doc_id").alias("h"))
    block = pa.schema([("n", pa.int64()), ("words", pa.list_(pa.string())), ("df", pa.list_(pa.int64())), ("lens", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary()), ("subjects", pa.list_(pa.string())), ("h", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch of texts becomes one row with words of its own, so that a word is written, read and looked up once for all texts of the batch."""
        known: dict[str, int] = {}
        codes = _Codes(lambda w: known.setdefault(w, len(known)) if len(w) > 1 else None)
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(known) > 1_000_000:
                known.clear()
                codes.clear()
            held, lens = [], []
            for text in batch.column(0).to_pylist():
                own = codes.of(text)
                held += own
                lens.append(len(own))
            held = np.array(held, np.int64)
            names = list(known)
            used = sorted(np.flatnonzero(np.bincount(held, minlength=len(names))).tolist(), key=names.__getitem__)
            rank = np.zeros(len(names), np.int64)
            rank[used] = np.arange(len(used))
            width = max(1, len(used))
            keys, counts = np.unique(np.repeat(np.arange(len(lens)), lens) * width + rank[held], return_counts=True)
            text, word = np.divmod(keys, width)
            values = [len(lens), [names[k] for k in used], np.bincount(word, minlength=len(used))]
            values += [x.astype(np.int32).tobytes() for x in (np.bincount(text, minlength=len(lens)), word, counts)] + [batch.column(1).to_pylist(), batch.column(2).to_numpy().tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, block)], schema=block)

    counted = stage(some.mapInArrow(count, "n bigint, words array<string>, df array<bigint>, lens binary, codes binary, counts binary, subjects array<string>, h binary"), "words")
    texts = counted.agg(F.sum("n")).first()[0] or 0
    least = max(4, texts // 2500)
    # words that stand everywhere weigh little by their idf, and terms are chosen by how unevenly they stand over subjects
    known = counted.select(F.explode(F.arrays_zip("words", "df")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.df").alias("df")).where(F.col("df") >= least).toArrow().sort_by("word")
    words, df = known["word"].to_pylist(), known["df"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(words)}, np.log(texts / df) if len(df) else np.zeros(0)))
    out = pa.schema([("h", pa.int64()), ("idx", pa.binary()), ("val", pa.binary()), ("subject", pa.string())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, idf = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                own, lens, codes, counts, subject, h = (batch.column(c)[k] for c in ("words", "lens", "codes", "counts", "subjects", "h"))
                lens, codes, counts = (np.frombuffer(x.as_py(), np.int32) for x in (lens, codes, counts))
                place = np.array([at.get(w, -1) for w in own.as_py()], np.int32)[codes] if len(codes) else codes
                held = place >= 0
                text, idx = np.repeat(np.arange(len(lens)), lens)[held], place[held]
                val = (1 + np.log(counts[held])) * idf[idx]
                val /= np.maximum(np.sqrt(np.bincount(text, weights=val * val, minlength=len(lens))), 1e-9)[text]
                ends = pa.py_buffer(np.concatenate(([0], 4 * np.cumsum(np.bincount(text, minlength=len(lens))))).astype(np.int32))
                vectors = [pa.Array.from_buffers(pa.binary(), len(lens), [None, ends, pa.py_buffer(x)]) for x in (idx, val.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), *vectors, pa.array(subject.as_py(), pa.string())], schema=out)

    return Corpus(stage(counted.mapInArrow(weigh, "h bigint, idx binary, val binary, subject string"), "vectors"), words, df, texts)


@dataclass
class Tree:
    """Splits: ``child`` is a node's first child (the second follows it) or -1, ``way`` what leads to the first one where its product is positive."""

    child: list[int] = field(default_factory=lambda: [-1])
    way: list[np.ndarray | None] = field(default_factory=lambda: [None])

    def split(self, node: int, way: np.ndarray) -> None:
        self.child[node], self.way[node] = len(self.child), way
        self.child += [-1, -1]
        self.way += [None, None]


def _descend(rows, child: np.ndarray, place: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Leaf of each vector; ``place``: where the way of a node begins in ``ways``. A vector without terms goes to the second child."""
    ptr, idx, val = rows
    node = np.zeros(len(ptr) - 1, np.int64)
    while True:
        go = np.flatnonzero(child[node] >= 0)
        if not len(go):
            return node
        p, i, v = rows if len(go) == len(node) else _take(rows, go)
        lens = np.diff(p)
        first = np.zeros(len(go), bool)
        if len(i):
            product = ways.take(i + np.repeat(place[node[go]], lens))
            product *= v
            first[lens > 0] = np.add.reduceat(product, p[:-1][lens > 0]) > 0
        node[go] = child[node[go]] + ~first


def _rows(batch: pa.RecordBatch):
    def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
        return ends - ends[0], np.frombuffer(data or b"", kind)[ends[0] : ends[-1]]

    ptr, idx = flat(batch.column(1), np.int32)
    return ptr, idx.astype(np.int64), flat(batch.column(2), np.float32)[1]


def _sweep(corpus: Corpus, tree: Tree, leaves: list[int], names: list[str] | None = None, picks: int = 0):
    """One pass over all vectors: (sizes, sums of vectors or, with ``names``, numbers of texts by term, votes by subject, labelled texts by term, drawn members) by leaf.

    Every task adds up its share, as many tasks as cores, so what the driver gets does not grow with the corpus.
    """
    context = corpus.vectors.sparkSession.sparkContext
    width, votes_of = len(corpus.words), {s: k for k, s in enumerate(names or [])}
    child = np.array(tree.child)
    inner = np.flatnonzero(child >= 0)
    place = np.zeros(len(child), np.int64)
    place[inner] = np.arange(len(inner)) * width
    ways = np.concatenate([np.zeros(0, np.float32), *(tree.way[k].astype(np.float32) for k in inner)])
    shared = context.broadcast((child, place, ways, np.array(leaves)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        child, place, ways, wanted = shared.value
        slot = np.full(len(child), -1)
        slot[wanted] = np.arange(len(wanted))
        size, sums, votes = np.zeros(len(wanted)), np.zeros(len(wanted) * width, np.float32), np.zeros((len(wanted), len(votes_of)))
        told, drawn = np.zeros(width, np.float32), [[] for _ in wanted]
        limit = np.full(len(wanted), np.iinfo(np.int64).max)
        for batch in batches:
            rows = _rows(batch)
            at = slot[_descend(rows, child, place, ways)]
            held = np.flatnonzero(at >= 0)
            size += np.bincount(at[held], minlength=len(wanted))
            p, i, v = rows if len(held) == len(at) else _take(rows, held)
            np.add.at(sums, i + np.repeat(at[held] * width, np.diff(p)), np.float32(1) if names is not None else v)
            lens = np.diff(rows[0])
            if names is not None:
                subject = np.array([votes_of.get(s, -1) for s in batch.column(3).to_pylist()])
                has = subject >= 0
                np.add.at(votes, (at[has], subject[has]), 1)
                told += np.bincount(rows[1][np.repeat(has, lens)], minlength=width).astype(np.float32)
            if picks:
                h = batch.column(0).to_numpy()
                for k in held[(lens[held] > 0) & (h[held] < limit[at[held]])]:
                    own = drawn[at[k]]
                    own.append((int(h[k]), rows[1][rows[0][k] : rows[0][k + 1]].astype(np.int32), rows[2][rows[0][k] : rows[0][k + 1]].copy()))
                    if len(own) >= 2 * picks:
                        own.sort(key=lambda x: x[0])
                        del own[picks:]
                        limit[at[k]] = own[-1][0]
        for k in range(len(wanted)):
            if size[k]:
                own = sums[k * width : (k + 1) * width]
                terms = np.flatnonzero(own)
                rest = pickle.dumps((votes[k], sorted(drawn[k], key=lambda x: x[0])[:picks]))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size[k]]), pa.array([terms.astype(np.int32).tobytes()], pa.binary()), pa.array([own[terms].tobytes()], pa.binary()), pa.array([rest], pa.binary())], ["leaf", "size", "terms", "sums", "rest"])
        if names is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([None], pa.binary()), pa.array([told.tobytes()], pa.binary()), pa.array([None], pa.binary())], ["leaf", "size", "terms", "sums", "rest"])

    got = corpus.vectors.coalesce(max(2, context.defaultParallelism)).mapInArrow(run, "leaf int, size double, terms binary, sums binary, rest binary").toArrow()
    size, sums, votes = np.zeros(len(leaves)), np.zeros((len(leaves), width), np.float32), np.zeros((len(leaves), len(votes_of)))
    told, drawn = np.zeros(width), [[] for _ in leaves]
    for k, n, terms, s, rest in zip(*(got[c] for c in ("leaf", "size", "terms", "sums", "rest"))):
        k, s = k.as_py(), np.frombuffer(s.as_buffer(), np.float32)
        if k < 0:
            told += s
            continue
        size[k] += n.as_py()
        sums[k, np.frombuffer(terms.as_buffer(), np.int32)] += s
        v, d = pickle.loads(rest.as_py())
        votes[k] += v
        drawn[k] = sorted(drawn[k] + d, key=lambda x: x[0])[:picks]
    shared.destroy()
    return size, sums, votes, told, drawn


def _unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-9)


def _begin(tree: Tree, node: int, drawn: list, width: int) -> list[list]:
    """Split ``node`` between two of its drawn members, unlike one another; the drawn members of each side."""
    dense = [np.bincount(i, weights=v, minlength=width) for _, i, v in drawn]
    two = sorted(dense[1:], key=lambda x: float(x @ dense[0]))[(len(dense) - 1) // 4]
    tree.split(node, dense[0] - two)
    first = [float(x @ tree.way[node]) > 0 for x in dense]
    return [[d for d, f in zip(drawn, first) if f == side] for side in (True, False)]


def bisect(corpus: Corpus, leaves: int, min_size: int = 8, rounds: int = 3, tries: int = 5, picks: int = 18) -> Tree:
    """Bisecting k-means over all vectors: in every round the loosest leaves are split at once, each split by passes over all of its members.

    While there is room, both sides of a split are split in the same passes. A split that sets apart fewer than ``min_size`` members is
    begun again with other members.
    """
    width = len(corpus.words)
    tree = Tree()
    loose = lambda n, s: n - float(np.linalg.norm(s))
    size, sums, _, _, drawn = _sweep(corpus, tree, [0], picks=picks)
    open_ = {0: (size[0], loose(size[0], sums[0]), drawn[0])}
    total = 1
    tried: Counter[int] = Counter()
    while total < leaves:
        able = sorted((k for k, (n, _, d) in open_.items() if n >= 2 * min_size and tried[k] < tries and len(d) > tried[k] + 1), key=lambda k: -open_[k][1])
        able = [k for k in able[: leaves - total] if open_[k][1] >= open_[able[0]][1] / 8]
        if not able:
            break
        deep = leaves - total >= 3 * len(able)
        begun: list[int] = []  # a node before those below it
        for k in able:
            sides = _begin(tree, k, open_.pop(k)[2][tried[k] :], width)
            begun.append(k)
            for c, side in zip((tree.child[k], tree.child[k] + 1), sides):
                if deep and len(side) > 1:
                    _begin(tree, c, side, width)
                    begun.append(c)
        fresh = [c for k in begun for c in (tree.child[k], tree.child[k] + 1) if tree.child[c] < 0]
        for r in range(rounds):
            size, sums, _, _, drawn = _sweep(corpus, tree, fresh, picks=picks * (r == rounds - 1))
            of = dict(zip(fresh, zip(size, sums, drawn)))
            for k in reversed(begun):
                a, b = of[tree.child[k]], of[tree.child[k] + 1]
                of[k] = a[0] + b[0], a[1] + b[1], sorted(a[2] + b[2], key=lambda x: x[0])[:picks]
                if r < rounds - 1:
                    if a[0] and b[0]:
                        tree.way[k] = _unit(a[1]) - _unit(b[1])
                elif min(a[0], b[0]) < min_size:
                    tree.child[k] = -1
                    tried[k] += 1
        for k in able:
            below = _leaves(tree, k)
            total += len(below) - 1
            for x in below:
                open_[x] = of[x][0], loose(*of[x][:2]), of[x][2]
    return tree


def _leaves(tree: Tree, root: int = 0) -> list[int]:
    out, todo = [], [root]
    while todo:
        k = todo.pop()
        if tree.child[k] < 0:
            out.append(k)
        else:
            todo += [tree.child[k] + 1, tree.child[k]]
    return out


def fit(sample: Corpus, subjects: list[str], leaves: int = LEAVES) -> Model:
    """Leaves, their terms and their subjects, from all texts."""
    model = Model(subjects=sorted(subjects))
    texts, vocabulary = sample.texts, sample.words
    if not vocabulary:
        return model
    tree = bisect(sample, leaves)
    # how often each term stands in the texts of each leaf
    size, stands, votes, with_label, _ = _sweep(sample, tree, _leaves(tree), model.subjects)
    count = len(size)
    base = votes.sum(axis=0) + 1.0
    # a leaf's subjects: its labelled texts, against how common each subject is
    lean = (votes + 0.2) / base
    lean /= lean.sum(axis=1, keepdims=True)
    # texts without a subject have few labels, and wrong ones: a leaf of such texts has no name
    named = votes.sum(axis=1) >= np.maximum(2, 0.3 * size * votes.sum() / max(1, texts))
    everywhere = (stands.sum(axis=0) + 0.02) / (texts + 0.2)
    for k in range(count):
        odds = np.log((stands[k] + 0.02) / (size[k] + 0.2) / everywhere)
        strength = np.where(stands[k] >= 3, odds * np.sqrt(stands[k]), 0.0)
        best = np.argsort(-strength)[:12]
        model.leaves.append((k, model.subjects[int(np.argmax(lean[k]))] if named[k] else None, int(size[k]), [vocabulary[t] for t in best if strength[t] > 0]))
    # how much of a term stands in each leaf: leaves are weighed so that each subject counts as if all were equally large, and
    # the common words of a large one speak for none; leaves without a name (bare notices and the like) count against a term
    mass = (size * named) @ lean
    even = named * (lean @ np.where(mass > 0, mass.sum() / len(model.subjects) / np.maximum(mass, 1e-9), 0.0))
    belongs = stands * even[:, None]
    belongs /= np.maximum(belongs.sum(axis=0) + (stands * ~named[:, None]).sum(axis=0), 1e-9)[None, :]
    # discriminative terms: their leaves agree on a subject, beyond what few texts share by chance
    best = (belongs.T @ lean).max(axis=1)
    least_share = max(PURE, 1.3 / max(1, len(model.subjects)))  # of few subjects an even share is large by itself
    # words of notices stand in texts that bear no label, even where those share a leaf with others
    seen = stands.sum(axis=0)
    told = with_label + 0.5 >= 0.3 * votes.sum() / texts * seen
    picked = np.flatnonzero(told & (best - 0.5 / np.sqrt(np.maximum(seen, 1.0)) >= least_share))
    model.terms = {vocabulary[t]: k for k, t in enumerate(picked)}
    model.belongs = belongs.T[picked].astype(np.float32)
    # a leaf's mixed texts blur its subjects: squares bring out those that it is about
    model.lean = lean**2 / (lean**2).sum(axis=1, keepdims=True)
    return model


def leaf_mixture(text: str | None, model: Model) -> tuple[np.ndarray, int]:
    """(share of the text by leaf, characters of the sentences that belong to any). Null and empty texts give zeros."""
    out = np.zeros(model.belongs.shape[1])
    rows: list[int] = []
    weights: list[float] = []
    total = 0
    get = model.terms.get
    for sentence in _SENTENCE.split(text or ""):
        hits = [h for h in map(get, _WORD.findall(sentence.lower())) if h is not None]
        if hits:
            rows += hits
            weights += [len(sentence) / len(hits)] * len(hits)
            total += len(sentence)
    if total:
        out = np.array(weights, dtype=np.float32) @ model.belongs[rows]
        out = out / out.sum()
    return out, total


def mixture(text: str | None, model: Model) -> tuple[np.ndarray, int]:
    """(share of the text by subject, characters that speak for any): the subjects of the document's leaves by their shares."""
    leaves, total = leaf_mixture(text, model)
    return (leaves @ model.lean if total else np.zeros(len(model.subjects))), total


_OUT = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("share", pa.float64())])


def assign(documents: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, subject, share) of every subject with at least ``min_share`` of a document's text.

    The same shares as ``mixture``: each term's leaves are summed to subjects once, not in every document.
    """
    parts = np.column_stack((model.belongs.astype(float) @ model.lean if model.terms else np.zeros((0, len(model.subjects))), model.belongs.sum(axis=1, dtype=float)))
    shared = documents.sparkSession.sparkContext.broadcast((model.terms, parts, model.subjects))  # one entry per term of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, parts, subjects = shared.value
        codes = _Codes(terms.get)
        for batch in batches:
            ids, starts, rows, weights, hits = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not text:
                    continue
                begin = len(rows)
                for sentence in _SENTENCE.split(text):
                    if own := codes.of(sentence):
                        rows += own
                        weights.append(len(sentence) / len(own))
                        hits.append(len(own))
                if len(rows) > begin:
                    ids.append(i)
                    starts.append(begin)
            if ids:
                mix = np.add.reduceat(parts[rows] * np.repeat(weights, hits)[:, None], starts)
                doc, subject = np.nonzero(mix[:, :-1] >= min_share * mix[:, -1:])
                share = mix[doc, subject] / mix[doc, -1]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array([subjects[s] for s in subject], pa.string()), pa.array(share, pa.float64())], schema=_OUT)

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, subject string, share double")


def leaf_table(model: Model) -> list[tuple[int, str | None, int, list[str]]]:
    """(leaf, subject, size, terms) of the fitted leaves."""
    return model.leaves
