"""Filling fixed-capacity containers with items of varying length (problem 7).

1. Every text is measured in tokens; one longer than the capacity is cut into full pieces and a rest.
2. The *global histogram* of piece lengths (at most ``capacity`` numbers) is aggregated over all texts.
3. *Dynamic programming* over the histogram chooses ``max_buckets`` length buckets with the
   least padding (each piece counts as long as its bucket's upper end); the number is well below that of the lengths, so it always decides.
4. *Token-budget batches*: a container takes a batch of pieces of one bucket as long as its budget lasts, and the room that
   is left over goes to batches of the longest buckets that still fit: batches never cross buckets, containers hold several.
   (One bucket for each container would leave up to half of it unused where a piece is just over half the capacity.) The plan is made of a few
   recipes (so many pieces of these buckets, so many times), at most twice as many as buckets: it is computed
   from the histogram alone, whatever the number of texts.
5. A piece's container follows from its rank in its bucket: ranks are counted in salted parts of
   each bucket and offset by the parts' sizes, so a bucket with a third of all pieces is never one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import spread, stage

__all__ = ["Plan", "choose_buckets", "count_tokens", "pack", "plan_containers"]

#: Pattern that splits text before the merges of the rank files, as their publisher states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_BUCKETS = 384
#: Pieces that one salted part of a bucket should hold.
PART_ROWS = 1_000_000


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every text that is not null; the vocabulary's bytes (about 1 MB) go along with the tasks."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if t is None else len(_encode(encode, t)) for t in texts], pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint").where("doc_id is not null and n_tokens is not null")


def _encode(encode, text: str) -> list[int]:
    try:
        return encode(text)
    except UnicodeEncodeError:  # half a surrogate pair
        return encode(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def choose_buckets(histogram: np.ndarray, max_buckets: int = MAX_BUCKETS) -> np.ndarray:
    """Upper ends of ``max_buckets`` length buckets (or one for each length, if those are no more) with the least total padding.

    ``histogram[n]`` is the number of pieces of length n. Exact: the padding is a concave Monge cost, so for a price per bucket the best
    partition follows in linear time; bisection finds the price at which the number of buckets passes ``max_buckets``, and the two best
    partitions there, one with fewer and one with more, are joined where an interval of the one holds one of the other.
    """
    lengths = np.flatnonzero(histogram)
    if len(lengths) <= max_buckets:
        return lengths
    count = histogram[lengths].astype(np.float64)
    c = np.concatenate(([0.0], np.cumsum(count)))
    s = np.concatenate(([0.0], np.cumsum(count * lengths)))
    n = len(lengths)

    def cut(price: float) -> list[int]:
        # f[i] = min over j < i of f[j] + U[i] (C[i] - C[j]) - (S[i] - S[j]) + price: lines in U, lower hull
        f = np.zeros(n + 1)
        back = np.zeros(n + 1, dtype=np.int64)
        hull: list[int] = [0]
        head = 0
        value = lambda j, u: f[j] + s[j] - u * c[j]
        for i in range(1, n + 1):
            u = float(lengths[i - 1])
            while head + 1 < len(hull) and value(hull[head + 1], u) <= value(hull[head], u):
                head += 1
            j = hull[head]
            f[i] = value(j, u) + u * c[i] - s[i] + price
            back[i] = j
            while len(hull) - head >= 2:
                a, b = hull[-2], hull[-1]
                # the line of b is nowhere lowest between those of a and i
                if (f[i] + s[i] - f[a] - s[a]) * (c[b] - c[a]) <= (f[b] + s[b] - f[a] - s[a]) * (c[i] - c[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
        ends = []
        i = n
        while i > 0:
            ends.append(i)
            i = back[i]
        return ends[::-1]

    low, high = 0.0, float(lengths[-1]) * float(count.sum()) + 1.0
    fewer, more = [n], list(range(1, n + 1))
    for _ in range(100):
        mid = (low + high) / 2
        ends = cut(mid)
        if len(ends) > max_buckets:
            low, more = mid, ends
        else:
            fewer, high = ends, mid
        if len(fewer) == max_buckets:
            break
    if len(fewer) < max_buckets:
        p, q = [0, *fewer], [0, *more]
        ahead = len(more) - max_buckets
        for x in range(len(fewer)):
            y = x + ahead
            if p[x] <= q[y] and q[y + 1] <= p[x + 1]:
                fewer = [*p[1 : x + 1], *q[y + 1 :]]
                break
    return lengths[np.array(fewer) - 1]


@dataclass
class Plan:
    """Slots of each bucket, in order of rank: ``start`` (first rank), ``first`` (container), ``each`` (pieces for a container)."""

    uppers: np.ndarray
    slots: list[list[tuple[int, int, int]]]
    containers: int


def plan_containers(uppers: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Recipes by the longest bucket first: each is used as often as its scarcest bucket allows."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(len(uppers), dtype=np.int64)
    slots: list[list[tuple[int, int, int]]] = [[] for _ in uppers]
    container = 0
    top = len(uppers) - 1
    while top >= 0:
        if left[top] == 0:
            top -= 1
            continue
        room = capacity
        recipe: list[tuple[int, int]] = []
        b = top
        while b >= 0 and room >= uppers[0]:
            b = min(b, int(np.searchsorted(uppers, room, side="right")) - 1)
            while b >= 0 and left[b] == 0:
                b -= 1
            if b < 0:
                break
            k = int(min(room // uppers[b], left[b]))
            if k:
                recipe.append((b, k))
                room -= k * int(uppers[b])
            b -= 1
        times = int(min(left[b] // k for b, k in recipe))
        for b, k in recipe:
            slots[b].append((int(used[b]), container, k))
            used[b] += k * times
            left[b] -= k * times
        container += times
    return Plan(uppers, slots, container)


_PACKED = "container_kind string, capacity int, doc_id bigint, piece int, first_token bigint, n_tokens int, container bigint"


def pack(tokens: DataFrame, kinds: list[tuple[str, int]], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, first_token, n_tokens, container): where every piece of every text goes.

    ``tokens``: (doc_id, n_tokens); ``kinds``: (name, capacity). Texts without tokens have no piece. A text is cut
    only if it is longer than the capacity: into full pieces, which fill a container each, and a rest. Rows that share
    a doc_id are packed as texts of their own.
    """
    spark = tokens.sparkSession
    tokens = stage(tokens, "tokens")
    out = None
    for name, capacity in kinds:
        capacity = int(capacity)
        n = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
        pieces = (
            tokens.where("n_tokens > 0")
            .select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
            .select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).cast("int").alias("n"))
        )
        histogram = np.zeros(capacity + 1, dtype=np.int64)
        for row in pieces.groupBy("n").count().collect():  # at most ``capacity`` rows
            histogram[row["n"]] = row["count"]
        uppers = choose_buckets(histogram, max_buckets)
        if not len(uppers):
            continue
        bucket_of = np.searchsorted(uppers, np.arange(capacity + 1))
        counts = np.bincount(bucket_of[1:][: uppers[-1]], weights=histogram[1 : uppers[-1] + 1], minlength=len(uppers)).astype(np.int64)
        plan = plan_containers(uppers, counts, capacity)
        parts = max(16, int(counts.max() // PART_ROWS) + 1)
        bucket = _bucket_column(uppers)
        marked = pieces.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
        sizes = marked.groupBy("bucket", "part").count()
        before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "part", "before")
        in_part = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "piece")) - 1
        # at most buckets x parts rows
        ranked = marked.withColumn("r", in_part).join(F.broadcast(before) if parts <= 256 else before, ["bucket", "part"]).withColumn("rank", F.col("r") + F.col("before"))
        shared = spark.sparkContext.broadcast([tuple(np.array(x, dtype=np.int64) for x in zip(*s)) if s else None for s in plan.slots])
        where = _container_udf(shared)
        one = ranked.select(F.lit(name).alias("container_kind"), F.lit(capacity).alias("capacity"), "doc_id", "piece", "first_token", F.col("n").alias("n_tokens"), where("bucket", "rank").alias("container"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], _PACKED)


def _bucket_column(uppers: np.ndarray):
    """Index of the first bucket whose upper end is not below the length."""
    table = np.searchsorted(uppers, np.arange(int(uppers[-1]) + 1))

    @F.pandas_udf("int")
    def bucket(n):  # noqa: ANN001
        import pandas as pd

        return pd.Series(table[n.to_numpy()].astype(np.int32))

    return bucket("n")


def _container_udf(shared):
    @F.pandas_udf("bigint")
    def where(bucket, rank):  # noqa: ANN001
        import pandas as pd

        b, r = bucket.to_numpy(), rank.to_numpy()
        out = np.zeros(len(b), dtype=np.int64)
        for k in np.unique(b):
            start, first, each = shared.value[k]
            own = np.flatnonzero(b == k)
            at = np.searchsorted(start, r[own], side="right") - 1
            out[own] = first[at] + (r[own] - start[at]) // each[at]
        return pd.Series(out)

    return where
