"""Near-duplicate records (problem 5): exact set-similarity self-join.

Records are sets of hashed word shingles. The join is exact for the Jaccard
similarity ``t``: no link is lost, whatever order or tile size is used.

1. Exact copies (equal sets) are folded into one representative first.
2. Every record sends only the rarest part of its set (the *prefix*: what it has
   beyond the overlap that a partner needs) to the *tile* of each such shingle.
   Rarity comes from counts over all records in a table of buckets whose number follows the
   data; any order keeps the join exact, a good one keeps tiles small. A shingle whose count says
   that its tile could hold more than ``TILE_ROWS`` is spread over tiles by size band and block.
3. In a tile, records are sorted by size; sizes and positions bound the overlap.
4. Candidate pairs meet in tiles of record blocks, ``BLOCK_ROWS`` records each, with the records' *hashed bitmap
   signatures*: bits set in one and not in the other bound the overlap from above;
   only pairs that pass have their sorted arrays intersected. The number of blocks follows the records, so a tile never
   grows; a signature goes only to the tiles in which its record has pairs.

Only hashes are shuffled: no text, no link or component ever reaches the driver, which sees the rarity table alone (4 bytes a bucket,
64 MB at most). Representatives of copies return by joins of checked size or salted ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import broadcast_if_small, hot_join, spread, stage

__all__ = ["candidate_pairs", "classes", "expand_pairs", "shingle_columns", "shingle_hashes", "shingle_table", "similar_pairs", "verified_pairs"]

_WORD = re.compile(r"[^\W_]+")
#: Entries of the rarity table: a power of two, about one for 16 shingles of all records, within these bounds.
BUCKETS_LEAST, BUCKETS_MOST = 1 << 18, 1 << 24
#: Rows that one tile may hold before it is split.
TILE_ROWS = 20_000
#: Records of a block in the signature tiles.
BLOCK_ROWS = 32_768
#: Up to so many blocks, signatures go to all tiles of their block; beyond, only to those in which their record has pairs.
FEW_BLOCKS = 4


def shingle_hashes(lines: list[str], words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the runs of ``words`` successive words; a run stays within one line."""
    grams: set[str] = set()
    for line in lines:
        w = _WORD.findall(line.lower())
        if words == 3:
            grams.update(map(" ".join, zip(w, w[1:], w[2:])))
        else:
            grams.update(map(" ".join, zip(*(w[k:] for k in range(words)))))
    digest = xxhash.xxh3_64_intdigest
    out = np.fromiter((digest(g.encode("utf-8", "surrogatepass")) for g in grams), dtype=np.uint64, count=len(grams)).view(np.int64)
    out.sort()
    return out


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of the tokens' hashes: a power of two of at least 1.5 bits for each token, 512 at least, 8192 at most."""
    bits = min(8192, max(512, 1 << math.ceil(math.log2(max(1, 1.5 * len(tokens))))))
    pos = (tokens.view(np.uint64) >> np.uint64(7)) & np.uint64(bits - 1)
    mask = np.zeros(bits, dtype=np.uint8)
    mask[pos.astype(np.int64)] = 1
    return np.packbits(mask, bitorder="little").tobytes()


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("whole", pa.int64()), ("tokens", pa.list_(pa.int64()))])
_SETS_SQL = "id bigint, n int, whole bigint, tokens array<bigint>"


def _shingles(lines: list[str], words: int) -> tuple[int, int, np.ndarray] | None:
    tokens = shingle_hashes(lines, words)
    return (len(tokens), xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63), tokens) if len(tokens) else None


def shingle_columns(words: int):
    """(columns in SQL, their types, function of a record's lines): n, whole and tokens for a pass that also does other work; None without any shingle."""
    return "n int, whole bigint, tokens array<bigint>", [pa.int32(), pa.int64(), pa.list_(pa.int64())], lambda lines: _shingles(lines, words)


def shingle_table(records: DataFrame, lines_of, words: int) -> DataFrame:
    """(id, n, whole, tokens): one row for each record with any shingle; ``whole`` is the set's hash.

    ``records``: the id and then the columns that ``lines_of`` takes. Null ids and records
    without a run of ``words`` words give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if i is not None and (own := _shingles(lines_of(*rest), words)):
                    rows.append((i, *own))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SETS)], schema=_SETS)

    return spread(records).mapInArrow(run, _SETS_SQL)


def _need(n_small, n_large, t: float):
    """Least overlap of two sets of these sizes at similarity ``t``."""
    return np.ceil(t / (1 + t) * (n_small + n_large) - 1e-9)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens.view(np.uint64) >> np.uint64(40)) & np.uint64(buckets - 1)).astype(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """Number of records by bucket of shingles, over all records; counted in the JVM with partial aggregates."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = min(BUCKETS_MOST, max(BUCKETS_LEAST, 1 << math.ceil(math.log2(max(1, total / 16)))))
    bucket = F.shiftrightunsigned(F.col("token"), 40).bitwiseAND(F.lit(buckets - 1)).cast("int")
    counted = sets.select(F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket")).agg(F.count("*").cast("int").alias("records")).toArrow()
    out = np.zeros(buckets, dtype=np.int32)
    out[counted["bucket"].to_numpy()] = counted["records"].to_numpy()
    return out


_POSTS = pa.schema([("token", pa.int64()), ("tile", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidate_pairs(sets: DataFrame, t: float, counts: np.ndarray | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b) with repeats, a < b: every pair of records with similarity of at least ``t`` is among them.

    ``sets``: (id, n, tokens) of different sets.
    """
    counts = rarity(sets) if counts is None else counts
    room = tile_rows  # a tile's rows never exceed its bucket's count
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # BUCKETS_MOST numbers at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in _POSTS]
            ids, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for k in range(len(ids)):
                tokens = flat[offsets[k] : offsets[k + 1]]
                n = int(ns[k])
                size = n - math.ceil(t * n - 1e-9) + 1
                own = load[_bucket(tokens, len(load))]
                order = np.lexsort((tokens, own))[:size]
                chosen, own = tokens[order], own[order]
                pos = np.arange(len(chosen), dtype=np.int32)
                big = own > room
                small = ~big
                m = int(small.sum())
                if m:
                    for c, v in zip(out, (chosen[small], np.zeros(m, np.int32), np.full(m, ids[k]), np.full(m, n, np.int32), pos[small])):
                        c.append(v)
                if big.any():
                    # size bands of ratio t, and blocks within them: a record stands in the tiles of its
                    # block with every block of its own band and of the next smaller one
                    band = int(math.log(n) / -math.log(t))
                    for token, load_of, p in zip(chosen[big], own[big], pos[big]):
                        blocks = -(-int(load_of) // room)
                        block = int(ids[k]) % blocks
                        tiles = set()
                        for other in range(blocks):
                            tiles.add(_tile(band, band, min(block, other), max(block, other)))
                            tiles.add(_tile(band, band + 1, block, other))
                            tiles.add(_tile(band - 1, band, other, block))
                        for tile in tiles:
                            for c, v in zip(out, (np.array([token]), np.array([tile], np.int32), np.array([ids[k]]), np.array([n], np.int32), np.array([p], np.int32))):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), f.type) for c, f in zip(out, _POSTS)], schema=_POSTS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            # the last tile may go on in the next batch
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            starts = np.flatnonzero(new)
            cut = int(starts[-1]) + 1 if len(starts) else 0
            if cut:
                yield from _meet([c[:cut] for c in cols], t)
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield from _meet(held, t)

    posts = sets.select("id", "n", "tokens").mapInArrow(post, "token bigint, tile int, id bigint, n int, pos int")
    sorted_posts = posts.repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "id")
    return sorted_posts.mapInArrow(meet, "a bigint, b bigint")


def _tile(low: int, high: int, i: int, j: int) -> int:
    return int(xxhash.xxh32_intdigest(f"{low},{high},{i},{j}")) & 0x7FFFFFFF | 1


def _meet(cols: list[np.ndarray], t: float) -> Iterator[pa.RecordBatch]:
    """Pairs within tiles of rows sorted by (token, tile, n): sizes and positions bound the overlap."""
    token, tile, ids, n, pos = cols
    rows = len(token)
    live = np.arange(rows - 1)
    step = 1
    a_out, b_out = [], []
    held = 0
    while len(live):
        live = live[live + step < rows]
        other = live + step
        same = (token[live] == token[other]) & (tile[live] == tile[other]) & (n[live] >= t * n[other] - 1e-9)  # sorted by n: beyond this, none
        live, other = live[same], other[same]
        if not len(live):
            break
        need = _need(n[live], n[other], t)
        room = np.minimum(n[live] - pos[live], n[other] - pos[other])
        # were this the first common shingle in the order, no more than ``room`` could follow
        ok = (room >= need) & (ids[live] != ids[other])
        if ok.any():
            x, y = ids[live[ok]], ids[other[ok]]
            a_out.append(np.minimum(x, y))
            b_out.append(np.maximum(x, y))
            held += len(x)
            if held > 1_000_000:
                yield _pair_batch(a_out, b_out)
                a_out, b_out, held = [], [], 0
        step += 1
    if a_out:
        yield _pair_batch(a_out, b_out)


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, _different(np.concatenate(a), np.concatenate(b)))), schema=_PAIRS)


_bits = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint16)


def _outside(x: bytes, y: bytes) -> int:
    """Bits of the larger-sized bitmap, folded to the other's size, that the other lacks (0 where folding hides them)."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        return int(_bits[np.bitwise_or.reduce(a.reshape(-1, len(b)), axis=0) & ~b].sum())
    if len(b) > len(a):
        b = np.bitwise_or.reduce(b.reshape(-1, len(a)), axis=0)
    return int(_bits[a & ~b].sum())


def verified_pairs(candidates: DataFrame, sets: DataFrame, t: float, blocks: int | None = None, few: int = FEW_BLOCKS) -> DataFrame:
    """(a, b, shared, n_a, n_b) of the candidate pairs with similarity of at least ``t``.

    Pairs and signatures meet in tiles of record blocks; what the bitmaps leave is intersected exactly. ``blocks``: as
    many as the records need. ``few``: see ``FEW_BLOCKS``; both ways give the same rows.
    """
    if blocks is None:
        blocks = max(1, math.ceil(sets.count() / BLOCK_ROWS))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            sigs = [signature(flat[offsets[k] : offsets[k + 1]]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], ["id", "n", "sig"])

    def screen(key, pairs: pa.Table, sigs: pa.Table) -> pa.Table:
        ids = sigs.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        n = sigs.column("n").to_numpy()[order]
        maps = sigs.column("sig").to_pylist()
        a, b = _different(pairs.column("a").to_numpy(), pairs.column("b").to_numpy())
        ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
        keep = np.zeros(len(a), dtype=bool)
        need = _need(n[ia], n[ib], t)
        width = np.fromiter((len(m) for m in maps), dtype=np.int64, count=len(maps))[order] if maps else np.zeros(0, np.int64)
        # pairs of equal width at once, others one by one
        for w in np.unique(width):
            same = np.flatnonzero((width[ia] == w) & (width[ib] == w))
            if not len(same):
                continue
            at = np.full(len(ids), -1, dtype=np.int64)
            mine = np.flatnonzero(width == w)
            at[mine] = np.arange(len(mine))
            bits = np.frombuffer(b"".join(maps[order[k]] for k in mine), dtype=np.uint64).reshape(len(mine), -1)
            for lo in range(0, len(same), 65_536):
                part = same[lo : lo + 65_536]
                x, y = bits[at[ia[part]]], bits[at[ib[part]]]
                most = np.minimum(n[ia[part]] - np.bitwise_count(x & ~y).sum(axis=1), n[ib[part]] - np.bitwise_count(y & ~x).sum(axis=1))
                keep[part] = most >= need[part]
        for k in np.flatnonzero(width[ia] != width[ib]):
            x, y = maps[order[ia[k]]], maps[order[ib[k]]]
            keep[k] = min(n[ia[k]] - _outside(x, y), n[ib[k]] - _outside(y, x)) >= need[k]
        return pa.table({"a": a[keep], "b": b[keep]})

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pairs = candidates.select("a", "b", F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"))
    signed = sets.select("id", "n", "tokens").mapInArrow(sign, "id bigint, n int, sig binary").withColumn("k", block("id"))
    if blocks <= few:
        tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("k"), o).alias("i"), F.greatest(F.col("k"), o).alias("j")))
        spread = signed.select("id", "n", "sig", F.explode(tiles).alias("t")).select("id", "n", "sig", F.col("t.i").alias("to_i"), F.col("t.j").alias("to_j"))
    else:
        pairs = stage(pairs.distinct(), "pairs")
        # columns of their own: a cogroup of two tables with the same ones is refused as ambiguous
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.col("i").alias("to_i"), F.col("j").alias("to_j")).distinct()
        spread = asked.join(signed.select("id", "n", "sig"), "id")
    passed = stage(pairs.groupBy("i", "j").cogroup(spread.groupBy("to_i", "to_j")).applyInArrow(screen, "a bigint, b bigint"), "passed")
    # only the arrays of records in some passed pair are moved
    ids = passed.select(F.col("a").alias("id")).union(passed.select(F.col("b").alias("id"))).distinct()
    arrays = sets.select("id", "n", "tokens").join(broadcast_if_small(ids, 500_000), "id", "left_semi")
    left = arrays.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("x"))
    right = arrays.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("y"))
    both = passed.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(F.col("shared") >= F.lit(t) * (F.col("n_a") + F.col("n_b") - F.col("shared")) - F.lit(1e-9))


def similar_pairs(table: DataFrame, t: float, folded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs between representatives, membership): the whole job, as pairs (a, b, shared, n_a, n_b)
    of different sets and (id, rep) for every record.

    ``table``: as from ``shingle_table``.
    """
    table = table if folded else stage(table, "sets")
    members = table.select("id", "whole", "n").distinct()
    # only sets that several records have; one that a third of all records share is joined in salted parts
    reps = members.groupBy("whole", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = stage(hot_join(members, reps, ["whole", "n"], "id").where("id != rep").select("id", "rep"), "copies")
    sets = table.join(broadcast_if_small(copies.select("id"), 200_000), "id", "left_anti") if copies.limit(1).count() else table
    pairs = verified_pairs(candidate_pairs(sets, t), sets, t)
    member_of = copies.unionByName(sets.select("id", F.col("id").alias("rep")))
    return pairs, member_of


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, rep, links): every record with its class of equal sets and the number of classes that are similar to it; from ``similar_pairs``."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return hot_join(members, links, ["rep"], "id", how="left").select("id", "rep", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def expand_pairs(pairs: DataFrame, members: DataFrame, whole_groups: int = 64) -> DataFrame:
    """(page_a, page_b), a < b: links between representatives written out for their copies.

    A group of up to ``whole_groups`` copies stands in full, with the links among its copies; a larger one
    is given by its representative: every copy is linked with it, and it is linked with the
    members of similar groups, so no link between different texts is lost.
    """
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    many = size.where("copies > 1")
    in_groups = hot_join(members, many, ["rep"], "id")
    small = in_groups.where(F.col("copies") <= whole_groups)
    inner = small.alias("x").join(small.alias("y"), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
    star = in_groups.where((F.col("copies") > whole_groups) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("p"), F.col("id").alias("q"))
    # copies that stand for a representative in links with others
    stand = in_groups.where((F.col("copies") <= whole_groups) | (F.col("id") == F.col("rep"))).select("rep", "id")
    stand = stage(stand, "stand")
    out = pairs.select("a", "b")
    for side, other in (("a", "b"), ("b", "a")):
        out = hot_join(out, stand.select(F.col("rep").alias(side), F.col("id").alias(f"{side}_id")), [side], other, 200_000, how="left").withColumn(side, F.coalesce(f"{side}_id", side)).drop(f"{side}_id")
    both = out.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(inner).unionByName(star)
    return both.select(F.least("p", "q").alias("page_a"), F.greatest("p", "q").alias("page_b"))
