"""Operator 6. Near-duplicates by SimHash: all pairs of fingerprints within a radius, with pivots for families.

A document's 128-bit fingerprint is the bitwise majority over the hashes of its
distinct normalised words. Documents with equal fingerprints are one point.
Points within RADIUS of each other are linked, none is missed; links join
documents into groups; the smallest id of a group is the one that stays.

Points are cut into cells by hash; each pair of cells is a task, in three steps.
Neighbours in several orders of permuted bits are linked, which finds most of
each group (planned() and RECALL set how many orders; this step saves time and
decides nothing). Large families of linked points are then compared tile by tile
with the points that are not linked to them: one point of the family is its
pivot, and a point whose distance to the pivot differs by more than RADIUS from
that of the whole tile is near none of it (triangle inequality). The rest is
joined by an index: of k disjoint blocks of bits, two points within RADIUS differ
by few bits in one at least (pigeonhole, probes()), so each point looks up the
keys near its own in each block, and the distances of what it meets are computed.
A distance is two XORs and two bit counts.

Of the links only a spanning forest is passed on, which leaves the groups unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from stepwright.llm.common import free_names, give_back, hash_strings, map_batches, mix64, remove_written, sized, tables_written, written

BITS = 128
RADIUS = 18
#: Pairs at the radius that share a block of the first step; all others are found by the next steps.
RECALL = 0.93
#: Characters that are cut from the ends of words.
EDGES = ".,;:!?\"'()[]{}<>#$%&*-_/|=+~^`"
#: Bits of a block at least, and unrelated points of a block on average, from which blocks get wider.
LEAST_WIDTH = 8
BLOCK_POINTS = 2048
#: Points that are compared with others at once, and the others of one step.
TILE = 256
ACROSS = 8192
#: Linked points from which a family has a pivot and tiles of its own; the square root of a task's points if that is more.
FAMILY = 32
#: Points that one task compares with each other; tables with more are cut into cells, of half as many each. Large tables have larger tasks, up to MOST points.
CELL = 65_536
MOST = 2_097_152
#: Bits of an index's block at most, pairs that the index looks at in one step, and links that are held before they are joined.
WIDEST = 22
PAIRS = 1 << 18
#: Times of a lookup, of a pair that it meets, and of an index's calls, as multiples of the time of a pair of two tiles.
LOOKUP, MET, CALLS = 7, 9, 5_000_000
SEED = 20_240_229


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 16 bytes, words of each): the majority bits over the hashes of a text's distinct words."""
    n = len(texts)
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    offsets = np.asarray(words.offsets, dtype=np.int64)
    offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
    coded = words.flatten().dictionary_encode()
    book = pc.utf8_trim(coded.dictionary, characters=EDGES)
    hashes = hash_strings(book)
    hashes[np.asarray(pc.equal(book, ""), dtype=bool)] = 0  # no word
    h = hashes[np.asarray(coded.indices)]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    kept = h != 0
    h, doc = h[kept], doc[kept]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[first], doc[first]
    count = np.bincount(doc, minlength=n)
    lanes = np.stack([mix64(h + np.uint64(0x9E3779B97F4A7C15)), mix64(h ^ np.uint64(0xD1B54A32D192ED03))], axis=1)
    lanes = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, BITS // 8)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
    out = np.zeros((n, BITS // 8), np.uint8)
    starts = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        local = (doc[starts[lo] : starts[hi]] - lo) * 256
        for j in range(BITS // 8):
            histogram = np.bincount(local + lanes[starts[lo] : starts[hi], j], minlength=(hi - lo) * 256).reshape(-1, 256)
            out[lo:hi, j] = np.packbits((histogram @ table) * 2 > count[lo:hi, None], axis=1)[:, 0]
    return out, count


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (the text's, see text_key()), hi, lo (the fingerprint's halves) of each row that has an id and at least one word."""

    def make():
        def kernel(batch: pa.RecordBatch):
            bits, count = fingerprints(batch.column(2))
            halves = bits.view(np.int64).reshape(-1, 2)
            some = pa.array(count > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "key", "hi", "lo"]).filter(some)

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return map_batches(chosen, make, f"doc_id {kind}, key long, hi long, lo long", "text")


def text_key(text_col: str) -> Column:
    """Tells the texts of rows that repeat an id from each other."""
    return F.xxhash64(F.col(text_col).cast("string"))


def planned(points: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(block width, tables) of the first step: blocks hold BLOCK_POINTS unrelated points on average at most; a pair at the radius shares one with at least this recall."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(points, 2) / BLOCK_POINTS)))
    blocks = BITS // width
    total = math.comb(BITS, radius)

    def miss(n: int) -> float:
        """Chance that none of n disjoint blocks is free of the radius's differing bits (inclusion and exclusion)."""
        return max(0.0, 1 - sum((-1) ** (j + 1) * math.comb(n, j) * math.comb(BITS - j * width, radius) / total for j in range(1, n + 1) if BITS - j * width >= radius))

    one = max(miss(blocks), 1e-12)
    full = max(0, math.floor(math.log(1 - recall) / math.log(one))) if one < 1 else 0
    rest = next((n for n in range(blocks + 1) if one**full * miss(n) <= 1 - recall), blocks)
    return width, full * blocks + rest


def permutations(n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS) for _ in range(n)])


def blocks_of(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """(points x tables) keys: the bits of disjoint blocks of as many permutations as needed, with the table's number above them."""
    flat = np.unpackbits(bits, axis=1)
    each = BITS // width
    keys = np.zeros((len(bits), tables), np.int64)
    value = (1 << np.arange(width, dtype=np.int64))[::-1]
    for p, perm in enumerate(permutations(-(-tables // each))):
        n = min(each, tables - p * each)
        keys[:, p * each : p * each + n] = flat[:, perm[: n * width]].reshape(len(bits), n, width) @ value
    return keys | (np.arange(tables, dtype=np.int64) << width)


def distances(points: np.ndarray, pivot: int) -> np.ndarray:
    """A column of the pivot table: Hamming distances (uint8) of all points (n x 2 uint64) to one of them."""
    return np.bitwise_count(points[:, 0] ^ points[pivot, 0]) + np.bitwise_count(points[:, 1] ^ points[pivot, 1])


def possible(table: list[np.ndarray], tile: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """Those others whose coordinates are within the radius of the tile's range in every column: the rest are near none of it."""
    for column in table:
        if not len(others):
            break
        low, high = int(column[tile].min()) - radius, int(column[tile].max()) + radius
        at = column[others]
        others = others[(at >= max(low, 0)) & (at <= min(high, 255))]
    return others


def near(tile: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of tile, row of others) of the pairs within the radius: the first halves' distance discards nearly all, the second's decides."""
    first = np.bitwise_count(tile[:, :1] ^ others[:, 0])
    a, b = np.divmod(np.flatnonzero(first <= radius), max(len(others), 1))
    d = first[a, b] + np.bitwise_count(tile[a, 1] ^ others[b, 1])
    close = d <= radius
    return a[close], b[close]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point of its component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def neighbours(points: np.ndarray, radius: int) -> np.ndarray:
    """forest() of the links between points that are next to each other in one of planned()'s orders."""
    n = len(points)
    width, tables = planned(n, radius)
    keys = _keys(points, width, tables)
    found = []
    for table in range(tables):
        order = np.lexsort((points[:, 0], keys[:, table]))
        one, two = points[order[:-1]], points[order[1:]]
        close = np.flatnonzero(np.bitwise_count(one ^ two).sum(1) <= radius)
        found.append((order[close], order[close + 1]))
    return forest(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _keys(points: np.ndarray, width: int, tables: int) -> np.ndarray:
    return np.concatenate([blocks_of(np.ascontiguousarray(points[lo : lo + 65_536]).view(np.uint8).reshape(-1, BITS // 8), width, tables) for lo in range(0, max(len(points), 1), 65_536)])


def probes(blocks: int, radius: int) -> list[int]:
    """For each of disjoint blocks a number of bits: two points within the radius differ by no more in one block at least.

    If they differed by more in each, they would differ by the sum of these numbers and one for each block, which is radius + 1.
    """
    return [(radius + 1) // blocks - 1 + (k < (radius + 1) % blocks) for k in range(blocks)]


def indexed(query: int, base: int, radius: int) -> int:
    """Blocks of the index that takes least time for so many points; 0 if tiles take less."""

    def time(blocks: int) -> float:
        width = BITS // blocks
        return sum(sum(math.comb(width, j) for j in range(reach + 1)) for reach in probes(blocks, radius)) * query * (LOOKUP + MET * base / (1 << width))

    best = min((k for k in range(1, radius + 2) if BITS // k <= WIDEST), key=time, default=0)
    return best if best and time(best) + CALLS < query * base else 0


def joined(query: np.ndarray, base: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of query, rows of base) of all pairs within the radius, in parts; a pair may come more than once."""
    blocks = indexed(len(query), len(base), radius)
    if not blocks:
        for at in range(0, len(query), TILE):
            for lo in range(0, len(base), ACROSS):
                a, b = near(query[at : at + TILE], base[lo : lo + ACROSS], radius)
                yield at + a, lo + b
        return
    width = BITS // blocks
    size = 1 << width
    keys_q, keys_b = (_keys(x, width, blocks) & (size - 1) for x in (query, base))
    for block, reach in enumerate(probes(blocks, radius)):
        # Both sides in order of their keys, so that what is looked up lies together.
        order_q, order_b = (np.argsort(k[:, block], kind="stable") for k in (keys_q, keys_b))
        q, b = query[order_q], base[order_b]
        key = keys_q[order_q, block]
        start = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(keys_b[:, block], minlength=size), out=start[1:])
        for bits in (c for j in range(reach + 1) for c in combinations(range(width), j)):
            other = key ^ sum(1 << x for x in bits)
            first = start[other]
            count = start[other + 1] - first
            row = np.flatnonzero(count)
            first, count = first[row], count[row]
            end = np.cumsum(count)
            lo = 0
            while lo < len(row):
                before = end[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(end, before + PAIRS, side="right")))
                n = count[lo:hi]
                qi = np.repeat(row[lo:hi], n)
                bi = np.arange(end[hi - 1] - before) + np.repeat(first[lo:hi] - (end[lo:hi] - n - before), n)
                d = np.bitwise_count(q[qi, 0] ^ b[bi, 0])
                some = np.flatnonzero(d <= radius)
                qi, bi = qi[some], bi[some]
                close = d[some] + np.bitwise_count(q[qi, 1] ^ b[bi, 1]) <= radius
                if close.any():
                    yield order_q[qi[close]], order_b[bi[close]]
                lo = hi


def linked(points: np.ndarray, radius: int, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among the points of a task: a spanning forest of all near pairs.

    With second (whether a point is of the second cell), pairs of two points of one cell are left to other tasks.
    """
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = neighbours(points, radius)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def join() -> None:
        nonlocal root, found, held
        if found:
            root = forest(n, root[np.concatenate([x for x, _ in found])], root[np.concatenate([y for _, y in found])])[root]
        found, held = [], 0

    # Tile after tile of a family is compared with all points that have not been in a tile and are not linked to it. So
    # two points of a component may go uncompared, never two of different ones.
    open_ = np.ones(n, bool)
    pivot, column = -1, np.zeros(0, np.uint8)
    while True:
        size = np.bincount(root[open_], minlength=n)
        top = int(size.argmax())
        if size[top] < max(FAMILY, math.isqrt(n)):
            break
        own = root == top
        tile, others = np.flatnonzero(own & open_)[:TILE], np.flatnonzero(~own & open_)
        if pivot < 0 or not own[pivot]:
            pivot = int(tile[0])
            column = distances(points, pivot)
        open_[tile] = False
        others = possible([column], tile, others, radius)
        for lo in range(0, len(others), ACROSS):
            a, b = near(points[tile], points[others[lo : lo + ACROSS]], radius)
            if len(a):
                found.append((tile[a], others[lo + b]))
        join()
    rest = np.flatnonzero(open_)
    query, base = (rest, rest) if second is None else (rest[~second[rest]], rest[second[rest]])
    if len(query) and len(base):
        for a, b in joined(points[query], points[base], radius):
            a, b = query[a], base[b]
            apart = root[a] != root[b]
            if apart.any():
                found.append((a[apart], b[apart]))
                held += len(a)
                if held > PAIRS:
                    join()
        join()
    far = np.flatnonzero(root != np.arange(n))
    return far, root[far]


def cells_of(n_points: int) -> int:
    """Cells, of half a task's points each; 1 if one task compares all points."""
    task = max(CELL, min(n_points // 8, MOST))
    return 1 if n_points <= task else math.ceil(2 * n_points / task)


def links(points: DataFrame, n_points: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b, among distinct points (node, hi, lo): a spanning forest of the near pairs of each pair of cells, so all pairs count."""
    cells = cells_of(n_points)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            points = np.stack([rows.column("hi").to_numpy(), rows.column("lo").to_numpy()], axis=1).view(np.uint64)
            node, second = rows.column("node").to_numpy(), rows.column("second").to_numpy()
            edge = _edges(rows)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                a, b = linked(points[lo:hi], radius, second[lo:hi] if second[lo:hi].any() else None)
                a, b = node[lo + a], node[lo + b]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            # Whole pairs of cells are solved; the last of a batch may go on in the next, and is put together once.
            cut = int(_edges(batch)[-2]) if batch.num_rows else 0
            if held and batch.num_rows and held[-1].column("pair")[held[-1].num_rows - 1] != batch.column("pair")[0]:
                yield from solve()
                held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield from solve()
                held = []
            if batch.num_rows:
                held.append(batch.slice(cut))
        if held:
            yield from solve()
        give_back()

    # A point goes to the pairs that its cell makes with each, itself included. Pairs of cells i >= j are numbered i (i + 1) / 2 + j, without gaps.
    own = F.pmod(F.xxhash64("node"), F.lit(cells))
    pair = lambda k: F.struct((F.greatest(k, own) * (F.greatest(k, own) + 1) / 2 + F.least(k, own)).cast("long").alias("pair"), (own > k).alias("second"))
    spread = points.select("node", "hi", "lo", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")), pair)).alias("p")).select("p.pair", "p.second", "node", "hi", "lo")
    tasks = min(cells * (cells + 1) // 2, 4096)
    return spread.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair").mapInArrow(compare, "a long, b long").distinct()


def _edges(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where the runs of equal pairs of cells begin, and the end."""
    pair = np.asarray(rows.column("pair"))
    return np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the links (a, b), root being its component's smallest node.

    Alternates large stars and small stars until the links no longer change; each round is written to the shared folder, and the one before it removed.
    """
    first = tables_written()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "links")
        remove_written(edges.sparkSession, first, -1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, key (its text's), kept_doc_id, distance: one row for each text of a document that is a copy, exact or near, of one of another that stays; see duplicates()."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}: groups are numbered by integer ids")
    prints = with_fingerprint(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = written(prints.distinct(), "prints")
    # An id may be the first of several points, so points have numbers of their own.
    points = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
    points = written(points.withColumn("node", F.monotonically_increasing_id()), "points")
    roots = components(links(points, points.count(), radius))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rows = sized(roots, roots.count())
    heads = points.join(rows, "node").groupBy("root").agg(F.min(F.struct("first", "hi", "lo")).alias("head"))
    kept = points.join(rows.join(heads, "root"), "node", "left").where(F.col("many") | F.col("head").isNotNull())
    kept = kept.select("hi", "lo", F.coalesce("head", F.struct("first", "hi", "lo")).alias("head"))
    out = prints.join(kept, ["hi", "lo"]).where(F.col("doc_id") != F.col("head.first"))
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("head.hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("head.lo")))
    return out.select("doc_id", "key", F.col("head.first").alias("kept_doc_id"), distance.cast("int").alias("distance"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, kept_doc_id, distance: one row for each document that is a copy, exact or near, of the one that stays.

    Ids must be of an integer type; others raise TypeError before anything runs. Rows with a null id or a text that is null, empty or without a word are never copies.
    Rows that repeat an id and its text count as one document; if the texts differ, each has links of its own, and the
    id a row for each group that it is a copy in, with its least distance there. The smallest id of a group stays, with
    the fingerprint that sorts first, so ties can't arise; documents without a copy don't appear; texts are hashed
    whole; an empty table gives no rows. Other columns of docs are not looked at.
    """
    return copies(docs, id_col, text_col, radius).groupBy("doc_id", "kept_doc_id").agg(F.min("distance").alias("distance"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the texts that copies() lists.

    Rows with a null id or a null, empty or wordless text stay, as they are no copies; rows that repeat an id stay or go
    as their texts do, so that no text goes for another's sake; an empty table stays empty. Columns may have any name.
    """
    own_id, own_key = free_names(docs, "gone_id", "gone_key")
    gone = written(copies(docs, id_col, text_col).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)), "copies")
    return docs.join(sized(gone, gone.count()), (F.col(f"`{id_col}`").cast("long") == F.col(own_id)) & (text_key(text_col) == F.col(own_key)), "left_anti")
