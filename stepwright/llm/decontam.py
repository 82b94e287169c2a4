"""Operator 8. Benchmark decontamination by q-gram lemma filtering.

Texts are normalised to bytes: lower case, runs of anything but letters, digits
and bytes above 127 become one space. An item of m normalised bytes is in a
document if some substring of the document is within floor(RATE * m) edits of
it. Such a match shares at least m + 1 - Q - Q * edits character q-grams with
the item (q-gram lemma), all within edits + 1 neighbouring diagonals. So:

1. a bitmap of the items' q-grams marks the positions of a text; a match has a
   window with enough marks for some item, so only marks within the longest
   match's length of such a window are kept;
2. the marks that remain are looked up and counted in overlapping diagonal
   bands for each item; bands below the item's bound are left;
3. the bands that remain are verified by banded alignment.

No step loses a match; the result equals brute-force alignment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stepwright.llm.common import map_batches, once, text_bytes

Q = 10
RATE = 0.07
#: Items of fewer normalised bytes than this are no evidence (any text may hold them by chance); too_short() lists them. Below 20 bytes the q-gram lemma says nothing.
LEAST = 40
#: Benchmark bytes that one pass over the documents looks for; a larger benchmark takes several passes.
BENCHMARK_BYTES = 8_000_000
BITMAP = 24
CHUNK = 1 << 19

_MAP = np.full(256, 32, np.uint8)
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normalised texts; each begins with a space."""
    raw, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offsets) - 1
    raw = _MAP[raw]
    # A space before each text stands for its start and takes in the spaces that follow.
    marked = np.full(len(raw) + n, 32, np.uint8)
    if len(raw):
        marked[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    starts = offsets + np.arange(n + 1)
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] != 32) | (marked[:-1] != 32)
    keep[starts[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return marked[keep], before[starts]


def codes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q bytes from each position on."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(raw) - 7,), np.uint64, np.ascontiguousarray(raw), strides=(1,))
    a, b = view[:n], view[Q - 8 : Q - 8 + n]
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(stop, minlength=n + 1)[:n]) > 0


class Index:
    """Q-grams of benchmark items: a bitmap, and their places sorted by code."""

    def __init__(self, ids: list, texts: list[str]):
        raw, offsets = normalised(pa.array(texts, pa.large_string()))
        self.ids, self.items = [], []
        for k, i in enumerate(ids):
            body = raw[offsets[k] : offsets[k + 1]]
            body = body[1:] if len(body) and body[0] == 32 else body
            body = body[:-1] if len(body) and body[-1] == 32 else body
            if len(body) >= LEAST:
                self.ids.append(i)
                self.items.append(np.ascontiguousarray(body))
        self.length = np.array([len(x) for x in self.items], np.int64)
        self.edits = (self.length * RATE).astype(np.int64)
        self.bound = np.maximum(1, self.length + 1 - Q - Q * self.edits)
        each = [codes(x) for x in self.items]
        self.code = np.concatenate([*each, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        place = np.concatenate([*(np.arange(len(x)) for x in each), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(self.code, kind="stable")
        self.code, self.item, self.place = self.code[order], item[order], place[order]
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[(self.code >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
        reach = self.length + self.edits
        self.window = int(reach.min(initial=1 << 40))
        self.reach = int(reach.max(initial=0))
        self.least = int((-(-self.bound // -(-reach // self.window))).min(initial=1 << 40)) if len(reach) else 1 << 40

    def marks(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of raw whose q-gram may be an item's, and which of them lie in windows that hold enough of them."""
        found = []
        for lo in range(0, max(0, len(raw) - Q + 1), CHUNK):
            h = codes(raw[lo : lo + CHUNK + Q - 1]) >> np.uint64(64 - BITMAP)
            found.append(np.flatnonzero(self.bitmap[h.astype(np.int64)]) + lo)
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(at) < self.least:
            return at[:0], np.zeros(0, bool)
        # A mark is dense if `least` marks in a row, this one among them, lie within one window.
        k = self.least - 1
        full = at[k:] - at[: len(at) - k] < self.window
        first = np.flatnonzero(full)
        return at, _covered(first, first + k + 1, len(at))

    def near(self, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The marks of one text that can belong to a match: only one window of a match need be dense, its other marks are within its length."""
        return at[_covered(np.searchsorted(at, at[dense] - self.reach), np.searchsorted(at, at[dense] + self.reach, "right"), len(at))]

    def candidates(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, lowest diagonal, marks) of the bands of raw with at least the item's bound; bands are 2 * (edits + 1) wide and overlap by half."""
        h = np.concatenate([codes(raw[p : p + Q]) for p in at]) if len(at) < 64 else codes(raw)[at]
        lo, hi = np.searchsorted(self.code, h, "left"), np.searchsorted(self.code, h, "right")
        n = hi - lo
        spot = np.repeat(at, n)
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item, diagonal = self.item[entry], spot - self.place[entry]
        wide = self.edits[item] + 1
        band = diagonal // wide
        span = len(raw) + int(self.length.max(initial=0)) + 2
        key = item * (2 * span) + span + band
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item, band = key // (2 * span), key % (2 * span) - span
        good = count >= self.bound[item]
        item, band, count = item[good], band[good], count[good]
        return item, band * (self.edits[item] + 1), count

    def verify(self, raw: np.ndarray, item: int, low: np.ndarray) -> np.ndarray:
        """Least edit distance of the item to a substring of raw on the band's diagonals and as many as the edits on each side."""
        body, edits = self.items[item], int(self.edits[item])
        width = 2 * (edits + 1) + 2 * edits
        first = low - edits  # diagonal of the band's first column
        offset = np.arange(width)
        big = len(body) + 1
        row = np.where((first[:, None] + offset >= 0) & (first[:, None] + offset <= len(raw)), 0, big).astype(np.int32)
        padded = np.concatenate([np.zeros(1, np.uint8), raw])
        for i in range(1, len(body) + 1):
            j = first[:, None] + offset + i  # text bytes used so far
            inside = (j >= 0) & (j <= len(raw))
            same = (padded[np.clip(j, 0, len(raw))] == body[i - 1]) & (j >= 1)
            step = row + ~same
            step[j == 0] = i
            up = np.concatenate([row[:, 1:], np.full((len(row), 1), big, np.int32)], axis=1) + 1
            step = np.where(inside, np.minimum(step, up), big)
            row = np.minimum.accumulate(step - offset, axis=1) + offset
            row = np.where(inside, row, big).astype(np.int32)
        return row.min(axis=1)

    def matches(self, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(item, distance) of each item within its budget, at its least distance."""
        item, low, _ = self.candidates(raw, at)
        found = []
        whole = raw.tobytes()
        for i in np.unique(item):
            best = 0 if self.items[i].tobytes() in whole else int(self.verify(raw, int(i), low[item == i]).min())
            if best <= self.edits[i]:
                found.append((int(i), best))
        return found


def too_short(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of benchmark, all columns, whose text has fewer than `least` normalised bytes (null texts too): matches() can't tell anything of them."""
    place = benchmark.columns.index(text_col)

    def make():
        def kernel(batch: pa.RecordBatch):
            raw, offsets = normalised(batch.column(place))
            size = np.diff(offsets)
            some = size > 0
            blank = np.zeros(len(size), np.int64)
            blank[some] = (raw[offsets[:-1][some]] == 32).astype(np.int64) + ((raw[offsets[1:][some] - 1] == 32) & (size[some] > 1))
            yield batch.filter(pa.array(size - blank < least))

        return kernel

    return map_batches(benchmark, make, benchmark.schema, text_col)


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> list[tuple[list[int], list[str], list]]:
    """(place of each text's id, texts, ids) of each pass over the documents; an id's texts are in one pass.

    The benchmark is the small side: its texts come to the driver in turn, BENCHMARK_BYTES for a pass.
    """
    parts: list[tuple[list[int], list[str], list]] = []
    size = BENCHMARK_BYTES
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).dropna().distinct()
    kept = [(r[0], r[1]) for r in rows.toLocalIterator()]
    for i, t in sorted(kept, key=lambda x: (str(x[0]), x[1])):
        new = not parts or i != parts[-1][2][-1]
        if size >= BENCHMARK_BYTES and new:
            parts.append(([], [], []))
            size = 0
        if new:
            parts[-1][2].append(i)
        parts[-1][0].append(len(parts[-1][2]) - 1)
        parts[-1][1].append(t)
        size += len(t.encode())
    return parts


def _kernel(owner: list[int], texts: list[str], text_place: int):
    """found(batch): (row, place of the item's id, least distance) of each item in each row, once."""

    def make():
        digest = hashlib.blake2b("\0".join([*map(str, owner), *texts]).encode()).hexdigest()
        index = once(("benchmark", digest, LEAST, RATE), lambda: Index(owner, texts))

        def found(batch: pa.RecordBatch) -> list[tuple[int, int, int]]:
            out: dict[tuple[int, int], int] = {}
            if not index.items:
                return []
            raw, offsets = normalised(batch.column(text_place))
            at, dense = index.marks(raw)
            bounds = np.searchsorted(at, offsets)
            some = np.concatenate([[0], np.cumsum(dense)])[bounds]
            for k in np.flatnonzero((np.diff(bounds) >= index.least) & (np.diff(some) > 0)):
                own = index.near(at[bounds[k] : bounds[k + 1]], dense[bounds[k] : bounds[k + 1]])
                own = own[own <= offsets[k + 1] - Q] - offsets[k]
                if len(own):
                    for i, d in index.matches(raw[offsets[k] : offsets[k + 1]], own):
                        key = (int(k), index.ids[i])
                        out[key] = min(d, out.get(key, d))
            return [(k, i, d) for (k, i), d in out.items()]

        return found

    return make


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance: each benchmark item that is in a document within its edit budget.

    Null and empty texts or items and items of fewer than LEAST normalised bytes match nothing; ids may be of any type
    that can be compared; a null doc_id stays null, an item with a null id is left out. Repeated rows of docs each give
    their rows; repeated items give one, and an id with several texts counts as found if one of them is, at the least
    distance of all. An item that is in a document more than once gives one row with the least distance. Texts are
    searched whole; empty tables give no rows. Other columns are not looked at.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, distance int"
    item_type = to_arrow_type(item_kind, prefers_large_types=False)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for owner, texts, ids in _parts(benchmark, item_col, item_text_col) or [([], [], [])]:
        prepared = _kernel(owner, texts, 1)

        def make(prepared=prepared, ids=ids):
            found = prepared()

            def kernel(batch: pa.RecordBatch):
                rows = found(batch)
                place = pa.array([k for k, _, _ in rows], pa.int64())
                items = pa.array([ids[i] for _, i, _ in rows], type=item_type)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), items, pa.array([d for _, _, d in rows], pa.int32())], names=["doc_id", "item_id", "distance"])

            return kernel

        one = map_batches(chosen, make, schema, "text")
        out = one if out is None else out.unionByName(one)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; one pass for each part of the benchmark, no join.

    Rows with a null or empty text stay, as do null and repeated ids; repeated rows stay or go alike; texts are searched
    whole; without items, or with none of LEAST normalised bytes, all rows stay; an empty table stays empty. Columns may
    have any name.
    """
    place = docs.columns.index(text_col)
    schema = docs.schema
    for owner, texts, _ in _parts(benchmark, item_col, item_text_col):
        prepared = _kernel(owner, texts, place)

        def make(prepared=prepared):
            found = prepared()

            def kernel(batch: pa.RecordBatch):
                keep = np.ones(batch.num_rows, bool)
                keep[[k for k, _, _ in found(batch)]] = False
                yield batch.filter(pa.array(keep))

            return kernel

        docs = map_batches(docs, make, schema, text_col)
    return docs
