"""Operator 5. Token ids in byte-aligned variable-length coding.

Texts are tokenised with a public byte-pair vocabulary; ids are renumbered by
their frequency in the whole corpus, the most frequent being 0; each
document's ids are stored in 1 to 4 bytes each, the lengths (two bits each)
apart in control bytes. numpy decodes by looking up, for each control byte,
which data bytes its four ids take.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import map_batches, once, text_bytes, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text that are tokenised at once: the more, the fewer parts differ.
SLICE = 8_000_000
#: The pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What \s is in the pattern: the white space of Unicode (in Arrow's expressions it is ASCII only).
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def merges(path: str = VOCABULARY) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def tokenizer(ranks: dict[bytes, int] | None = None):
    """Returns text array -> (ids of all texts, offsets of each text's), by the merges of VOCABULARY if none are given.

    The pattern never joins a character with a space that follows it unless both are white space. So a text without
    white space before a space is taken apart before each space, and each different part is tokenised once: the
    different parts, each with its space, are one text for the tokeniser, and a token that begins with a space
    begins a part.
    """
    import tiktoken

    ranks = merges() if ranks is None else ranks
    digest = hashlib.blake2b(b"".join(b"%d %b " % (i, x) for x, i in ranks.items())).hexdigest()
    coder = once(("coder", digest), lambda: tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    spaced = np.zeros(max(ranks.values()) + 1, bool)
    spaced[[i for token, i in coder._mergeable_ranks.items() if token[:1] == b" "]] = True

    def one(text: str) -> np.ndarray:
        return coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def of_parts(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each part with a space before it, and how many each has."""
        alone = np.asarray(pc.match_substring_regex(parts, "^$|" + SPACE + "$"), dtype=bool)  # white space must not meet the next part's
        raw, offsets = text_bytes(parts.filter(pa.array(~alone)))
        joined = np.full(len(raw) + len(offsets) - 1, 32, np.uint8)
        joined[np.arange(len(raw)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = raw
        ids = one(joined.tobytes().decode())
        begins = np.flatnonzero(spaced[ids])
        if len(begins) != len(offsets) - 1:
            raise ValueError(f"{len(offsets) - 1} parts became {len(begins)}")
        n = np.zeros(len(parts), np.int64)
        n[~alone] = np.diff(np.append(begins, len(ids)))
        if not alone.any():
            return ids, n
        rows = [one(" " + x) for x in parts.filter(pa.array(alone)).to_pylist()]
        n[alone] = [len(r) for r in rows]
        out = np.empty(int(n.sum()), np.int64)
        of_alone = np.repeat(alone, n)
        out[~of_alone], out[of_alone] = ids, np.concatenate(rows)
        return out, n

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, SPACE + " "))
        parts = pc.split_pattern(pc.if_else(plain, texts, ""), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        coded = parts.flatten().dictionary_encode()
        where = np.array(coded.indices, dtype=np.int64)
        # A text's first part has no space before it: these have entries of their own at the table's end.
        begins = offsets[:-1][np.diff(offsets) > 0]
        heads = [one(x) for x in coded.dictionary.take(pa.array(where[begins])).to_pylist()]
        where[begins] = len(coded.dictionary) + np.arange(len(begins))
        table, n = of_parts(coded.dictionary)
        table = np.concatenate([table, *heads])
        n = np.append(n, [len(x) for x in heads]).astype(np.int64)
        start = np.cumsum(n) - n
        each = n[where]
        before = np.concatenate([[0], np.cumsum(each)])
        out = table[np.arange(int(each.sum())) - np.repeat(before[:-1], each) + np.repeat(start[where], each)].astype(np.int32)
        edge = before[offsets]
        odd = np.flatnonzero(~np.asarray(plain))
        if len(odd):
            rows = [out[edge[k] : edge[k + 1]] for k in range(len(texts))]
            for k, x in zip(odd, texts.take(pa.array(odd)).to_pylist(), strict=True):
                rows[k] = one(x).astype(np.int32)
            edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            out = np.concatenate(rows)
        return out, edge

    return encode


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ids below 2**32: two control bits for each id, low bits first, and its low bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    size = (ids > 0xFF).astype(np.uint8) + (ids > 0xFFFF) + (ids > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = size
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
    data = ids.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    size = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1
    start = np.cumsum(size, axis=1) - size
    k = np.arange(4)
    take = np.where(k < size[:, :, None], start[:, :, None] + k, -1).reshape(256, 16)
    return size.sum(axis=1), take


#: For each control byte: the data bytes of its four ids, and where each of their 16 bytes comes from (-1: zero).
TOTAL, TAKE = _tables()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids of (control, data), by table lookup."""
    c = np.frombuffer(control, np.uint8)
    total = TOTAL[c]
    start = np.cumsum(total) - total
    body = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    take = TAKE[c]
    at = np.where(take >= 0, np.minimum(start[:, None] + take, len(body) - 1), len(body) - 1)
    return np.ascontiguousarray(body[at]).view("<u4").reshape(-1)[:n]


def _stored(n_ids: int) -> np.dtype:
    """The type of ids between the two passes: 2 bytes if they suffice for the vocabulary, else 4."""
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (little-endian, of 16 bits, or 32 for vocabularies of more than 65,536 ids) of each row."""
    ranks = merges(path)  # read once here and sent with the job: executors need no file
    dtype = _stored(max(ranks.values()) + 1)

    def make():
        encode = tokenizer(ranks)

        def kernel(batch: pa.RecordBatch):
            ids, edge = encode(batch.column(1))
            raw = ids.astype(dtype).tobytes()
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((edge * dtype.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(chosen, make, f"doc_id {kind}, ids binary", "text", SLICE)


def ranking(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """rank[id] by falling frequency over all rows of tokenised(), ties by id; a table of the vocabulary's size."""
    dtype = _stored(n_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            raw, _ = text_bytes_of(b.column(0))
            total += np.bincount(raw.view(dtype), minlength=n_ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(n_ids, np.int64)
    for r in rows:
        n[r[0]] = r[1]
    rank = np.empty(n_ids, np.int64)
    rank[np.lexsort((np.arange(n_ids), -n))] = np.arange(n_ids)
    return rank.astype(np.uint32)


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, control, data: each row's frequency-ranked token ids.

    Null and empty texts have no tokens and empty control and data; null ids and repeated rows pass through; texts
    are tokenised whole; equally frequent ids rank by id; an empty table gives no rows. Other columns are not looked
    at. The vocabulary may have any number of ids up to 2**31. The tokens are written once to the shared folder, counted from there, and renumbered.
    """
    tokens = written(tokenised(docs, id_col, text_col, path), "tokens")
    n_ids = max(merges(path).values()) + 1
    rank, dtype = ranking(tokens, n_ids), _stored(n_ids)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                raw, edge = text_bytes_of(b.column(1))
                ids, edge = rank[raw.view(dtype)], edge // dtype.itemsize
                both = [encode_ids(ids[edge[k] : edge[k + 1]]) for k in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(edge), pa.int64()), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["doc_id", "n_tokens", "control", "data"])

    kind = docs.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(number, f"doc_id {kind}, n_tokens long, control binary, data binary")
