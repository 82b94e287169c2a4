"""Operator 10. Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces gets a probability per language. The score
of a word in a language is the sum over all its segmentations into pieces of
the product of their probabilities (forward algorithm); words are the runs of
letters of the lower-case text (digits and signs say nothing about a language),
each starts with the vocabulary's word mark, and a text's probability is the
product of its words'. A word's score is computed once per slice for all
languages, then looked up by dictionary code.

A long word, such as a clause in a script without spaces, is cut where no piece
of the vocabulary reaches across: all segmentations meet there, so its sum is
the product of its parts' sums. Parts are scored like short words; those that
are long themselves go byte by byte, all of a slice at once.

The piece probabilities are fitted by expectation maximisation on a bounded
sample of labelled rows: TRAIN_DOCS documents of each language, those with the
smallest hash of their id. The bound is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import map_batches, once, text_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 150
ROUNDS = 2
MARK = "▁".encode()
#: Scale of one byte's share of a word's probability, against underflow.
SCALE = 1000.0
#: Words of more bytes are cut at the places that no piece crosses; parts of more bytes go through the step-normalised path.
LONG = 64
FLOOR = 1e-6
#: Bytes of text, and different words, that are scored at once.
SLICE = 6_000_000
WORDS_AT_ONCE = 6_000
#: Bytes of long words that are scored at once.
LONG_AT_ONCE = 200_000
#: A document is rejected if its best language is not MIN_LEAD nats a byte ahead of the background, in which all pieces are equally likely ...
MIN_LEAD = 0.0
#: ... or the second best language is nearer than MIN_MARGIN nats a byte: texts half in one known language, half in another, stay.
MIN_MARGIN = 0.0005


@dataclass(frozen=True)
class Model:
    """pieces: the vocabulary's byte strings; languages: sorted; probabilities: pieces x languages."""

    pieces: tuple[bytes, ...]
    languages: tuple[str, ...]
    probabilities: np.ndarray


def vocabulary(path: str = VOCABULARY) -> tuple[bytes, ...]:
    """The pieces of a SentencePiece model as bytes, with each single byte among them, sorted."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            found.add(sp.id_to_piece(i).encode())
    return tuple(sorted(found))


class Trie:
    """Byte trie of pieces: next[row[node], byte] is a node or 0; piece[node] is a piece's place or -1."""

    def __init__(self, pieces: tuple[bytes, ...]):
        child: dict[tuple[int, int], int] = {}
        piece = [-1, -1]  # node 0 is dead, node 1 the root
        for i, p in enumerate(pieces):
            node = 1
            for b in p:
                to = child.get((node, b))
                if to is None:
                    to = child[node, b] = len(piece)
                    piece.append(-1)
                node = to
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        inner = sorted({node for node, _ in child})
        self.row = np.zeros(len(piece), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.next = np.zeros((len(inner) + 1, 256), np.int32)
        keys = np.array(list(child), np.int64).reshape(-1, 2)
        self.next[self.row[keys[:, 0]], keys[:, 1]] = np.fromiter(child.values(), np.int32, len(child))

    def edges(self, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """All (start, stop, piece) that match raw[start:stop] with stop <= end[start]."""
        at = np.arange(len(raw), dtype=np.int64)
        node = np.ones(len(raw), np.int32)
        starts, stops, pieces = [at[:0]], [at[:0]], [node[:0]]
        step = 0
        while len(at):
            node = self.next[self.row[node], raw[at + step]]
            step += 1
            alive = node > 0
            at, node = at[alive], node[alive]
            found = self.piece[node]
            hit = found >= 0
            starts.append(at[hit])
            stops.append(at[hit] + step)
            pieces.append(found[hit])
            alive = at + step < end[at]
            at, node = at[alive], node[alive]
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)


def trie_of(pieces: tuple[bytes, ...]) -> Trie:
    return once(("trie", pieces), lambda: Trie(pieces))


def letter_runs(words: pa.Array) -> pa.Array:
    """The lower-case runs of letters of each word, as lists; a word without a letter has one empty string."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{M}]+", " ")))


def _laid(words: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of all words, the mark before each; the places of their starts; the length of each."""
    body, offsets = text_bytes(words)
    length = np.diff(offsets) + len(MARK)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else np.zeros(0, np.int64)
    raw = np.zeros(int(length.sum()), np.uint8)
    for k, b in enumerate(MARK):
        raw[start + k] = b
    if len(body):
        raw[np.arange(len(body)) + np.repeat((np.arange(len(length)) + 1) * len(MARK), np.diff(offsets))] = body
    return raw, start, length


def _runs(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _forward(raw, start, length, trie: Trie, p: np.ndarray):
    """alpha over word positions (a slot more than bytes for each word), and the edges as (from slot, to slot, piece, from offset, to offset)."""
    word = np.repeat(np.arange(len(start)), length)
    end = (start + length)[word]
    a, b, piece = trie.edges(raw, end)
    w = word[a]
    src, dst = a + w, b + w  # word w's slots begin at start[w] + w
    first, last = a - start[w], b - start[w]
    order = np.argsort(last * (len(raw) + len(start) + 1) + dst, kind="stable")
    src, dst, piece, first, last = src[order], dst[order], piece[order], first[order], last[order]
    weight = p[piece] * (SCALE ** (last - first))[:, None]
    alpha = np.zeros((len(raw) + len(start), p.shape[1]))
    alpha[start + np.arange(len(start))] = 1.0
    for s, e in _spans(last):
        part = alpha[src[s:e]] * weight[s:e]
        runs = _runs(dst[s:e])
        alpha[dst[s:e][runs]] = np.add.reduceat(part, runs, axis=0)
    return alpha, (src, dst, piece, first, last, weight)


def _spans(key: np.ndarray) -> list[tuple[int, int]]:
    at = [*_runs(key).tolist(), len(key)]
    return list(zip(at[:-1], at[1:], strict=True))


def _long(raw: np.ndarray, start: np.ndarray, length: np.ndarray, trie: Trie, p: np.ndarray) -> np.ndarray:
    """Log probability per language of words of any length, all of them a byte further at each step; sums are rescaled every 8 steps."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    n = len(start)
    at = np.cumsum(length) - length
    body = raw[np.arange(int(length.sum())) - np.repeat(at, length) + np.repeat(start, length)]
    word = np.repeat(np.arange(n), length)
    a, b, piece = trie.edges(body, (at + length)[word])
    w = word[a]
    last = b - at[w]
    by = np.lexsort((w, last))
    w, first, last, piece = w[by], (a - at[w])[by], last[by], piece[by]
    width = 1 + int((last - first).max(initial=1))
    ring = np.zeros((width, n, p.shape[1]))
    ring[0] = 1.0
    log, out = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    live = n  # words are in falling order of length: those before `live` go on
    for t, (s, e) in enumerate(_spans(last), 1):
        part = ring[first[s:e] % width, w[s:e]] * p[piece[s:e]]
        runs = _runs(w[s:e])
        ring[t % width, :live] = np.add.reduceat(part, runs, axis=0)
        if t % 8 == 0:
            top = ring[:, :live].max(0)
            ring[:, :live] /= top
            log[:live] += np.log(top)
        done = int(np.searchsorted(-length[:live], -t, side="left"))
        if done < live:
            out[done:live] = log[done:live] + np.log(ring[t % width, done:live])
            live = done
    back = np.empty_like(out)
    back[order] = out
    return back


def parts_of(raw: np.ndarray, start: np.ndarray, length: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, length) of the parts into which words fall at the places that no piece crosses."""
    at = np.cumsum(length) - length
    body = raw[np.arange(int(length.sum())) - np.repeat(at, length) + np.repeat(start, length)]
    word = np.repeat(np.arange(len(start)), length)
    a, b, _ = trie.edges(body, (at + length)[word])
    n = len(body) + 1
    crossed = np.cumsum(np.bincount(a + 1, minlength=n + 1)[:n] - np.bincount(b, minlength=n + 1)[:n]) > 0
    cut = np.flatnonzero(~crossed[:-1])
    w = word[cut]
    return w, cut - at[w] + start[w], np.diff(np.append(cut, len(body)))


def _scores(raw: np.ndarray, start: np.ndarray, length: np.ndarray, trie: Trie, p: np.ndarray) -> np.ndarray:
    """Log probability of each of raw's words in each language, summed over all segmentations."""
    out = np.zeros((len(start), p.shape[1]))
    short = np.flatnonzero(length <= LONG)
    for lo in range(0, len(short), WORDS_AT_ONCE):
        take = short[lo : lo + WORDS_AT_ONCE]
        n = length[take]
        at = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        body = raw[np.arange(int(n.sum())) - np.repeat(at, n) + np.repeat(start[take], n)]
        alpha, _ = _forward(body, at, n, trie, p)
        out[take] = np.log(alpha[at + n + np.arange(len(take))]) - (n * np.log(SCALE))[:, None]
    return out


def _different(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, start, length): the different strings among raw's ranges, and which of them each range is."""
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    body = raw[np.arange(int(at[-1])) - np.repeat(at[:-1], length) + np.repeat(start, length)]
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body.tobytes())])
    coded = column.dictionary_encode()
    which = np.asarray(coded.indices, dtype=np.int64)
    first = np.full(len(coded.dictionary), len(start), np.int64)
    np.minimum.at(first, which, np.arange(len(start)))
    return which, start[first], length[first]


def word_scores(words: pa.Array, trie: Trie, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    raw, start, length = _laid(words)
    out = _scores(raw, start, length, trie, p)
    long = np.flatnonzero(length > LONG)
    for lo, hi in _shares(length[long]):
        some = long[lo:hi]
        word, at, n = parts_of(raw, start[some], length[some], trie)
        which, at, n = _different(raw, at, n)
        of = _scores(raw, at, n, trie, p)
        still = np.flatnonzero(n > LONG)
        if len(still):
            of[still] = _long(raw, at[still], n[still], trie, p)
        for k in range(p.shape[1]):
            out[some, k] = np.bincount(word, of[which, k], minlength=len(some))
    return out


def _shares(size: np.ndarray, most: int = LONG_AT_ONCE) -> list[tuple[int, int]]:
    """Ranges of neighbours of `most` together; a larger one is a range of its own."""
    upto, out, lo = np.cumsum(size), [], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def fit(texts: dict[str, list[str]], pieces: tuple[bytes, ...], rounds: int = ROUNDS) -> Model:
    """Fit per-language piece probabilities by expectation maximisation.

    All letters of the texts count. Long words are fitted in the parts into which parts_of() cuts them, exactly as they
    are scored; a part that is longer than LONG bytes itself is fitted in windows of LONG bytes, and what segmentations
    across two windows would add to the counts is not counted. A language without a letter has equally likely pieces.
    """
    trie = trie_of(pieces)
    languages = tuple(sorted(texts))
    p = np.zeros((len(pieces), len(languages)))
    start_at = np.array([1.0 / (1 + len(x)) ** 2 for x in pieces])
    for k, lang in enumerate(languages):
        counted = pc.value_counts(pc.utf8_split_whitespace(pa.array(texts[lang], pa.large_string())).flatten())
        runs = letter_runs(counted.field("values"))
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary
        times = np.bincount(np.asarray(coded.indices), np.asarray(counted.field("counts"), float)[np.asarray(pc.list_parent_indices(runs))], minlength=len(words))
        some = np.flatnonzero(np.asarray(pc.not_equal(words, "")))
        words, times = words.take(pa.array(some)), times[some]
        raw, start, length = _laid(words)
        raw, start, length, times = _fitted(raw, start, length, times, trie)
        # The first probabilities fall with a piece's length slower than those of its bytes would.
        q = (start_at / start_at.sum())[:, None]
        for _ in range(rounds + 1 if len(start) else 0):
            alpha, (src, dst, piece, first, last, weight) = _forward(raw, start, length, trie, q)
            beta = np.zeros_like(alpha)
            final = start + length + np.arange(len(start))
            beta[final] = 1.0
            order = np.argsort(-first * (len(alpha) + 1) + src, kind="stable")
            for s, e in _spans(first[order]):
                o = order[s:e]
                part = beta[dst[o]] * weight[o]
                runs = _runs(src[o])
                beta[src[o][runs]] = np.add.reduceat(part, runs, axis=0)
            word = np.searchsorted(start + np.arange(len(start)), src, side="right") - 1
            share = (alpha[src] * weight * beta[dst])[:, 0] / alpha[final][word, 0] * times[word]
            q = np.bincount(piece, share, minlength=len(pieces))
            q = np.maximum(q / max(q.sum(), 1.0), FLOOR)
            q = (q / q.sum())[:, None]
        p[:, k] = q[:, 0] if len(start) else 1 / len(pieces)
    return Model(pieces, languages, p)


def _fitted(raw: np.ndarray, start: np.ndarray, length: np.ndarray, times: np.ndarray, trie: Trie) -> tuple[np.ndarray, ...]:
    """raw, start, length and times of the words that fit() goes over: long ones in parts, long parts in windows; equal ones together."""
    long = length > LONG
    word, at, n = parts_of(raw, start[long], length[long], trie)
    count = times[long][word]
    windows = -(-n // LONG)
    k = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at, left, count = np.repeat(at, windows) + k * LONG, np.repeat(n, windows) - k * LONG, np.repeat(count, windows)
    start, length, times = np.concatenate([start[~long], at]), np.concatenate([length[~long], np.minimum(left, LONG)]), np.concatenate([times[~long], count])
    which, start, length = _different(raw, start, length)
    times = np.bincount(which, times, minlength=len(start))
    at = np.cumsum(length) - length
    return raw[np.arange(int(length.sum())) - np.repeat(at, length) + np.repeat(start, length)], at, length, times


def train(docs: DataFrame, path: str = VOCABULARY, per_language: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most per_language labelled documents of each language (smallest hash of the id), whole texts.

    Only ids and labels are read to choose them; their texts are then read by a semi-join with the chosen ids, of which
    there are at most per_language for each language, whatever the table's size. Rows without an id, a label or a text
    are not fitted on, nor are languages without a letter; a table without any gives a model of one language, und.
    """
    w = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    labelled = docs.select(id_col, lang_col).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    chosen = labelled.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_language).select(id_col).distinct()
    texts: dict[str, list[str]] = {}
    rows = docs.select(id_col, lang_col, text_col).dropna().join(F.broadcast(chosen), id_col, "left_semi").select(lang_col, text_col).toLocalIterator()
    for r in sorted(tuple(x) for x in rows):
        texts.setdefault(r[0], []).append(r[1])
    texts = {k: v for k, v in texts.items() if any(c.isalpha() for x in v for c in x)}
    if not texts:
        texts = {"und": ["a"]}
    return fit(texts, vocabulary(path))


def scorer(model: Model):
    """Returns text array -> (best language's place or -1, its nats a byte, margin to the second, lead over the background, bytes)."""
    trie = trie_of(model.pieces)
    n_languages = len(model.languages)
    p = np.column_stack([model.probabilities, np.full(len(model.pieces), 1 / len(model.pieces))])

    def score(texts: pa.Array):
        words = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = np.asarray(words.offsets, dtype=np.int64)
        flat = words.flatten()
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices)
        runs = letter_runs(coded.dictionary)
        within = runs.flatten().dictionary_encode()
        book, owner = within.dictionary, np.asarray(pc.list_parent_indices(runs))
        one = word_scores(book, trie, p)
        bytes_of = np.asarray(pc.binary_length(book), float) + len(MARK)
        empty = np.asarray(pc.equal(book, ""), dtype=bool)
        one[empty], bytes_of[empty] = 0.0, 0.0
        each = np.asarray(within.indices)
        size = np.bincount(owner, bytes_of[each], minlength=len(coded.dictionary))
        value = np.stack([np.bincount(owner, one[each, k], minlength=len(coded.dictionary)) for k in range(p.shape[1])], axis=1)
        n = len(texts)
        total = np.zeros((n, p.shape[1]))
        length = np.zeros(n)
        some = np.flatnonzero(np.diff(offsets) > 0)
        if len(some):
            at = offsets[:-1][some] - offsets[0]
            length[some] = np.add.reduceat(size[codes], at)
            for k in range(p.shape[1]):
                total[some, k] = np.add.reduceat(value[codes, k], at)
        rate = total / np.maximum(length, 1.0)[:, None]
        rate, background = rate[:, :n_languages], rate[:, n_languages]
        order = np.sort(rate, axis=1)
        best = np.where(length > 0, rate.argmax(1), -1)
        margin = order[:, -1] - order[:, -2] if n_languages > 1 else np.full(n, np.inf)
        return best, order[:, -1], margin, order[:, -1] - background, length

    return score


def accepted(best, margin, lead) -> np.ndarray:
    """Texts with at least one word whose best language is ahead of the background and of the second."""
    return (best >= 0) & (lead >= MIN_LEAD) & (margin >= MIN_MARGIN)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, language (null if rejected for want of words), score, margin, lead, accepted.

    score is nats a byte of the best language, margin its distance from the second, lead that from the background. A null, empty or blank text, or one without a letter,
    has language null, score, margin and lead 0 and is not accepted. Null ids stay null; repeated rows each get a row; ties go to the
    language first in alphabetical order; texts of any length are scored whole; an empty table gives no rows.
    Other columns of docs are not looked at, whatever their names.
    """

    def make():
        score = scorer(model)
        names = np.array([*model.languages, None], dtype=object)

        def kernel(batch: pa.RecordBatch):
            best, rate, margin, lead, length = score(batch.column(1))
            numbers = [pa.array(np.round(np.where(length > 0, np.minimum(x, 1e6), 0.0), 9)) for x in (rate, margin, lead)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), *numbers, pa.array(accepted(best, margin, lead))], names=["doc_id", "language", "score", "margin", "lead", "accepted"])

        return kernel

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(chosen, make, f"doc_id {kind}, language string, score double, margin double, lead double, accepted boolean", "text", SLICE)


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that identify() accepts; one pass, no join.

    Null, empty and letterless texts go, as identify() does not accept them; repeated rows stay or go alike, rows keep
    their ids, null or repeated, and all their columns, whatever the names; texts are scored whole; an empty table stays
    empty.
    """
    place = docs.columns.index(text_col)

    def make():
        score = scorer(model)

        def kernel(batch: pa.RecordBatch):
            best, _, margin, lead, _ = score(batch.column(place))
            yield batch.filter(pa.array(accepted(best, margin, lead)))

        return kernel

    return map_batches(docs, make, docs.schema, text_col, SLICE)
