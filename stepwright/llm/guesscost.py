"""Operator 7. Secret scans by password guess cost.

Values in credential context are given the least number of guesses that a
segmentation into patterns needs. A context is

* an identifier that ends in a key word such as password, token or api_key,
  then = or :, then a value, in quotes or not;
* what follows a prefix that an issuer gives its keys, or the word Bearer;
* the password of a URL (scheme://user:password@host);
* a private key between its BEGIN and END lines.

A dynamic program over prefixes takes the minimum of log10 guesses over all
segmentations into

* words: rank in a list of common passwords and then the whole words of a
  public vocabulary in the order of their merges, times case and leet variants,
* dates: days in the years that are usual,
* repeats: of a unit, at the unit's own cost times the times,
* keyboard walks: starts and turns on a keyboard's rows and columns,
* brute force: the alphabet of the characters that occur, for each character.

Each further segment also pays SEGMENT. A value is a secret if its cost reaches
THRESHOLD; placeholders and guessable values stay below it. One matcher, the
JVM's, finds and replaces values; Python only costs them.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import free_names, once

#: log10 guesses from which a value counts as a secret.
THRESHOLD = 10.0
#: log10 cost of each segment after the first.
SEGMENT = 0.5
#: Fewest characters of a value after a key word: 4 cost at most 4 * log10(195), which is below THRESHOLD. A value has no greatest length.
SHORTEST = 5
#: A public byte-pair vocabulary whose whole words, in the order of their merges, are the ranked word list.
WORD_LIST = "/opt/tokenizers/byte_bpe_50k.tiktoken"

KEY = r"pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|authorization|(?:api|access|auth|private|secret|signing|encryption|master|account|shared|client)[_-]?key"
#: Prefixes of issued keys; hinted() has a part of each.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "npm_", "hf_")
#: White space of any kind and control characters, in a class of Java's expressions.
BLANK = r"\p{Cc}\p{Z}\x{200B}\x{FEFF}"
_QUOTES = "\"'`"
_VALUE = "|".join([*(f"(?<={q})[^{BLANK}{q}]{{{SHORTEST},}}+" for q in _QUOTES), f"(?<![{_QUOTES}])[^{BLANK}{_QUOTES}<>,;]{{{SHORTEST},}}+"])
#: Pairs of what stays and what is a value, one pair for each kind of context; the last group is the end of a URL's password or of a private key.
CONTEXT = (
    rf"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]*?(?i:{KEY})\\*+[{_QUOTES}]?[{BLANK}]*+(?::=|=>|[:=])[{BLANK}]*+(?:(?i:bearer|basic)[{BLANK}]++)?+\\*+[{_QUOTES}]?)({_VALUE})"
    rf"|(?<![A-Za-z0-9])({'|'.join(PREFIXES)})([A-Za-z0-9_-]{{16,}}+)"
    rf"|(?<![A-Za-z0-9])([Bb]earer[{BLANK}]++|BEARER[{BLANK}]++)([A-Za-z0-9._~+/=-]{{16,}}+)"
    rf"|(://[^{BLANK}/:@\"'<>]*+:)([^{BLANK}/@\"'<>]{{{SHORTEST},}}+)(?=@)"
    rf"|(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)((?s:.+?)(?=-----END)|(?:[{BLANK}]*+[A-Za-z0-9+/=]{{16,}}+)++(?:[{BLANK}]*+[A-Za-z0-9+/]+={{1,2}})?)"
)
KINDS = 5

WORDS = (
    "password 123456 admin letmein welcome monkey dragon master login abc123 iloveyou sunshine princess football shadow superman michael "
    "changeme default secret test example user root guest demo sample token key your here insert placeholder none null true false todo "
    "love hello summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday the and for you with this that from have not are was but all can one new "
    "server database mysql oracle postgres system local public private access api auth account service client dev prod stage home work "
    "computer internet company office business money bank credit black white red green blue yellow orange purple silver gold diamond "
    "tiger lion eagle wolf bear horse snake star moon sun sky earth fire water ice wind storm thunder flower rose lily angel baby "
    "john james robert david william richard thomas charles daniel george mary anna maria laura lisa jessica ashley amanda nicole"
).split()
LEET = str.maketrans("4@31!05$7", "aaeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_SHIFTED = dict(zip('~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?', "`1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./", strict=True))
_DATE = re.compile(r"(?=(\d{8}|\d{6}|\d{1,4}[-/._]\d{1,2}[-/._]\d{1,4}|\d{4}))")
#: Characters that join words; each is a word of its own.
SEPARATORS = "_-."
#: Values whose results are kept at most.
KNOWN = 4096


def ranked_words(path: str | None = WORD_LIST) -> dict[str, int]:
    """Rank of each word in lower case: WORDS, then the vocabulary's words of three letters or more; WORDS alone without a path."""
    words = list(WORDS)
    if path:
        for token in map(bytes.split, Path(path).read_bytes().splitlines()):
            word = base64.b64decode(token[0]).decode("utf-8", "replace")
            if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                words.append(word[1:].lower())
    return {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}


class Words:
    """Ranked words and what they begin with; one is enough for a process."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.begins = {w[:k] for w in rank for k in range(1, len(w) + 1)}

    def of(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(start, stop, log10 guesses) of each part of value that is a word."""
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        for i in range(len(value)):
            for j in range(i + 1, len(value) + 1):
                a, b = low[i:j], plain[i:j]
                if a not in self.begins and b not in self.begins:
                    break
                if j - i < 3:
                    continue
                if a in self.rank:
                    yield i, j, math.log10(self.rank[a] * _cased(value[i:j]) + 1)
                elif b in self.rank:
                    yield i, j, math.log10(self.rank[b] * 2 ** sum(x != y for x, y in zip(a, b, strict=True)) * _cased(value[i:j]) + 1)


def _cased(part: str) -> int:
    """How many ways of writing a word in capitals are as usual as that of part."""
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 1
    return 2 if part[0].isupper() and upper == 1 or upper == len(part) else 2 + sum(math.comb(len(part), k) for k in range(1, min(upper, len(part) - upper) + 1))


def words_of(rank: dict[str, int] | None) -> Words:
    """The words of a rank table, made once in a process; those of WORD_LIST if there is none."""
    return once(("words", len(rank) if rank else 0, hash(tuple(rank.items())) if rank else 0), lambda: Words(rank or ranked_words()))


def _date(part: str) -> float | None:
    """log10 guesses of a calendar date (in any order of its parts) or a year from 1900 to 2049."""
    digits = re.sub(r"\D", "", part)
    if len(part) == 4 and part.isdigit():
        return math.log10(150) if 1900 <= int(part) < 2050 else None
    pieces = re.split(r"[-/._]", part)
    if len(pieces) == 3:
        orders = [(pieces[0], pieces[1], pieces[2]), (pieces[2], pieces[1], pieces[0]), (pieces[2], pieces[0], pieces[1])]
    elif len(digits) == 8:
        orders = [(digits[:4], digits[4:6], digits[6:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])]
    else:
        orders = [(digits[:2], digits[2:4], digits[4:]), (digits[4:], digits[2:4], digits[:2]), (digits[4:], digits[:2], digits[2:4])]
    for y, m, d in orders:
        year = int(y) + (2000 if len(y) == 2 else 0)
        if len(y) in (2, 4) and 1900 <= year < 2100 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
            return math.log10(365 * 150 * (4 if len(pieces) == 3 else 1))
    return None


def _keyed(value: str) -> Iterator[tuple[int, int, list[int]]]:
    """(start, stop, turns) of the longest runs of at least 3 neighbouring keys; turns[k] counts the turns up to the key k of the run."""
    keys = [_AT.get(_SHIFTED.get(c, c)) for c in value]
    start, last, turns = 0, None, [0]
    for j in range(1, len(value) + 1):
        step = None
        if j < len(value) and keys[j] is not None and keys[j - 1] is not None:
            step = (keys[j][0] - keys[j - 1][0], keys[j][1] - keys[j - 1][1])
            if step == (0, 0) or abs(step[0]) > 1 or abs(step[1]) > 1:
                step = None
        if step is None:
            if j - start >= 3:
                yield start, j, turns
            start, turns = j, [0]
        else:
            turns.append(turns[-1] + (step != last))
        last = step


@functools.lru_cache(1 << 16)
def _mixed(length: int, less: int) -> float:
    if less <= 30:
        return math.log10(math.comb(length, less) + 1)
    return (math.lgamma(length + 1) - math.lgamma(less + 1) - math.lgamma(length - less + 1)) / math.log(10)


def _walk_cost(length: int, turns: int, shift: int) -> float:
    extra = 0 if not shift else 0.3 if shift == length else _mixed(length, min(shift, length - shift))
    return math.log10(47 * (length - 1)) + turns * math.log10(4) + extra


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, stop, log10 guesses) of runs of at least 3 neighbouring keys."""
    for start, stop, turns in _keyed(value):
        shifts = list(itertools.accumulate((c in _SHIFTED for c in value[start:stop]), initial=0))
        for i in range(stop - start):
            for j in range(i + 3, stop - start + 1):
                yield start + i, start + j, _walk_cost(j - i, 1 + turns[j - 1] - turns[i + 1], shifts[j] - shifts[i])


def _brute(value: str) -> float:
    """log10 of the alphabet from which one character of the value is drawn."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    if size in (36, 62) and all(c in "0123456789abcdefABCDEF" for c in value):
        size = 16
    return math.log10(max(size, 2))


def patterns(value: str, words: Words) -> Iterator[tuple[int, int, float, str]]:
    """(start, stop, log10 guesses, kind) of every pattern but brute force."""
    yield from _fixed(value, words)
    for i, j, cost in _walks(value):
        yield i, j, cost, "walk"


def _fixed(value: str, words: Words) -> Iterator[tuple[int, int, float, str]]:
    """patterns() of bounded length: words and dates."""
    n = len(value)
    for i in range(n):
        if value[i] in SEPARATORS:
            yield i, i + 1, math.log10(1 + len(SEPARATORS)), "word"
    for i, j, cost in words.of(value):
        yield i, j, cost, "word"
    for m in _DATE.finditer(value):
        # Shorter readings of the same digits count as well.
        for stop in {m.end(1), *(m.start() + k for k in (4, 6, 8))}:
            part = value[m.start() : stop]
            if stop <= n and (part.isdigit() and len(part) in (4, 6, 8) or not part.isdigit() and re.fullmatch(r"\d{1,4}[-/._]\d{1,2}[-/._]\d{1,4}", part)):
                cost = _date(part)
                if cost is not None:
                    yield m.start(), stop, cost, "date"


def guess(value: str, known: dict[str, tuple[float, str]] | None = None, words: Words | None = None) -> tuple[float, str]:
    """(log10 guesses, kinds joined by +) of the cheapest segmentation; an empty value costs 0. known keeps results between calls."""
    known = {} if known is None else known
    words = words or words_of(None)
    if value in known:
        return known[value]
    n = len(value)
    if not n:
        return 0.0, ""
    alphabet = _brute(value)
    found: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i, j, cost, kind in _fixed(value, words):
        found[j].append((i, cost, kind))
    walk: dict[int, tuple[int, list[int], list[int]]] = {}
    for start, stop, turns in _keyed(value):
        shifts = list(itertools.accumulate((c in _SHIFTED for c in value[start:stop]), initial=0))
        for j in range(start + 3, stop + 1):
            walk[j] = start, turns, shifts
    walks = _Starts()
    same = [0] * (min(16, n // 2) + 1)
    repeats: list[dict[int, _Starts]] = [{} for _ in same]
    # best[j]: cheapest cost of value[:j] and how its last segment begins; brute force runs from any start.
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    begin = lambda i: best[i][0] + (SEGMENT if i else 0.0)
    run = (math.inf, 0)  # cheapest (cost before a brute-force run, less its characters' share; start)
    for j in range(1, n + 1):
        before = best[j - 1][0] + (SEGMENT if j > 1 else 0.0) - alphabet * (j - 1)
        if before < run[0] - 1e-12:
            run = (before, j - 1)
        choice = (run[0] + alphabet * j, run[1], "brute")
        if j in walk:
            start, turns, shifts = walk[j]
            mixed = 0 < shifts[-1] < len(turns)
            if j == start + 3:
                walks = _Starts()
            # A later start saves its turns; what is left grows with the logarithm of the length alone, if keys are all shifted or none is.
            walks.add(j - 3, begin(j - 3) - math.log10(4) * turns[j - 2 - start], 2, 1, not mixed)
            for i in reversed(walks.at):
                found[j].append((i, _walk_cost(j - i, 1 + turns[j - 1 - start] - turns[i + 1 - start], shifts[j - start] - shifts[i - start]), "walk"))
        for size in range(1, len(same)):
            if j <= size or value[j - 1] != value[j - 1 - size]:
                if same[size]:
                    same[size] = 0
                    repeats[size].clear()
                continue
            same[size] += 1
            least = 3 if size == 1 else 2
            if same[size] >= size * (least - 1):
                starts = repeats[size].setdefault(j % size, _Starts())
                starts.add(j - size * least, begin(j - size * least), least, size)
                unit = value[j - size : j]
                inner = guess(unit, known, words)[0] if size < n else alphabet * size
                for i in reversed(starts.at):
                    found[j].append((i, inner + math.log10((j - i) // size), "repeat"))
        for i, cost, kind in found[j]:
            total = begin(i) + cost
            if total < choice[0] - 1e-12:
                choice = (total, i, kind)
        found[j] = []
        best.append(choice)
    kinds, j = [], n
    while j:
        kinds.append(best[j][2])
        j = best[j][1]
    if len(known) >= KNOWN:
        known.clear()
    known[value] = best[n][0], "+".join(reversed(kinds))
    return known[value]


class _Starts:
    """Starts of segments that can still be the cheapest, in order, where a segment costs log10 of its length besides what its start has cost.

    A later start is left out if an earlier one is cheaper for every stop to come: log10((t + m) / t) is greatest at
    the least length t. An earlier one goes if a later one costs no more. So long values stay exact without all pairs.
    """

    def __init__(self):
        self.at: list[int] = []
        self.cost: list[float] = []

    def add(self, i: int, cost: float, least: int, size: int, prune: bool = True) -> None:
        if prune:
            if any(c + math.log10(1 + (i - a) / (size * least)) <= cost for a, c in zip(self.at, self.cost, strict=True)):
                return
            while self.at and self.cost[-1] >= cost:
                self.at.pop()
                self.cost.pop()
        self.at.append(i)
        self.cost.append(cost)


def hinted(text: Column) -> Column:
    """Cheap test that every text with a context passes: a sign and a part of a key word, or what begins one of the other kinds."""
    has = lambda t, *parts: functools.reduce(lambda x, y: x | y, (F.contains(t, F.lit(p)) for p in parts))
    # The lambda takes the text in lower case once; each use of F.lower(text) would make it anew.
    named = has(text, ":", "=") & F.exists(F.array(F.lower(text)), lambda low: has(low, "key", "token", "secret", "pass", "pwd", "credential", "authorization"))
    issued = has(text, "IA", "AIza", "glpat-", "xox") | has(text, "_") & has(text, *(p for p in PREFIXES if p.endswith("_")))
    return named | issued | has(text, "earer", "EARER") | has(text, "PRIVATE KEY") | (has(text, ":") & has(text, "://") & has(text, "@"))


def _group(found: Column, k: int) -> Column:
    """Group k (1: what stays before the value, 2: the value) of a context, whichever its kind; the value is what the rest of it is."""
    head = F.concat(*(F.regexp_extract(found, HEAD, i + 1) for i in range(KINDS)))
    return head if k == 1 else F.substr(found, F.length(head) + 1)


#: What stays of a context that was found, before its value: a kind for each group.
HEAD = (
    rf"^(?:([A-Za-z0-9_-]*?(?i:{KEY})\\*+[{_QUOTES}]?[{BLANK}]*+(?::=|=>|[:=])[{BLANK}]*+(?:(?i:bearer|basic)[{BLANK}]++)?+\\*+[{_QUOTES}]?)(?={_VALUE})"
    rf"|({'|'.join(PREFIXES)})|([Bb]earer[{BLANK}]++|BEARER[{BLANK}]++)|(://[^{BLANK}/:@\"'<>]*+:)|(-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----))"
)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, word_list: str | None = WORD_LIST) -> DataFrame:
    """doc_id, place, key, value_sha256, log10_guesses, segments, secret: one row for each value in credential context.

    place counts a document's values from 1; key is the identifier in lower case, the issuer's prefix, bearer, url or
    private key. A value after a key word ends before white space of any kind, and, if it is not in quotes, before a
    comma, a semicolon, a quote or an angle bracket. The value itself is not returned, only its SHA-256. Null, empty
    and context-free texts give no rows; repeated rows and values each give theirs; a null doc_id stays null; an empty
    table gives no rows; texts and values of any length are scanned, costed and hashed whole; other columns are not
    looked at. The pattern runs in the JVM, only values go to Python.
    """
    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(hinted(F.col("text")))
    rows = chosen.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(CONTEXT), F.lit(0))).alias("p", "found"))
    rows = rows.select("doc_id", (F.col("p") + 1).alias("place"), _group(F.col("found"), 1).alias("head"), _group(F.col("found"), 2).alias("value"))
    key = F.when(F.startswith("head", F.lit("://")), "url").when(F.startswith("head", F.lit("-----BEGIN")), "private key").otherwise(F.lower(F.regexp_extract("head", "^[A-Za-z0-9_-]+", 0)))
    rows = rows.select("doc_id", "place", key.alias("key"), "value")
    rank = ranked_words(word_list)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, str]] = {}
        words = words_of(rank)
        for b in batches:
            got = [guess(v, known, words) for v in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([round(c, 6) for c, _ in got], pa.float64()), pa.array([k for _, k in got], pa.string())], names=[*b.schema.names, "log10_guesses", "segments"])

    kind = docs.schema[id_col].dataType.simpleString()
    costed = rows.mapInArrow(cost, f"doc_id {kind}, place int, key string, value string, log10_guesses double, segments string")
    return costed.select("doc_id", "place", "key", F.sha2("value", 256).alias("value_sha256"), "log10_guesses", "segments", (F.col("log10_guesses") >= threshold).alias("secret"))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD, word_list: str | None = WORD_LIST) -> DataFrame:
    """docs with the values that findings() calls secret replaced by [REDACTED] in text_col, and length_col (if there is one) brought up to date.

    All rows and columns stay, whatever their names; null texts stay null, and texts without a secret, empty ones and
    repeated rows among them, as they are; values are replaced whole, however long; an empty table stays empty. The JVM's
    matcher that finds the values also parts the text at them; only the values go to Python, to be costed.
    """
    found, verdict = free_names(docs, "found", "verdict")
    rank = ranked_words(word_list)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, tuple[float, str]] = {}
        words = words_of(rank)
        for lists in batches:
            yield pa.array([None if v is None else [round(guess(x, known, words)[0], 6) >= threshold for x in v] for v in lists.to_pylist()], pa.list_(pa.bool_()))

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.withColumn(found, F.regexp_extract_all(F.when(hinted(text), text), F.lit(CONTEXT), F.lit(0)))
    out = out.withColumn(verdict, F.arrow_udf("array<boolean>")(judge)(F.when(F.size(found) > 0, F.transform(found, lambda f: _group(f, 2)))))
    changed = F.zip_with(found, verdict, lambda f, secret: F.when(secret, F.concat(_group(f, 1), F.lit("[REDACTED]"))).otherwise(f))
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, CONTEXT, -1), changed, lambda piece, value: F.array(piece, F.coalesce(value, F.lit(""))))), "")
    out = out.withColumn(text_col, F.when(F.exists(verdict, lambda x: x), whole).otherwise(text)).drop(found, verdict)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out
