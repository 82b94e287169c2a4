import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from stepwright.llm import langid as L

PIECES = tuple(sorted({bytes([b]) for b in range(256)} | {"▁a".encode(), b"ab", b"abc", b"bc", b"ca", "▁ab".encode(), "é".encode()}))


def enumerated(word: str, p: dict[bytes, float]) -> float:
    raw = L.MARK + word.encode()
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(raw)]
        share = 1.0
        for a, b in itertools.pairwise(at):
            share *= p.get(raw[a:b], 0.0)
        total += share
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(PIECES)), 3).T
    words = ["a", "ab", "abc", "abcabc", "é", "caé", "zz", "abcabcab"]
    got = L.word_scores(pa.array(words, pa.large_string()), L.trie_of(PIECES), p)
    for w, row in zip(words, got, strict=True):
        for k in range(3):
            assert row[k] == pytest.approx(np.log(enumerated(w, {x: p[i, k] for i, x in enumerate(PIECES)})), rel=1e-9)


def test_long_words_take_the_same_sum():
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(len(PIECES)), 2).T
    trie = L.trie_of(PIECES)
    words = ["abcab" * 11, "a", "abcé", "é" * 20, "ab" * 24]
    raw, start, length = L._laid(pa.array(words, pa.large_string()))
    assert length.max() <= L.LONG
    short = L.word_scores(pa.array(words, pa.large_string()), trie, p)
    assert L._long(raw, start, length, trie, p) == pytest.approx(short, rel=1e-9)
    assert np.isfinite(L.word_scores(pa.array(["abc" * 40_000], pa.large_string()), trie, p)).all()


def test_parts_multiply_to_the_whole():
    """Long words cut where no piece crosses, against the same words a byte at a time."""
    rng = np.random.default_rng(4)
    pieces = L.vocabulary()
    trie = L.trie_of(pieces)
    p = rng.dirichlet(np.ones(len(pieces)), 2).T
    letters = "漢字仮名交文日本語中国人民共和大学生会กขคงจabcthering한국어"
    words = ["".join(rng.choice(list(letters), n)) for n in (40, 50, 80, 300)] + ["international" * 30]
    raw, start, length = L._laid(pa.array(words, pa.large_string()))
    assert (length > L.LONG).all()
    assert L.word_scores(pa.array(words, pa.large_string()), trie, p) == pytest.approx(L._long(raw, start, length, trie, p), rel=1e-9)
    word, at, n = L.parts_of(raw, start, length, trie)
    assert np.bincount(word, n).tolist() == length.tolist() and (n[word < 4] <= L.LONG).any()


def test_letter_runs():
    assert L.letter_runs(pa.array(["a--B!!", "&&", "Été3x", ""], pa.large_string())).to_pylist() == [["a", "b"], [""], ["été", "x"], [""]]


TEXTS = {"en": "the cat sat on the mat and the dog ran over there with them that this", "de": "die katze und der hund laufen über die straße nicht auch eine schöne", "fr": "le chat et la souris dans une maison été où les enfants jouent avec"}


@pytest.fixture(scope="module")
def model():
    return L.fit({k: [v] * 3 for k, v in TEXTS.items()}, L.vocabulary())


def test_score_is_the_sum_over_words(model):
    score = L.scorer(model)
    texts = ["The cat!", "cat", "the", "", None, "42 -- !", "Straße und Haus", "x" * 200_000]
    best, rate, margin, lead, length = score(pa.array(texts, pa.string()))
    one = lambda w: L.word_scores(pa.array([w], pa.large_string()), L.trie_of(model.pieces), model.probabilities)[0]
    want = (one("the") + one("cat")) / (len("thecat") + 2 * len(L.MARK))
    assert rate[0] == pytest.approx(want.max(), rel=1e-9) and best[0] == want.argmax() and length[0] == 12
    assert best.tolist()[3:6] == [-1, -1, -1] and model.languages[best[6]] == "de"
    assert L.accepted(best, margin, lead).tolist()[3:6] == [False, False, False]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    m = L.train(docs, per_language=40)
    rng = random.Random(1)
    rows = docs.select("text", "lang").collect()
    rng.shuffle(rows)
    best, _, margin, lead, _ = L.scorer(m)(pa.array([r[0] for r in rows], pa.string()))
    right = np.mean([m.languages[b] == r[1] for b, r in zip(best, rows, strict=True)])
    assert right >= 0.985 and L.accepted(best, margin, lead).mean() >= 0.99
    junk = ["漢字 漢字 仮名", "Привет мир как дела", "12345 !!! ###", ""]
    best, _, margin, lead, _ = L.scorer(m)(pa.array(junk, pa.string()))
    assert not L.accepted(best, margin, lead).any()


def test_tables(spark, odd, none, model):
    got = {(r["doc_id"], r["language"] is None, r["accepted"]) for r in L.identify(odd, model).collect()}
    assert {(1, True, False), (2, True, False), (3, True, False), (4, True, False), (None, True, False)} <= got
    assert L.identify(odd, model).count() == odd.count()
    kept = L.keep_accepted(odd, model)
    assert kept.columns == odd.columns
    want = sorted(str(r["doc_id"]) for r in L.identify(odd, model).where("accepted").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert L.identify(none, model).collect() == [] and L.keep_accepted(none, model).collect() == []
    assert L.train(none).languages == ("und",)
    half = odd.withColumn("lang", F.when(F.col("doc_id") == 5, "aa").when(F.col("doc_id") == 7, "bb"))
    assert L.train(half).languages == ("aa", "bb")


def clause(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


CHINESE, THAI = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年", "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวสหอาิีเแโใไ"


def test_scripts_without_spaces(spark, docs_of):
    """Clauses of 22 and more characters, one-word texts, and a language that has nothing else."""
    rng = random.Random(5)
    texts = {"zh": [clause(rng, CHINESE, 40) + "。" + clause(rng, CHINESE, 22) for _ in range(30)], "th": [clause(rng, THAI, 60) for _ in range(30)], "en": [TEXTS["en"]] * 30}
    for some in (("zh",), ("zh", "en"), ("th", "en"), ("zh", "th", "en")):
        model = L.fit({k: texts[k] for k in some}, L.vocabulary())
        score = L.scorer(model)
        fresh = {"zh": [clause(rng, CHINESE, 50), clause(rng, CHINESE, 1000)], "th": [clause(rng, THAI, 30), clause(rng, THAI, 1000)], "en": ["the cat and the mat", "that"]}
        for k in some:
            best, _, margin, lead, _ = score(pa.array(fresh[k], pa.string()))
            assert [model.languages[b] for b in best] == [k, k] and L.accepted(best, margin, lead).all()
    rows = docs_of([(i, t) for i, t in enumerate(texts["zh"] + texts["en"])]).withColumn("lang", F.when(F.col("doc_id") < 30, "zh").otherwise("en"))
    got = L.identify(rows, L.train(rows))
    assert got.where("accepted").count() == 60 and got.join(rows.select("doc_id", "lang"), "doc_id").where("language = lang").count() == 60


def test_unspaced_text_costs_like_spaced():
    import time

    rng = random.Random(6)
    pieces = L.vocabulary()
    trie, p = L.trie_of(pieces), np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 4).T
    clauses = pa.array([clause(rng, CHINESE, 30) for _ in range(3000)], pa.large_string())
    words = pa.array(sorted({clause(rng, "etaoinshrdlucm", 8) for _ in range(30_000)}), pa.large_string())

    def rate(x):
        took = []
        for _ in range(3):
            t = time.perf_counter()
            L.word_scores(x, trie, p)
            took.append(time.perf_counter() - t)
        return min(took) / sum(len(w.encode()) for w in x.to_pylist())

    assert rate(clauses) < 2 * rate(words)
