import random

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import ODD, prose

from stepwright.llm import decontam as D


def least(item: bytes, text: bytes) -> int:
    """Least edit distance of the item to a substring of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def plain(text: str) -> bytes:
    raw, offsets = D.normalised(pa.array([text], pa.string()))
    return raw[offsets[0] : offsets[1]].tobytes()


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            if t is None or x is None:
                continue
            body = plain(x).strip(b" ")
            if len(body) >= D.LEAST and (k := least(body, plain(t))) <= int(len(body) * D.RATE):
                out.add((d, i, k))
    return out


def edits(text: str, n: int, rng) -> str:
    s = list(text)
    for _ in range(n):
        k = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[k] = rng.choice("abcxyz")
        elif kind == 1:
            s.insert(k, rng.choice("abc xyz"))
        else:
            del s[k]
    return "".join(s)


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, docs_of):
    rng = random.Random(2)
    items = [(k, prose(k + 500, 12 + k % 5)) for k in range(14)] + [(90, "short"), (91, None), (None, prose(3, 15)), (92, "")]
    docs = []
    for k in range(60):
        i, x = items[k % 14]
        docs.append((k, prose(k, 14) + " " + edits(x, rng.randrange(0, 9), rng) + " " + prose(k + 70, 10)))
    docs += [(200, items[0][1]), (201, items[1][1].upper().replace(" ", "  -- ")), (202, prose(77, 30)), (203, items[2][1] + items[2][1]), (204, items[3][1][:-3])]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.matches(docs_of(docs), table(spark, items)).collect()}
    want = brute(docs, [x for x in items if x[0] is not None])
    assert got == want
    assert len({k for *_, k in got}) > 3  # several distances occur
    kept = D.keep_clean(docs_of(docs), table(spark, items))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in got}


def test_benchmark_in_parts(spark, docs_of, monkeypatch):
    items = [(k, prose(k + 900, 14)) for k in range(9)]
    docs = [(k, prose(k, 20) + " " + items[k][1]) for k in range(9)] + [(50, prose(50, 30))]
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 200)
    assert len(D._parts(table(spark, items), "item_id", "text")) > 2
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs_of(docs), table(spark, items)).collect()}
    assert got == {(k, k) for k in range(9)}
    assert {r["doc_id"] for r in D.keep_clean(docs_of(docs), table(spark, items)).collect()} == {50}


def test_bound_is_the_lemma():
    index = D.Index([1], [prose(1, 40)])
    m, e = int(index.length[0]), int(index.edits[0])
    assert index.bound[0] == m + 1 - D.Q - D.Q * e > 0


@pytest.mark.parametrize("seed", range(4))
def test_verify_equals_brute_force(seed):
    rng = random.Random(seed)
    item = prose(seed, 12)
    index = D.Index([1], [item])
    text = prose(seed + 50, 6) + " " + edits(item, rng.randrange(5), rng) + " " + prose(seed + 60, 4)
    raw = np.frombuffer(plain(text), np.uint8)
    body = index.items[0].tobytes()
    lows = np.arange(-len(body), len(raw), int(index.edits[0]) + 1)
    assert index.verify(raw, 0, lows).min() == least(body, raw.tobytes())


def test_odd_rows(spark, odd, none):
    items = table(spark, [(1, prose(1, 14)), (1, prose(1, 14)), (2, "x" * 60)])
    got = sorted((r["doc_id"], r["item_id"]) for r in D.matches(odd, items).collect())
    assert got == [(8, 2)]
    assert D.keep_clean(odd, items).count() == len(ODD) - 1 and D.keep_clean(odd, items).columns == odd.columns
    assert D.matches(none, items).collect() == [] and D.matches(odd, table(spark, [])).collect() == []
    assert D.keep_clean(odd, table(spark, [])).count() == len(ODD)


def crowded(text: str, gap: int, n: int) -> str:
    """n letters of the text's first part replaced, gap characters apart; the rest is as it was."""
    s = list(text)
    for k in range(n):
        at = 5 + k * gap
        s[at] = "q" if s[at] != "q" else "z"
    return "".join(s)


def test_edits_in_one_part_of_an_item(spark, docs_of):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvwxy") for _ in range(n))
    items = [(0, letters(81)), (1, letters(200)), (2, letters(300)), (3, letters(394)), (4, letters(700))]
    docs = []
    for i, x in items[1:]:
        budget = int(len(x) * D.RATE)
        for gap in (9, 10, 11, 12, 13):
            for n in (budget, budget - 2):
                docs.append((len(docs), letters(150) + " " + crowded(x, gap, n) + " " + letters(120)))
    docs.append((len(docs), letters(600)))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.matches(docs_of(docs), table(spark, items)).collect()}
    assert {(d, i) for d, i, _ in got} == {(k, 1 + k // 10) for k in range(40)}
    few = [k for k in range(0, 40, 7) if k < 30]
    assert {x for x in got if x[0] in few} == {x for k in few for x in brute([docs[k]], [items[1 + k // 10]])}


def test_ids_of_any_type_and_repeated_ids(spark, docs_of):
    import datetime
    import decimal

    x, y = prose(601, 16), prose(602, 16)
    docs = docs_of([(1, prose(1, 20) + " " + x), (2, prose(2, 20) + " " + y + " " + x), (2, prose(2, 20) + " " + y + " " + x), (3, prose(3, 40))])
    for kind, value in (("smallint", 7), ("tinyint", 7), ("double", 7.5), ("string", "seven"), ("decimal(9,2)", decimal.Decimal("7.25")), ("date", datetime.date(2020, 1, 2)), ("boolean", True)):
        items = spark.createDataFrame([(value, x), (value, y), (value, y), (None, x)], f"item_id {kind}, text string")
        got = D.matches(docs, items)
        assert got.schema["item_id"].dataType.simpleString() == kind
        assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == [(1, value, 0), (2, value, 0), (2, value, 0)]
        assert [r["doc_id"] for r in D.keep_clean(docs, items).collect()] == [3]
    near = spark.createDataFrame([(1, x[:-3] + "zz"), (1, x)], "item_id int, text string")
    assert {r["distance"] for r in D.matches(docs, near).collect()} == {0}


def test_too_short(spark):
    items = [(1, "x" * 39), (2, "x" * 40), (3, None), (4, "  " + "x" * 39 + "!! "), (5, ""), (6, "a - b" * 14)]
    assert sorted(r["item_id"] for r in D.too_short(table(spark, items)).collect()) == [1, 3, 4, 5]
