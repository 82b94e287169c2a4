import numpy as np
import pyarrow as pa
import pytest
from llm_texts import ODD, prose

from stepwright.llm import simhash as S


def groups(links, n):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def edited(text: str, seed: int, every: int) -> str:
    rng = np.random.default_rng(seed)
    words = text.split()
    for k in rng.choice(len(words), max(1, len(words) // every), replace=False):
        words[k] = f"new{rng.integers(1000)}"
    return " ".join(words)


def brute(rows):
    """Groups by all pairs of fingerprints."""
    texts = pa.array([t for _, t in rows], pa.string())
    bits, count = S.fingerprints(texts)
    p = bits.view(np.uint64).reshape(-1, 2)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if count[i] and count[j] and np.bitwise_count(p[i] ^ p[j]).sum() <= S.RADIUS]
    g = groups(links, len(rows))
    return {(rows[k][0], rows[g[k]][0]) for k in range(len(rows)) if g[k] != k}


def test_fingerprint_is_the_majority():
    texts = ["a b c d e", "The cat, the CAT!", "", "... --"]
    bits, count = S.fingerprints(pa.array(texts))
    assert count.tolist() == [5, 2, 0, 0]
    words = ["a", "b", "c", "d", "e"]
    each, _ = S.fingerprints(pa.array(words))
    votes = np.unpackbits(each, axis=1).sum(0) * 2 > len(words)
    assert np.array_equal(np.unpackbits(bits[0]), votes.astype(np.uint8))


def test_pivots_never_discard_a_near_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    flips = base.copy()
    for k in range(400):
        for b in rng.choice(128, rng.integers(0, 40), replace=False):
            flips[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    points = np.concatenate([base, flips])
    table = [S.distances(points, p) for p in (0, 5, 400, 777)]
    near = np.flatnonzero(np.bitwise_count(base ^ flips).sum(1) <= S.RADIUS)
    assert len(near) > 50
    others = np.arange(400, 800)
    for k in near:
        assert 400 + k in S.possible(table, np.array([k]), others, S.RADIUS)
    i, j = S.near(points[:400], points[400:], S.RADIUS)
    assert set(near) <= set(i[i == j])
    apart = np.bitwise_count(points[:, None] ^ points[None]).sum(2)
    assert set(zip(*S.near(points, points, S.RADIUS), strict=True)) == set(zip(*np.nonzero(apart <= S.RADIUS), strict=True))


def test_a_familys_pivot_discards_the_others():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64) * np.uint64(2)
    points[:300] = points[0] ^ (np.uint64(1) << rng.integers(0, 64, (300, 2)).astype(np.uint64))
    left = S.possible([S.distances(points, 0)], np.arange(256), np.arange(300, 5000), S.RADIUS)
    assert len(left) < 0.01 * 4700


def test_linked_is_a_spanning_forest():
    """Families of copies, chains and single points in small and large blocks, against all pairs."""
    rng = np.random.default_rng(6)

    def flipped(x, most):
        x = x.copy()
        for b in rng.choice(128, rng.integers(0, most + 1), replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        return x

    for singles, families in ((0, []), (1, []), (300, [5, 2]), (900, [400, 3, 3]), (100, [1500]), (400, [700, 600, 90, 31])):
        points = list(rng.integers(0, 2**63, (singles, 2)).astype(np.uint64))
        for n in families:
            family = [rng.integers(0, 2**63, 2).astype(np.uint64)]
            while len(family) < n:
                family.append(flipped(family[rng.integers(0, len(family))], 12))
            points += family
        points = rng.permutation(np.array(points, np.uint64).reshape(-1, 2))
        a, b = S.linked(points, S.RADIUS)
        d = np.bitwise_count(points[:, None] ^ points[None]).sum(2)
        assert groups(list(zip(a, b, strict=True)), len(points)) == groups(list(zip(*np.nonzero(d <= S.RADIUS), strict=True)), len(points))


def test_planned_recall():
    rng = np.random.default_rng(3)
    for points in (100, 1 << 20, 1 << 27):
        width, n = S.planned(points)
        a = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
        flip = np.zeros((3000, 128), np.uint8)
        for k in range(3000):
            flip[k, rng.choice(128, S.RADIUS, replace=False)] = 1
        b = np.packbits(np.unpackbits(a, axis=1) ^ flip, axis=1)
        met = (S.blocks_of(a, width, n) == S.blocks_of(b, width, n)).any(1).mean()
        assert met >= S.RECALL - 0.02


def test_groups_equal_brute_force(docs_of):
    rows = []
    for k in range(60):
        base = prose(k, 120 + k)
        rows.append((len(rows), base))
        rows += [(len(rows) + j, edited(base, j, 25)) for j in range(k % 4)]
        if k % 10 == 0:
            rows += [(len(rows) + j, base.upper() + "!") for j in range(3)]
    want = brute(rows)
    got = {(r["doc_id"], r["kept_doc_id"]): r["distance"] for r in S.duplicates(docs_of(rows)).collect()}
    assert len(set(got) & want) >= 0.97 * len(want) and not set(got) - want
    kept = {r["doc_id"] for r in S.keep_first(docs_of(rows)).collect()}
    assert kept == {i for i, _ in rows} - {a for a, _ in got}


def far_pairs(n: int):
    """Rows of n pairs of documents whose fingerprints differ by RADIUS - 2 to RADIUS bits."""
    one = [prose(k, 60) for k in range(12 * n)]
    two = [edited(t, k, 16) for k, t in enumerate(one)]
    p, q = (S.fingerprints(pa.array(x))[0].view(np.uint64).reshape(-1, 2) for x in (one, two))
    d = np.bitwise_count(p ^ q).sum(1)
    found = np.flatnonzero((d <= S.RADIUS) & (d >= S.RADIUS - 2))[:n]
    assert len(found) == n
    return [(k, x) for k, i in enumerate(found) for k, x in ((2 * k, one[i]), (2 * k + 1, two[i]))]


def test_no_link_near_the_radius_is_lost(docs_of):
    rows = far_pairs(150)
    want = brute(rows)
    assert len(want) >= 150
    assert {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()} == want


def at_the_radius(singles: int, pairs: int, seed: int):
    """Single points and, at the end, pairs that differ by RADIUS bits."""
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 2**63, (singles + pairs, 2)).astype(np.uint64)
    two = one[singles:].copy()
    for k in range(pairs):
        for b in rng.choice(128, S.RADIUS, replace=False):
            two[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.concatenate([one, two])


def test_the_index_meets_all_pairs():
    """Of one cell and of two, against all pairs; in blocks of each number."""
    points = at_the_radius(9000, 500, 8)
    a, b = S.linked(points, S.RADIUS)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == {(k + 500, k) for k in range(9000, 9500)} and S.indexed(len(points), len(points), S.RADIUS)
    second = np.arange(len(points)) >= 9500
    a, b = S.linked(points, S.RADIUS, second)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} >= {(k + 500, k) for k in range(9000, 9500)}
    for blocks in range(1, S.RADIUS + 2):
        reach = S.probes(blocks, S.RADIUS)
        assert len(reach) == blocks and sum(r + 1 for r in reach) == S.RADIUS + 1 and min(reach) >= 0


def test_cells_lose_no_pair(spark, monkeypatch):
    points = at_the_radius(200, 300, 9)
    halves = points.view(np.int64)
    table = spark.createDataFrame([(k, int(h), int(x)) for k, (h, x) in enumerate(halves)], "node long, hi long, lo long")
    for cell in (S.CELL, 300):
        monkeypatch.setattr(S, "CELL", cell)
        got = {(r["a"], r["b"]) for r in S.links(table, len(points)).collect()}
        assert got == {(k + 300, k) for k in range(200, 500)}


def test_large_block_of_equal_and_near_points(docs_of):
    base = prose(1, 300)
    rows = [(k, edited(base, k, 60)) for k in range(700)]
    got = {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()}
    assert got == {(k, 0) for k in range(1, 700)}


def test_hot_blocks_in_cells(docs_of, monkeypatch):
    """Blocks cut into cells give the groups of whole blocks."""
    rows = [(k, edited(prose(k % 3, 300), k, 60)) for k in range(150)] + [(k, prose(k, 50)) for k in range(200, 230)]
    want = {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()}
    monkeypatch.setattr(S, "CELL", 16)
    assert {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()} == want and len(want) >= 147


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        S.duplicates(spark.createDataFrame([("a", "b c")], "doc_id string, text string"))
    assert S.duplicates(spark.createDataFrame([(5, "b c"), (3, "b c")], "doc_id smallint, text string")).collect()[0]["kept_doc_id"] == 3


def test_chain_of_links_is_one_group(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(90)] + [(200, 150), (300, 150)], "a long, b long")
    got = {(r["node"], r["root"]) for r in S.components(edges).collect()}
    assert {x for x in got if x[0] != x[1]} == {(k, 0) for k in range(1, 91)} | {(200, 150), (300, 150)}


def test_odd_rows(odd, none):
    got = {(r["doc_id"], r["kept_doc_id"], r["distance"]) for r in S.duplicates(odd).collect()}
    assert got == {(6, 5, 0)}
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert S.duplicates(none).collect() == [] and S.keep_first(none).collect() == []


def test_texts_of_one_id_each_have_their_links(docs_of):
    """Each of two texts under one id is met by a copy, whichever fingerprint sorts first; no text goes for the other's sake."""
    a, b = prose(1, 300), prose(2, 300)
    near_a, near_b = edited(a, 1, 60), edited(b, 2, 60)
    rows = [(7, a), (7, b), (7, None), (3, near_a), (9, near_b), (9, near_b), (12, prose(3, 300))]
    got = {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()}
    assert got == {(7, 3), (9, 7)}
    kept = {(r["doc_id"], r["text"]) for r in S.keep_first(docs_of(rows)).collect()}
    assert kept == {(7, b), (7, None), (3, near_a), (12, prose(3, 300))}
    # The smallest id of two groups joins them no more than their texts do, and a copy of itself is none.
    rows = [(1, a), (1, b), (1, edited(a, 5, 60)), (2, near_a), (4, near_b)]
    assert {(r["doc_id"], r["kept_doc_id"]) for r in S.duplicates(docs_of(rows)).collect()} == {(2, 1), (4, 1)}
    assert S.keep_first(docs_of(rows)).count() == 3
