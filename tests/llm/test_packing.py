import bisect
import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import ODD

from stepwright.llm import packing


def brute(lengths: list[int], context: int) -> list[int]:
    """Best-fit decreasing over single pieces: the contents' sums of the bins, the fullest bin that fits (the oldest of equals)."""
    free: list[tuple[int, int]] = []
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, (n, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = context, len(bins)
            bins.append(0)
        bins[b] += n
        bisect.insort(free, (room - n, b))
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 41))
def test_plan_is_best_fit_decreasing(lengths, context):
    histogram = dict(Counter(lengths))
    runs, bins = packing.plan(histogram, context)
    fill: dict[int, list[tuple[int, int]]] = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, n, each, first, offset in runs:
        ranks[length] += [*range(rank, rank + n * each)]
        for b in range(first, first + n):
            fill[b] += [(offset + k * length, length) for k in range(each)]
    assert {k: sorted(v) for k, v in ranks.items()} == {k: [*range(n)] for k, n in histogram.items()}
    for slots in fill.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end += n
        assert end <= context
    assert sorted(fill) == [*range(bins)]
    assert sorted(sum(n for _, n in s) for s in fill.values()) == sorted(brute(lengths, context))


def check(rows, docs, context):
    """Pieces cover each text once, bins don't overflow or overlap."""
    want = Counter()
    for i, t in docs:
        n = len((t or "").split())
        n = n + 1 if n else 0
        if i is not None and n:
            for k in range(-(-n // context)):
                want[i, k, k * context, min(context, n - k * context)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r["bin"]].append((r["offset"], r["length"]))
    for slots in fill.values():
        end = 0
        for at, n in sorted(slots):
            assert at == end
            end += n
        assert end <= context
    assert sorted(fill) == [*range(len(fill))]
    assert sorted(sum(n for _, n in s) for s in fill.values()) == sorted(brute([r["length"] for r in rows], context))


def test_packed(docs_of):
    rng = random.Random(5)
    docs = [(rng.randrange(400), " ".join("w" for _ in range(rng.randrange(0, 90)))) for _ in range(700)]
    docs += [(None, "a b"), (900, None), (901, "  "), (902, "\n a\tb \n"), (902, "\n a\tb \n")]
    check(packing.packed(docs_of(docs), context=40).collect(), docs, 40)


def test_odd_rows(odd, none):
    check(packing.packed(odd).collect(), ODD, packing.CONTEXT)
    assert packing.packed(none).collect() == []
