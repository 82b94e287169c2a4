import random
from collections import defaultdict

from stepwright.llm import chatwin as C

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens int, place int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def size(text):
    n = len((text or "").split())
    return C.FRAME + (n + 1 if n else 0)


def brute(rows, budget, history, history_tokens):
    """Windows by a plain walk over the turns."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t, r, size(x)))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2]))
        lead = 0
        while lead < len(turns) and turns[lead][1] == "system":
            lead += 1
        fixed = sum(x[2] for x in turns[:lead])
        at, w = lead, 0
        while at < len(turns) or w == 0:
            back = at
            while back > lead and at - back < history and sum(x[2] for x in turns[back - 1 : at]) <= history_tokens:
                back -= 1
            room = max(budget - fixed, 0)
            while back < at and sum(x[2] for x in turns[back : at + 1]) > room:
                back += 1
            stop = at
            while stop < len(turns) and (sum(x[2] for x in turns[back : stop + 1]) <= room or stop == at):
                stop += 1
            took = [*range(lead), *range(back, stop)]
            total = sum(turns[k][2] for k in took)
            for place, k in enumerate(took):
                again = (k < lead and w > 0) or lead <= k < at
                out.append((c, w, place, *turns[k], again, turns[k][1] == "assistant" and not again, total, total > budget))
            at, w = stop, w + 1
    return sorted(out, key=repr)


def got(spark, rows, *p):
    return sorted((tuple(r) for r in C.windows(table(spark, rows), *p).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool"])
            rows.append((c, t, role, " ".join("w" for _ in range(rng.randrange(0, 40)))))
    rng.shuffle(rows)
    for p in ((60, 2, 30), (25, 1, 10), (200, 0, 0), (90, 5, 1000)):
        assert got(spark, rows, *p) == brute(rows, *p)


def test_each_target_once(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "w " * 30) for t in range(40)]
    targets = [r[3] for r in got(spark, rows, 120, 2, 80) if r[7]]
    assert sorted(targets) == [*range(1, 40, 2)]


def test_odd_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 0, "system", "only"), (None, 1, "user", "x"), (3, 1, "user", "w " * 50_000), (3, 2, "assistant", "ok"), (4, 0, "user", "a"), (4, 0, "user", "a b"), (4, 0, "user", "a")]
    assert got(spark, rows, 50, 2, 20) == brute(rows, 50, 2, 20)
    over = [r for r in got(spark, rows, 50, 2, 20) if r[9]]
    assert [(r[0], r[1]) for r in over] == [(3, 0)]
    assert got(spark, []) == []


def test_long_conversations_are_given_out_in_parts(spark, monkeypatch):
    """Conversations of many batches: the windows are those of the whole, however few turns are held."""
    rng = random.Random(3)
    rows = [(c, t, "system" if t < c % 3 else rng.choice(["user", "assistant"]), "w " * rng.randrange(0, 30)) for c in range(5) for t in range(300 if c != 2 else 7)]
    rows += [(9, t, "system", "w") for t in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for held in (1, 20, 100):
            monkeypatch.setattr(C, "HELD", held)
            monkeypatch.setattr(C, "ROWS_OUT", 50)
            for p in ((60, 2, 30), (200, 0, 0), (90, 5, 1000)):
                assert got(spark, rows, *p) == brute(rows, *p)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_formatted(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice([None, "", "a <|end|> b", "été 漢字", "w " * 30])) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += rows[:20] + [(None, 0, "user", "x")]
    by = defaultdict(list)
    for r in brute(rows, 80, 2, 40):
        by[r[0], r[1]].append(r)
    out = C.formatted(table(spark, rows), 80, 2, 40).collect()
    assert len(out) == len(by)
    targets = 0
    for r in out:
        want = sorted(by[r["conv_id"], r["window"]], key=lambda x: x[2])
        assert (r["turns"], r["repeated"], r["tokens"], r["over_budget"]) == (len(want), sum(x[6] for x in want), want[0][8], want[0][9])
        pieces = r["text"].split("<|end|>\n")
        assert pieces[-1] == "" and [p.split("|>\n")[0] for p in pieces[:-1]] == ["<|" + (x[4] or "unknown") for x in want]
        assert [size(p.split("|>\n", 1)[1].replace("< |", "<|")) for p in pieces[:-1]] == [x[5] for x in want]
        spans = [tuple(map(int, x.split(":"))) for x in r["targets"].split()]
        learned = [r["text"][a:b] for a, b in spans]
        assert learned == [p.split("|>\n", 1)[1] + "<|end|>" for p, x in zip(pieces, want, strict=False) if x[7]]
        targets += len(spans)
    assert targets > 20
    assert C.formatted(table(spark, [])).collect() == []
