import random
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import ODD, prose

from stepwright.llm import svbyte as V

CODER = tiktoken.Encoding("plain", pat_str=V.PATTERN, mergeable_ranks=V.merges(), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=70))
def test_round_trip(ids):
    control, data = V.encode_ids(np.array(ids, np.uint32))
    assert len(control) == -(-len(ids) // 4)
    assert len(data) == sum(1 + (i > 255) + (i > 65535) + (i > 16777215) for i in ids)
    assert V.decode_ids(control, data, len(ids)).tolist() == ids


def test_tokens_equal_the_coders():
    rng = random.Random(6)
    chars = " \n\t a'sé1.-漢  \u000b"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(25))) for _ in range(4000)]
    texts += ["", None, "a", " a", "a ", "x  y", "x   y", "don't stop's", "<|endoftext|> a", prose(1, 3000)]
    ids, edge = V.tokenizer()(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[edge[k] : edge[k + 1]].tolist() == CODER.encode_ordinary(t or "")


def check(spark, docs, rows):
    """Decoded ranks give back the tokens; ranks fall with the corpus's counts, ties by id."""
    count = Counter(i for _, t in rows for i in CODER.encode_ordinary(t or ""))
    order = sorted(count, key=lambda i: (-count[i], i))
    got = V.encoded(docs).collect()
    want = Counter((d, t or "") for d, t in rows)
    back = Counter()
    for r in got:
        ranks = V.decode_ids(r["control"], r["data"], r["n_tokens"])
        back[r["doc_id"], CODER.decode([order[k] for k in ranks])] += 1
    assert back == want


def test_encoded(spark, docs_of):
    rows = [(k, prose(k, 50)) for k in range(60)]
    check(spark, docs_of(rows), rows)


def test_odd_rows(spark, odd, none):
    check(spark, odd, ODD)
    assert V.encoded(none).collect() == []


def test_vocabulary_of_more_than_65536_ids(docs_of, tmp_path):
    """The same merges and 20,000 more after a gap: ids of the added ones need more than 16 bits."""
    import base64

    ranks = V.merges()
    extra = {b"qz%d" % k: 70_000 + k for k in range(20_000)}
    assert not set(extra) & set(ranks)
    steps = {x[:k] for x in extra for k in range(2, len(x))} - set(ranks) - set(extra)
    ranks |= {x: 100_000 + k for k, x in enumerate(sorted(steps, key=lambda x: (len(x), x)))}
    path = tmp_path / "large.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % i for x, i in (ranks | {x: i + 50_000 for x, i in extra.items()}).items()))
    rows = [(1, "a qz12345 text of qz17 words"), (2, None), (3, "qz19999")]
    large = V.merges(str(path))
    assert max(large.values()) > 65_536
    coder = tiktoken.Encoding("large", pat_str=V.PATTERN, mergeable_ranks=large, special_tokens={})
    tokens = V.tokenised(docs_of(rows), path=str(path))
    rank = V.ranking(tokens, max(large.values()) + 1)
    for r in V.encoded(docs_of(rows), path=str(path)).collect():
        want = coder.encode_ordinary(dict(rows)[r["doc_id"]] or "")
        assert V.decode_ids(r["control"], r["data"], r["n_tokens"]).tolist() == rank[want].tolist()
