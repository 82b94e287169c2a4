"""Tables for the tests of this folder."""

from __future__ import annotations

import pytest
from llm_texts import ODD

#: Columns whose names the operators use inside.
CLASHING = "hi long, lo long, node long, root long, key string, n long, piece int, bin long, rank long, language string, score double, found string, _gone long, _r int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) as a table of documents with more columns than the operators know."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
        extra = (1, 2, 3, 4, "k", 5, 6, 7, 8, "xx", 0.5, "f", 9, 10)
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), *extra) for i, t in rows], schema)

    return make


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def none(docs_of):
    return docs_of([])
