"""The registered queries: against SQL where there is one, else that they run over the whole table."""

import oracle
import pytest
from oracle import ROOT, SF

from stepwright.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, duck, name):
    got = oracle.of_spark(catalog.queries()[name](spark, SF))
    assert oracle.difference(got, oracle.of_sql(duck, catalog.oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", ["op2_bestfit_packing", "op5_ranked_ids", "op10_language"])
def test_every_document_appears(spark, duck, name):
    got = {r[0] for r in catalog.queries()[name](spark, SF).select("doc_id").collect()}
    assert got == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "stepwright").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "stepwright.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
