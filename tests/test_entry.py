import importlib
import subprocess
import sys

from oracle import ROOT


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_imports_without_the_llm_folders():
    """With the subpackage and the pipeline away the rest is still there."""
    code = """
import sys
class Away:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("stepwright.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Away())
import __spark_entry__ as e
q = e.queries()
assert "transition_edges" in q and "pipeline" not in q and not any(k.startswith("op") and k[2].isdigit() for k in q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    df = importlib.import_module("__spark_entry__").entry(spark)
    assert df.columns and df.count() > 0
