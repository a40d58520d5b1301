"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys

from tests.conftest import HERE


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still imports and lists the other queries."""
    import shutil

    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    n, pipeline, op = out.stdout.split()
    assert int(n) > 90 and pipeline == op == "False"
