import subprocess
import sys

import pytest

ROOT = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["zstandard", "corpus_pipeline", "loomwork.llm"])
def test_other_queries_stay_without_an_extra(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from loomwork.plans import registry; q = e.queries(); assert set(registry.QUERIES) <= set(q) and set(e.oracle_sql()) <= set(q) and ({missing!r} == 'zstandard' or 'pipeline' not in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
