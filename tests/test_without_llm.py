"""The library works when the training-data subpackage and its tests are deleted."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 150 and set(o) <= set(q), (len(q), set(o) - set(q))
assert "pipeline" not in q and not any(n.startswith("op") for n in q)
"""


@pytest.mark.parametrize("gone", [("paperloom/llm", "tests/llm"), ("paperloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_library_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in gone:
        path = copy / part
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env=env)
