"""The registry with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(' '.join(sorted(q)))"


def names(at):
    return subprocess.run([sys.executable, "-c", ASK], cwd=at, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": at}).stdout.split()


def copied(at, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, at, ignore=skip)
    for name in without:
        path = os.path.join(at, name)
        (shutil.rmtree if os.path.isdir(path) else os.remove if os.path.exists(path) else lambda p: None)(path)
    return str(at)


def test_other_queries_stay_without_the_subpackage(tmp_path):
    for n, also in enumerate(([], ["corpus_pipeline.py"])):
        left = names(copied(tmp_path / str(n), "docketlake/llm", "tests/llm", *also))
        assert "match_documents" in left and not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in left)


def test_nothing_else_imports_the_subpackage():
    for top, _, files in os.walk(os.path.join(ROOT, "docketlake")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in top:
                assert "docketlake.llm" not in open(os.path.join(top, f)).read(), f
