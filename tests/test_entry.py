"""The entry point with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(repo):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=repo, env={**os.environ, "PYTHONPATH": repo}, capture_output=True, text=True, timeout=300, check=True)
    return set(done.stdout.split())


def test_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    lean, full = names(copy), names(REPO)
    assert lean <= full and not any(n.startswith("op") for n in lean)
    if os.path.exists(f"{REPO}/corpus_pipeline.py"):
        assert {n.split("_")[0] for n in full - lean} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
