"""The driver's contract, with the training-data operators and without."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import sys, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k[:2] == 'op' and k[2].isdigit() for k in q), 'pipeline' in q, any(m.startswith('glyphtally.llm') for m in sys.modules))"


def asked(folder) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("gone", [["glyphtally/llm", "tests/llm"], ["glyphtally/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_training_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for x in gone:
        p = tmp_path / "repo" / x
        if p.is_dir():
            shutil.rmtree(p)
        elif p.exists():
            p.unlink()
    n, ops, pipeline, llm = asked(tmp_path / "repo")
    assert int(n) > 50 and ops == "0" and pipeline == "False" and llm == "False"
