"""The entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("gone", [["strandline/llm", "tests/llm"], ["strandline/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_imports_without_corpus_operators(tmp_path, gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(x) for x in gone])
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'hotspots' in q and 'pipeline' not in q and not [x for x in [*q, *s] if x.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
