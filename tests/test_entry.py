"""The driver's entry points, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SEEN = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(n.startswith('op') for n in q), set(s) <= set(q))"


@pytest.mark.parametrize("gone", [(), ("pelagia/llm",), ("pelagia/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, gone):
    for name in ("pelagia", "__spark_entry__.py", "corpus_pipeline.py"):
        here = ROOT / name
        if here.is_dir():
            shutil.copytree(here, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif here.exists():
            shutil.copy(here, tmp_path / name)
    for name in gone:
        there = tmp_path / name
        shutil.rmtree(there, ignore_errors=True) if there.is_dir() else there.unlink(missing_ok=True)
    ran = subprocess.run([sys.executable, "-c", SEEN], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    n, n_sql, pipeline, corpus, matched = ran.stdout.split()[-5:]
    assert int(n) > 90 and int(n_sql) > 80 and matched == "True"
    assert corpus == str((tmp_path / "pelagia/llm").is_dir())
    assert pipeline == str((tmp_path / "pelagia/llm").is_dir() and (tmp_path / "corpus_pipeline.py").exists())
