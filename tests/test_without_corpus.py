"""The library without its corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SAYS = (
    "import __spark_entry__ as c; names = c.queries(); "
    "assert 'rfm' in names and set(c.oracle_sql()) <= set(names); "
    "assert not any(n == 'pipeline' or n.startswith('op') for n in names)"
)


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_queries_without_the_folders(tmp_path, pipeline_too):
    shutil.copytree(REPO / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if not pipeline_too and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, check=True)
