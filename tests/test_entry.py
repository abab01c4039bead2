"""The contract file without the folders that may be missing."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_contract_without_text_operators(tmp_path, without):
    def left_out(folder, names):
        return [n for n in names if n in (".git", "__pycache__", "tests") or n in without]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    queries, checks = json.loads(out.stdout.strip().splitlines()[-1])
    assert "boq_lines" in queries and "boq_lines" in checks
    assert "pipeline" not in queries
    assert any(name.startswith("op") and name[2].isdigit() for name in queries) == ("llm" not in without)
