"""The entry module without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("kept", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_llm_folders(tmp_path, kept):
    for name in ("__spark_entry__.py", *kept):
        if (TOP / name).exists():
            shutil.copy(TOP / name, tmp_path / name)
    shutil.copytree(TOP / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, any(k.startswith('op') for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, m, *rest = said.stdout.split()
    assert int(n) >= int(m) > 100 and rest == ["False", "False"]
