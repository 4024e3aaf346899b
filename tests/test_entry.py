import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_loads_without_the_optional_folders(tmp_path, pipeline):
    ignored = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'bm25_topk' in q, 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PATH": "/usr/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, main, whole = done.stdout.split()
    assert int(n) > 90 and main == "True" and whole == "False"


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
