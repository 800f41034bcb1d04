"""The entry module without the optional parts: a copy of the repository from which they are deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def _entry(at: Path) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, check=True).stdout.split())


def test_the_rest_works_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "all", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    at = tmp_path / "all"
    for gone in ("tallyframe/llm", "tests/llm"):
        shutil.rmtree(at / gone, ignore_errors=True)
    left = _entry(at)
    assert "open_nearest" in left and not any(x.startswith("op") and x[2:3].isdigit() for x in left) and "pipeline" not in left
    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _entry(at) == left
