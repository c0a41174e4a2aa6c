"""The library and its entry without the operators for training text."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from diffmill.plans.queries import all_queries

ROOT = Path(__file__).resolve().parents[1]
TEXT = ["diffmill/llm", "tests/llm", "corpus_pipeline.py"]


@pytest.mark.parametrize("gone", [TEXT, TEXT[:2]])
def test_entry_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(ROOT)) in gone
    ])
    code = (
        "import __spark_entry__ as e, check, bench; "
        "assert not set(e.oracle_sql()) - set(e.queries()); print(*sorted(e.queries()))"
    )
    ran = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split() == sorted(all_queries())


def test_nothing_else_imports_the_text_operators():
    for path in [*ROOT.glob("*.py"), *(ROOT / "diffmill").rglob("*.py"), *(ROOT / "tests").rglob("*.py")]:
        inside = path.relative_to(ROOT).as_posix()
        if not inside.startswith(("diffmill/llm", "tests/llm", "corpus_pipeline", "__spark_entry__", "tests/test_layout")):
            assert "diffmill.llm" not in path.read_text(), inside
