"""The package works when the corpus operators are not there."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tidewatt", tmp_path / "tidewatt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "tidewatt").rglob("*.py"):
        if "llm" not in path.parts:
            assert ".llm" not in path.read_text()
