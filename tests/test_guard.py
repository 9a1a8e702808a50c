"""The entry module without the optional part."""

import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "crap_ranking" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
"""


def copied(where, *without):
    shutil.copytree(ROOT / "sextant", where / "sextant", ignore=shutil.ignore_patterns("__pycache__", *without))
    shutil.copy(ROOT / "__spark_entry__.py", where)


def test_queries_without_the_optional_part(tmp_path):
    copied(tmp_path, "llm")
    subprocess.run([sys.executable, "-c", textwrap.dedent(CODE)], check=True, cwd=tmp_path)


def test_a_broken_optional_part_is_told(tmp_path):
    copied(tmp_path, "llm")
    (tmp_path / "sextant/llm").mkdir()
    (tmp_path / "sextant/llm/__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode
