"""The driver's contract without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
from strandflow.plans.catalog import ORACLES, QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
"""


def copied(to: Path) -> Path:
    shutil.copytree(ROOT / "strandflow", to / "strandflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", to)
    return to


def run(folder: Path) -> None:
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, check=True, timeout=120)


def test_entry_without_the_subpackage(tmp_path):
    """The core queries are there without the subpackage, with and without corpus_pipeline.py, and with an empty folder left."""
    run(copied(tmp_path))
    (tmp_path / "corpus_pipeline.py").write_text("from strandflow.llm import mixing\n")
    run(tmp_path)
    (tmp_path / "strandflow" / "llm").mkdir()
    run(tmp_path)
