"""The driver contract, with and without the optional subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 40


def test_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "quirelint"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1') for n in q) and len(q) >= 40; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, timeout=120).returncode == 0


def test_nothing_imports_llm():
    files = [p for p in (ROOT / "quirelint").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if re.search(r"quirelint\.llm|from \.+llm|corpus_pipeline", p.read_text())]


def test_import_without_a_session():
    """Nothing may need Spark before a query is called."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert SparkContext._active_spark_context is None; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
