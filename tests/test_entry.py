"""The entry module, whole and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "cross_case_connections" in queries


def test_without_the_subpackage(tmp_path):
    """Imports and lists queries with lodeline/llm gone, whether corpus_pipeline.py stays or goes."""
    shutil.copytree(ROOT / "lodeline", tmp_path / "lodeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'pipeline' not in q; assert not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import lodeline.llm\n")
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, check=True)
