import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the llm folders and corpus_pipeline.py the entry imports, and has all other queries."""
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(said.stdout.split()[0]) > 70


def test_the_rest_stands_without_the_libraries_of_llm(tmp_path):
    """With all files there but a library that can't be imported, the other queries stay."""
    hidden = "import sys; sys.modules['sentencepiece'] = None; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", hidden], cwd=ROOT, capture_output=True, text=True, check=True)
    all_of_them, ops, sql = map(int, said.stdout.split())
    assert all_of_them > 70 and ops == 0 and sql > 70
