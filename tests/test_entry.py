"""The driver's contract, and that the library stands without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_corpus_operators(tmp_path):
    code = "import sys; sys.modules['twinsight.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'exact_groups' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
