import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_queries_and_sql_have_names_in_common():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["child_table", "child_id", "kind"]


def test_core_does_not_need_llm():
    code = "import sys; sys.modules['quern.llm'] = None\nimport __spark_entry__ as e\nassert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_a_copy_without_llm_works(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e\nassert 'p4_found' in e.queries() and 'p1_found' not in e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, timeout=120).returncode == 0
