"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry_module

from tidemill.plans import catalogue

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(catalogue.queries()) <= set(entry_module.queries())
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


def test_entry_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry_module.entry(spark).limit(1).count() == 1


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/tidemill", tmp_path / "tidemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) == set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(catalogue.queries()), out.stderr
