"""The driver entry without the subpackage of the training-data pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
from rivulet.session import local_session
spark = local_session(2)
assert not [q for q in e.queries() if q.startswith("op") and q[2].isdigit()]
assert e.queries()["followed_filter"](spark, "/root/testdata/sf0.001").count() > 0
print("queries", len(e.queries()), len(e.oracle_sql()))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_other_queries_stay_when_the_subpackage_is_gone(tmp_path, pipeline):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=skip)
    assert not (copy / "rivulet" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    count = int(done.stdout.split("queries ")[1].split()[0])
    from rivulet.catalog import QUERIES

    assert count == len(QUERIES)
