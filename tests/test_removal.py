"""The library without its corpus operators: they can be taken out, with or without the pipeline that uses them."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = """
import __spark_entry__ as e
names = set(e.queries())
assert "report_labels" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 6
"""


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_queries_and_entry_without_the_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(copy / "tagmill" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_broken_import_inside_the_subpackage_is_not_swallowed(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "llm"))
    (copy / "tagmill" / "llm").mkdir()
    (copy / "tagmill" / "llm" / "__init__.py").write_text("")
    (copy / "tagmill" / "llm" / "queries.py").write_text("import nowhere_to_be_found\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode != 0 and "nowhere_to_be_found" in done.stderr
