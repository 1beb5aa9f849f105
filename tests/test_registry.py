import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = os.path.join(oracle.TESTDATA, "sf0.001")
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, SF_DIR, name, entry.queries()[name], ORACLES.get(name))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("without", [("leafmill/llm", "tests/llm"), ("leafmill/llm", "tests/llm", "corpus_pipeline.py")])
def test_everything_else_stands_without_the_training_data_operators(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(oracle.ROOT, copy, ignore=lambda folder, names: [n for n in names if n == ".git" or os.path.relpath(os.path.join(folder, n), oracle.ROOT) in without])
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split() == sorted(q for q in entry.queries() if not q.startswith("op") and q != "pipeline")
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert collected.returncode == 0, collected.stdout
