"""The entry module without the optional text operators."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(folder)})
    return [set(line.split()[1:]) for line in done.stdout.splitlines()]


@pytest.mark.parametrize("pipeline", [True, False])
def test_other_queries_without_text_operators(tmp_path, pipeline):
    """Without the folders every other query is there, with the pipeline's file left behind or not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
    text = re.compile(r"op\d+_|pipeline$")
    for left, every in zip(names(copy), names(ROOT), strict=True):
        assert left == {n for n in every if not text.match(n)} and len(left) > 150
