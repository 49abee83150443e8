"""The driver contract with and without the text-preparation subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def ask(folder) -> list[str]:
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftover", [False, True])
def test_queries_without_the_subpackage(tmp_path, pipeline, leftover):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "snapgrain"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "snapgrain" / "llm", ignore_errors=True)
    if leftover:  # compiled files of the deleted package may stay
        (tmp_path / "snapgrain" / "llm" / "__pycache__").mkdir(parents=True)
    if not pipeline:
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    n, ops, there = ask(tmp_path)
    assert int(n) > 50 and ops == "0" and there == "False"
