"""The entry module with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
       "print(len(q), len(o), 'W1_dialogue_context' in q, any(n.startswith('op') for n in q), set(o) <= set(q))")


def copied(folder, *gone: str) -> str:
    to = str(folder / "repo")
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", *gone))
    return to


def said(repo: str) -> list[str]:
    done = subprocess.run([sys.executable, "-c", SAY], cwd=repo, env={**os.environ, "PYTHONPATH": repo}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_queries_without_the_optional_folders(tmp_path, gone):
    n, m, core, more, named = said(copied(tmp_path, *gone))
    assert int(n) >= 82 and int(m) >= 77 and (core, more, named) == ("True", "False", "True")


def test_other_import_errors_are_not_swallowed(tmp_path):
    repo = copied(tmp_path)
    if not os.path.isdir(os.path.join(repo, "turnscore", "llm")):
        pytest.skip("the optional subpackage is not installed")
    with open(os.path.join(repo, "turnscore", "llm", "queries.py"), "a") as f:
        f.write("\nimport no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", SAY], cwd=repo, env={**os.environ, "PYTHONPATH": repo}, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
