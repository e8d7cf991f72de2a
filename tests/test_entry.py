"""The entry module with and without the training-data jobs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = ("import re; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); "
        "print(len(q), any(re.match(r'op[0-9]', n) for n in q))")


def listed(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=env, text=True,
                         capture_output=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_lists_its_queries_without_the_jobs(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(
        ".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, jobs = listed(bare)
    assert int(n) >= 99 and jobs == "False"
