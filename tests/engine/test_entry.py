"""The driver's entry works with and without the subpackage for training data."""

import os
import re
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [line.split()[1:] for line in out.stdout.splitlines() if line.startswith(("NAMES", "SQL"))]


def test_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(REPO, "tidemark"), tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    queries, sql = names(tmp_path)
    assert "limit_usage" in queries and not any(q.startswith("op") and q[2].isdigit() for q in queries) and "pipeline" not in queries
    assert set(sql) <= set(queries)
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted package may leave
    assert names(tmp_path)[0] == queries


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(REPO, "tidemark")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"(from|import)\s[\w.]*\bllm\b", open(os.path.join(folder, f)).read()), f


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["member_id", "benefit_id", "window_start", "window_end", "used_cents", "remaining_cents"] and df.count() > 0
