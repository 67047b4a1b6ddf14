"""The rest of the library stands without the llm folders and the pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    own = tmp_path / "copy"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'state_islands' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=own, env=os.environ | {"PYTHONPATH": str(own)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "sievemill")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "llm" not in f.read(), name
