"""The entry module without the pipeline subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_pipeline_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "stewardlake"), tmp_path / "stewardlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = ("import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and set(e.oracle_sql()) <= set(q); "
            "assert 'pipeline' not in q and not any(k.startswith('op8_') for k in q)")
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
