import shutil
import subprocess
import sys
from pathlib import Path


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage and the pipeline, the entry still has the other queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "chronoweave", tmp_path / "chronoweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
