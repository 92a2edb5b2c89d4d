import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "mosaiq", tmp_path / "mosaiq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) == set(q) and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_goes_on_without_a_dependency():
    """Where a module that the training-data operators need is missing, all other queries are there."""
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'compose_over' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q) and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True)
