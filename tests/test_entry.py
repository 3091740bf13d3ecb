"""The entry module, with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_stands_alone(tmp_path):
    """A copy without the subpackage imports and keeps its own queries."""
    import shutil

    for name in ("larkgraph", "__spark_entry__.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 20 and rows[0].asDict().keys() == {"entity", "rank_lr", "rank_resnik", "fused"}
