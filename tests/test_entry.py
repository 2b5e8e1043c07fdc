"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 170
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_llm(tmp_path):
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in ("siltstone", "__spark_entry__.py"):
        (shutil.copytree if (root / p).is_dir() else shutil.copy)(root / p, tmp_path / p)
    shutil.rmtree(tmp_path / "siltstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_pricing_summary' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "siltstone"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text())
