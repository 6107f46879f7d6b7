import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_flagship(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q)
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() >= 0


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "leafmill", tmp_path / "leafmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'provenance_result' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op1')]; assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_outside_imports_it():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py", "test_entry.py"):
            assert "leafmill.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
