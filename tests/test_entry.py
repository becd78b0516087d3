"""The driver's contract, with and without the llm folders."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"] or entry.entry(spark).count() > 0


def test_imports_without_the_llm_folders(tmp_path):
    root = Path(__file__).parent.parent
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "quillrank").mkdir()
    for p in (root / "quillrank").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quillrank" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_llm():
    root = Path(__file__).parent.parent / "quillrank"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(encoding="utf-8"), re.M), p
