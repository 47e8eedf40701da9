"""The driver contract, also without the optional subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from cadenza.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns[0] == "video_id" and frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(registry.queries())), "False"], said.stderr


def test_nothing_else_imports_the_subpackage():
    name = re.compile(r"cadenza\.llm|from cadenza import llm|corpus_pipeline")
    others = [p for p in (ROOT / "cadenza").rglob("*.py") if "llm" not in p.parts]
    assert others and not [p for p in others if name.search(p.read_text())]
