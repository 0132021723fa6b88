import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def names(at):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(at)}, check=True)
    return [set(line.split()) for line in got.stdout.splitlines()]


def test_entry_works_without_the_subpackage(tmp_path):
    """The other queries are all there when the folders llm are gone, whether or not the pipeline's module went with them."""
    shutil.copytree(ROOT / "aksharflow", tmp_path / "aksharflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles = names(tmp_path)
    assert "clean_none" in queries and "clean_none" in oracles and "pipeline" not in queries and not any(q.startswith("op") for q in queries)
    (tmp_path / "corpus_pipeline.py").write_text("from aksharflow.llm import nothing\n")
    assert names(tmp_path) == [queries, oracles]
