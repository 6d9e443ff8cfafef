"""The driver's contract, with and without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 120


def test_without_the_optional_part(tmp_path):
    """Everything else imports when the llm folder and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "quillmark", tmp_path / "quillmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'grade_receipts' in n and not any(k.startswith('op') and k[2].isdigit() for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
