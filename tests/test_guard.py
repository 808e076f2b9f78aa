import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
GONE = ("llm", "__pycache__", "corpus_pipeline.py", "test_guard.py")


def test_all_else_works_without_the_llm_parts(tmp_path):
    """As the driver does: a copy without those folders still has the other queries, and its tests pass."""
    for name in ("__spark_entry__.py", "entwine", "tests"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns(*GONE)) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'k3_combined_candidates' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    tests = [sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "test_text or test_entry or labels or combine or metrics or white_space"]
    subprocess.run(tests, cwd=tmp_path, check=True, timeout=900)
