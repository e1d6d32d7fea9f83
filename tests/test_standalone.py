"""The rest imports and lists its queries with the corpus folders gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(e.oracle_sql()) - set(q)))"


def _elsewhere() -> list[str]:
    """The folders of PYTHONPATH that do not hold the repository's modules."""
    return [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not (Path(p) / "__spark_entry__.py").exists() and not (Path(p) / "netloom").exists()]


@pytest.mark.parametrize("left", ["nothing", "caches", "an empty folder", "corpus folder, no pipeline"])
def test_without_corpus_operators(left: str, tmp_path: Path) -> None:
    for name in ("netloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    llm = tmp_path / "netloom" / "llm"
    whole = llm.exists() and left == "corpus folder, no pipeline"
    if whole:
        (tmp_path / "corpus_pipeline.py").unlink()
    else:
        shutil.rmtree(llm, ignore_errors=True)
        if left == "caches":
            (llm / "__pycache__").mkdir(parents=True)
        elif left == "an empty folder":
            llm.mkdir()
        else:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    # Only the copy may be found, whatever the path of the tests' own process is.
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join([str(tmp_path), *_elsewhere()])}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert out.returncode == 0, out.stderr
    n, corpus, unknown = map(int, out.stdout.split())
    assert n - corpus >= 99 and (corpus >= 10 if whole else corpus == 0) and unknown == 0
