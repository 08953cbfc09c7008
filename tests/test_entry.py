"""The entry module where the training-data operators, or a module they need, are missing."""

import pathlib
import shutil
import subprocess
import sys

import pytest

from treecorpus.plans import catalog

ROOT = pathlib.Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) == set(e.queries())"


@pytest.fixture
def copy(tmp_path):
    """The tree without both folders of the training-data operators."""
    for name in ("treecorpus", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    return tmp_path


def asked(folder, code=ASK):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"},
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_the_rest_stands_alone(copy):
    assert asked(copy) == sorted(catalog.QUERIES)


def test_the_pipeline_may_go_too(copy):
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert asked(copy) == sorted(catalog.QUERIES)


def test_a_missing_module_takes_only_what_needs_it():
    hidden = "import sys; sys.modules['xxhash'] = None; " + ASK
    assert set(catalog.QUERIES) <= set(asked(ROOT, hidden))
