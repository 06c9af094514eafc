"""Rules of the source itself."""

import pathlib
import re
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
CORE = [p for p in (ROOT / "stelae").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_nothing_else_imports_the_training_subpackage():
    for path in [*CORE, *(p for p in (ROOT / "tests").glob("*.py") if p.name != "test_guards.py")]:
        assert not re.search(r"stelae[./]llm|from stelae import llm", path.read_text()), path


def test_one_definition_of_being_current():
    defined = [p.name for p in CORE if re.search(r"standing[\"')\s]*\)?\s*==\s*(ASSERTED|[\"']asserted)", p.read_text()) and "sql" not in p.name.lower() and "plans" not in p.parts]
    assert defined == ["graph.py"]


def test_queries_have_no_way_to_write():
    for name in ("retrieval.py", "tools.py"):
        text = (ROOT / "stelae/operators" / name).read_text()
        assert not re.search(r"\.write\b|append\(|createDataFrame", text), name


def test_no_local_checkpoint_and_no_rdd():
    for path in (ROOT / "stelae").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".rdd" not in text and "crossJoin" not in text, path


COUNT = "import sys; sys.modules.update({}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("case", ["a module is missing", "a left-over folder", "no folder"])
def test_the_core_runs_without_the_training_subpackage(case, tmp_path):
    """The entry file lists the queries of the core whatever keeps the rest from being imported."""
    from stelae.plans import registry

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    left_out = shutil.ignore_patterns("__pycache__", *(() if case == "a module is missing" else ("llm",)))
    shutil.copytree(ROOT / "stelae", tmp_path / "stelae", ignore=left_out)
    if case == "a left-over folder":
        (tmp_path / "stelae/llm/__pycache__").mkdir(parents=True)
    hidden = "xxhash=None, tokenizers=None" if case == "a module is missing" else ""
    done = subprocess.run([sys.executable, "-c", COUNT.replace("{}", hidden)], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE))], done.stderr
