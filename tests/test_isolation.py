"""The package, the entry and its other queries work without the text operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imported(tree):
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=tree, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, check=True).stdout


def copied(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    return tree


def test_entry_without_the_text_operators(tmp_path):
    tree = copied(tmp_path)
    found = imported(tree)  # corpus_pipeline.py is there, what it imports isn't
    (tree / "corpus_pipeline.py").unlink(missing_ok=True)
    assert found == imported(tree)
    count, rest = found.split(" ", 1)
    assert int(count) > 40 and rest.split() == ["[]", "True"]


def test_nothing_else_imports_the_text_operators():
    others = [p for p in (ROOT / "logloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert others and not [p for p in others if "logloom.llm" in p.read_text()]
