"""Every query against its SQL over the smallest tables."""

import pytest

from grainmill import catalog
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_subpackage_may_be_missing(tmp_path):
    """A missing library is an error, a missing subpackage is not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "grainmill", tmp_path / "grainmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / f).exists():
            shutil.copy(root / f, tmp_path / f)
    code = "import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()), len(e.queries()) > 30)"
    run = lambda: subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == ["False", "True"]
    (tmp_path / "grainmill/llm").mkdir()
    (tmp_path / "grainmill/llm/__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_here\n")
    assert "a_library_that_is_not_here" in run().stderr
