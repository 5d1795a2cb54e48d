"""Every query outside murmurlake.llm against its SQL on the smallest tables."""

import pytest
from oracle import answer, rows

from murmurlake.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.SQL:
        assert len(got)
        return
    want = answer(registry.SQL[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sizes_within_tolerance(spark):
    """The tolerance of the SQL is the query's too; the smallest tables hold no size that only it lets pass."""
    got, sf = registry.QUERIES["check_sizes"](spark, "/root/testdata/sf0.1").toPandas(), "/root/testdata/sf0.1"
    assert rows(got) == rows(answer(registry.SQL["check_sizes"], sf)) and (got["status"] == "within tolerance").sum() == 5


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_corpus_package(tmp_path):
    """A copy of the tree without the corpus operators and their pipeline imports and registers the rest."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "murmurlake", tmp_path / "murmurlake", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
