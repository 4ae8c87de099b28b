"""Every query of the library against its SQL, or at least its rows."""

import pytest

from tessera import plans
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, con, name):
    if name in plans.SQL:
        assert compare(spark, con, small, plans.QUERIES[name], plans.SQL[name]) == ""
    else:
        assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables(spark, small):
    """Nothing is cut off the sorted, pinned and cleaned rows."""
    for name, source in (("sort_mixed", "part"), ("pin_top", "supplier")):
        got = plans.QUERIES[name](spark, small)
        assert got.count() == spark.read.parquet(f"{small}/{source}.parquet").count()
    assert [r[0] for r in plans.QUERIES["pin_top"](spark, small).orderBy("place").limit(2).collect()] == [7, 3]
    assert plans.QUERIES["tokens_clean"](spark, small).select("w").distinct().count() > 200


def test_entry_without_the_training_data_parts(tmp_path):
    """The entry works without the subpackage and the pipeline, but doesn't hide an import that fails inside of them."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"]
    done = subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(plans.QUERIES)), "False"], done.stderr
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").write_text("")
    (tmp_path / "tessera/llm/queries.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    done = subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr


def test_executors_need_no_copy_of_the_library(small, tmp_path):
    from tests import alone

    assert all(alone.rows(small, str(tmp_path), "knn_inverted", "bootstrap_ci", "casefold_norm", "dirichlet_search"))
