import os
import subprocess
import sys

import pandas as pd
import pytest

import __spark_entry__
from tidegraph.plans import catalog

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def _rows(df):
    df = df[sorted(df.columns)].apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) else c)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@tables
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want, got = c.execute(catalog.ORACLES[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and _rows(want) == _rows(got)


@tables
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "parent", "level"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@tables
def test_queries_without_sql(spark):
    row = catalog.QUERIES["partition_label_propagation"](spark, SF).first()
    assert 0 < row["cut"] < row["expected"]
    teps = catalog.QUERIES["graph500_teps"](spark, SF).first()
    assert teps["n"] == 64 and teps["harmonic_mean"] > 0
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"partition_label_propagation", "graph500_teps"}


def test_entry_stands_without_the_training_subpackage(tmp_path):
    """The entry module imports and lists its own queries where that subpackage and the pipeline are gone."""
    for name in ("tidegraph", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(os.path.join(HERE, name))
    (tmp_path / "tidegraph").unlink()
    (tmp_path / "tidegraph").mkdir()
    for name in os.listdir(os.path.join(HERE, "tidegraph")):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "tidegraph" / name).symlink_to(os.path.join(HERE, "tidegraph", name))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_broken_imports_are_errors(tmp_path):
    """A subpackage that is there but can't be imported doesn't silently drop its queries."""
    (tmp_path / "__spark_entry__.py").symlink_to(os.path.join(HERE, "__spark_entry__.py"))
    (tmp_path / "tidegraph").mkdir()
    for name in os.listdir(os.path.join(HERE, "tidegraph")):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "tidegraph" / name).symlink_to(os.path.join(HERE, "tidegraph", name))
    (tmp_path / "tidegraph" / "llm").mkdir()
    (tmp_path / "tidegraph" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tidegraph" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    code = "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ModuleNotFoundError as x:\n    assert x.name == 'no_such_module_anywhere'\nelse:\n    raise SystemExit(1)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
