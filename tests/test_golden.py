"""Published and hand-worked rows of the rules."""

import pytest

from bindery.plans import catalogue, golden  # noqa: F401  golden keeps rows of its own


@pytest.fixture(scope="module")
def con():
    return pytest.importorskip("duckdb").connect()


@pytest.mark.parametrize("name", sorted(catalogue.GOLDEN))
def test_rows(spark, con, name):
    found, sql = catalogue.GOLDEN[name]
    rows = found(spark, None)
    cols = sorted(rows.columns)
    ours = sorted(repr(tuple(r)) for r in rows.select(*cols).collect())
    assert ours == sorted(repr(r) for r in con.sql(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_every_registered_query_reads_a_table():
    import inspect

    from bindery.plans import tables  # noqa: F401

    assert not {n for n, f in catalogue.QUERIES.items() if "sf_dir" not in inspect.getsource(f).partition(":\n")[2]}


def test_the_entry_is_imported_without_a_session():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
