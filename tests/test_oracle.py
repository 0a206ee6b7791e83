"""Every query with SQL: Spark equals DuckDB on the same tables; and results don't depend on the number of partitions."""

import glob
import os

import duckdb
import pytest

from lumenfold import registry

DIR = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def collected(df):
    return canonical(df.columns, df.collect())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_spark_equals_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert collected(got) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["cdef_direction", "wiener_nonsep", "cdf_tile_average", "container_image_info", "affine_fit"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(collected(registry.queries()[name](spark, DIR)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"session_resets", "grain_luts"}  # compared with plain Python in test_sources and test_kernels


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_a_dependency_of_the_training_data_queries():
    """A package that only some queries need is absent: the others are there all the same."""
    import subprocess
    import sys

    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in out] == [len(registry.queries()), len(registry.oracle_sql())]
