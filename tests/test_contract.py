"""The driver's contract, and that the core does not need the training-data subpackage."""

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_runs(spark, data_dir):
    df = entry.entry(spark)
    assert df.count() > 0 and "relation" in df.columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_training_data_subpackage():
    code = "import sys; sys.modules['pairlens.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests", 1)[0])
