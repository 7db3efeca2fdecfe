"""The driver contract at the smallest scale."""

import __spark_entry__ as contract


def test_flagship_and_registry(spark):
    assert contract.entry(spark).count() > 0
    names, sql = set(contract.queries()), set(contract.oracle_sql())
    assert sql <= names and len(names) > 130


def test_registry_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_queries_without_the_libraries_of_the_training_data(spark):
    """Without one of their libraries only the training-data operators are gone."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(contract.__file__))
    code = (
        "import sys; sys.modules['xxhash'] = None; sys.modules['zstandard'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert len(names) > 130 and 'bill_ledger' in names and set(e.oracle_sql()) <= set(names)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
