"""The driver's contract."""

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["item_id", "doc_id", "shared", "tau"] and df.count() == 40
