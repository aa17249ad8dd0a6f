import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['redliner.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n[:2] == 'op']"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    spark.catalog.clearCache()
