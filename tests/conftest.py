import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quaystone.session import local_session

    s = local_session(4, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


@pytest.fixture
def stored(spark, tmp_path):
    """Writes rows as a table of several files and reads it back."""

    def write(rows, schema, name="t", files=2):
        where = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(where)
        return spark.read.schema(spark.read.parquet(where).schema).parquet(where)

    return write
