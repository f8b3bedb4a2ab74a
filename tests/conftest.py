import pytest
from pyspark.sql import functions as F

from placeloom.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def clash():
    """Adds columns whose names operators might use themselves."""

    def add(df):
        for i, c in enumerate(("id", "key", "code", "cell", "n", "k", "t", "value", "salt", "row_id", "bucket", "field_name", "pos", "block", "word", "copies", "_k", "_t", "size")):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string") if i % 2 else F.lit(i))
        return df

    return add
