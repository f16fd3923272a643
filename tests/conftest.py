import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glossa.tables import session

    spark = session("tests", "4", 4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
