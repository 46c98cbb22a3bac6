import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docmetrics.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def reports(spark):
    from docmetrics.sources.fixtures import REPORTS
    return spark.createDataFrame([(d, t) for d, _, _, t in REPORTS], "document_id string, text string")
